"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. Nodes are dealt into bands of like length (within a factor of two, so that long
vectors don't flatten short ones), and each band has its own graph. In it, vectors get one more component that
makes all lengths equal, so that the largest inner product is the smallest angle. The neighbour graph starts from
random projection orders: in each, nodes sorted by the signs of a few random projections are cut into
chunks of fixed length, so no chunk grows with the data, and each node keeps its nearest of the chunk.
Then rounds of NN-descent improve it: a Spark join brings the vectors of each node's neighbours, and of
the nodes that have it as neighbour, together; members of such a neighbourhood are compared and those
nearer than a member's farthest neighbour are added. The neighbourhood of a node that very many nodes point
to is dealt into parts, so no task holds it whole. Rounds stop when few lists change.

A query is searched in every band, as the longest vectors may lie at any angle to it. It starts from the nearest of
a sample of the band under its own measure (the inner product), in its own band also from the list of its own node, and
expands the best nodes not yet expanded, in Spark joins too, until its beam holds none. Bands no larger than the
sample are compared whole; bands too short to hold one of the nearest are left out. Scores of the result are inner
products in double precision of the original vectors. Copies of a vector come back by their smallest ids, so ties are settled exactly.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; repeated
ids keep their smallest vector only. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import in_arrow, table, written
from scorelake.llm.registry import register

DEGREE = 40
ORDERS = 16
CHUNK = 2048
PART = 96
ROUNDS = 6
#: Rounds end when fewer than this share of all list entries is new.
STILL = 0.02
BEAM = 64
#: Nodes of a band that each query is compared with to find its starters, and starters kept.
SAMPLE = 2048
STARTERS = 24
#: Small neighbouring bands are one band, if their lengths lie within this power of two.
SPAN = 60
TOP = 20
_SCALE = 1 << 40


def _matrix(column: pa.Array, kind: str = "float32") -> np.ndarray:
    """A column of vectors packed as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(kind, copy=False).reshape(len(column), -1)


def nodes_of(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (node, vector as doubles, packed), members (node, vec_id), and the vectors' length."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0))
    v = v.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return v.select(F.col("vec_id").alias("node"), "v").limit(0), v.select(F.col("vec_id").alias("node"), "vec_id").limit(0), 0
    size = sizes[0].n
    one = v.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))
    one = written(one)
    nodes = written(one.groupBy("v").agg(F.min("vec_id").alias("node")).select("node", "v"))
    members = written(one.join(nodes, "v").select("node", "vec_id"))
    return nodes, members, size


def _bands(nodes: DataFrame, small: int) -> tuple[DataFrame, dict[int, tuple[float, int]]]:
    """Nodes with the logarithm of their length and their band, and per band the greatest logarithm and the nodes."""
    largest = F.array_max(F.transform("v", F.abs))
    squares = F.aggregate(F.transform("v", lambda x: x / F.col("m")), F.lit(0.0), lambda a, x: a + x * x)
    long = written(nodes.withColumn("m", largest).withColumn("length", F.log2("m") + F.log2(squares) / 2).drop("m"))
    longest = long.agg(F.max("length")).first()[0]
    level = F.floor(F.lit(longest) - F.col("length")).cast("int")
    found = long.groupBy(level.alias("e")).agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("n")).orderBy("e").collect()
    bands: dict[int, tuple[float, int]] = {}
    of: dict[int, int] = {}
    last = 0
    for r in found:
        top, n = bands.get(last, (r.top, 0))
        if n and (n + r.n > small or r.e - last > SPAN):
            last, top, n = r.e, r.top, 0
        elif not n:
            last = r.e
        bands[last] = (top, n + r.n)
        of[r.e] = last
    band = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[level] if of else F.lit(0)
    return long.withColumn("band", band), bands


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(nodes: DataFrame, small: int) -> tuple[DataFrame, dict[int, tuple[float, int]]]:
    """Nodes with their band and single-precision vectors of at most unit length, lengthened by the component that equals
    the lengths of a band; and the bands."""
    banded, bands = _bands(nodes, small)

    def run(batch):
        v = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
        top = np.array([bands[b][0] for b in batch.column("band").to_pylist()])
        x = _unit(v) * np.exp2(batch.column("length").to_numpy() - top)[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        p = np.hstack([x, rest[:, None]]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("band"), pa.array([x.tobytes() for x in p], pa.binary())], ["node", "band", "p"])
    return in_arrow(banded, run, "node long, band int, p binary"), bands


def _directions(size: int, bits: int, order: int) -> np.ndarray:
    return np.random.default_rng(1000 + order).standard_normal((size + 1, bits + 1)).astype(np.float32)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of distinct ids, highest first, ties to the lower id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return ids[keep], scores[keep]


LISTS = "node long, ids array<long>, scores array<float>"


def _list_batch(nodes, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32()))], ["node", "ids", "scores"])


def _start(packed: DataFrame, count: int, size: int, orders: int, chunk: int, degree: int) -> DataFrame:
    """Lists from random projection orders: per order and node, its nearest of a chunk."""
    bits = max(1, (count // chunk).bit_length())

    def keyed(batch):
        x = _matrix(batch.column("p"))
        for o in range(orders):
            y = x @ _directions(size, bits, o)
            code = ((y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)))
            code ^= code >> 1
            yield pa.RecordBatch.from_arrays([batch.column("band"), pa.array(np.full(len(x), o, np.int32)), pa.array(code), pa.array(y[:, bits].astype(np.float32)), batch.column("node"), batch.column("p")],
                                             ["band", "o", "code", "y", "node", "p"])

    def near(batches):
        held: list = []

        def done(rows):
            ids = np.concatenate([r[0] for r in rows])
            x = np.concatenate([r[1] for r in rows])
            k = min(degree // 2, len(ids) - 1)
            if k < 1:
                return
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield _list_batch(ids, list(ids[top]), list(np.take_along_axis(s, top, axis=1)))
        last = None
        for b in batches:
            o, ids, x = b.column("band").to_numpy() * orders + b.column("o").to_numpy(), b.column("node").to_numpy(), _matrix(b.column("p"))
            cut = [0, *(np.flatnonzero(np.diff(o)) + 1).tolist(), len(o)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if last is not None and o[s] != last and held:
                    yield from done(held)
                    held = []
                last = o[s]
                while s < e:
                    room = chunk - sum(len(h[0]) for h in held)
                    held.append((ids[s:min(e, s + room)], x[s:min(e, s + room)]))
                    s += room
                    if sum(len(h[0]) for h in held) >= chunk:
                        yield from done(held)
                        held = []
        if held:
            yield from done(held)
    keys = in_arrow(packed, keyed, "band int, o int, code long, y float, node long, p binary")
    # So many partitions that each holds some chunks, for an order is cut where a partition ends.
    parts = max(1, min(orders * count // (2 * chunk), int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lists = keys.repartitionByRange(parts, "band", "o", "code", "y").sortWithinPartitions("band", "o", "code", "y").select("band", "o", "node", "p").mapInArrow(near, LISTS)
    return _merged(lists, degree)


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    """One list per node: the best of all its lists."""
    def run(batch):
        out = [[], []]
        for ids, scores in zip(batch.column("i").to_pylist(), batch.column("s").to_pylist(), strict=True):
            a, b = _best(np.concatenate([np.array(x, np.int64) for x in ids]), np.concatenate([np.array(x, np.float32) for x in scores]), degree)
            out[0].append(a)
            out[1].append(b)
        yield _list_batch(batch.column("node").to_numpy(), *out)
    grouped = lists.groupBy("node").agg(F.collect_list(F.struct("ids", "scores")).alias("l"))
    return in_arrow(grouped.select("node", F.col("l.ids").alias("i"), F.col("l.scores").alias("s")), run, LISTS)


def _descend(graph: DataFrame, packed: DataFrame, degree: int, part: int, turn: int) -> DataFrame:
    """New entries that a comparison within all neighbourhoods finds, as lists."""
    edges = graph.select("node", F.explode("ids").alias("to"))
    spots = edges.select(F.col("node").alias("pivot"), F.col("to").alias("u"))
    back = edges.select(F.col("to").alias("pivot"), F.col("node").alias("u"))
    # The nodes pointing to a pivot, in parts of about ``part``; its own neighbours go to one of the parts.
    heavy = back.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select(
        "pivot", F.ceil(F.col("n") / F.lit(part)).cast("int").alias("parts"))
    members = spots.union(back).join(heavy, "pivot", "left").select(
        "pivot", "u", F.coalesce(F.pmod(F.xxhash64("u", F.lit(turn)), F.col("parts")), F.lit(0)).cast("int").alias("part")).distinct()
    worst = graph.select(F.col("node").alias("u"), F.when(F.size("ids") < degree, F.lit(-4.0)).otherwise(F.array_min("scores")).cast("float").alias("worst"))
    vectors = worst.join(packed.select(F.col("node").alias("u"), "p"), "u")
    rows = members.join(vectors, "u").repartition("pivot", "part").sortWithinPartitions("pivot", "part")

    def near(ids, x, worst):
        s = x @ x.T
        s[ids[:, None] == ids[None, :]] = -9
        better = s > worst[:, None]
        k = min(8, len(ids) - 1)
        if k < 1 or not better.any():
            return
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        for r in np.flatnonzero(better.any(axis=1)):
            c = top[r][better[r, top[r]]]
            yield ids[r], ids[c], s[r, c]

    def run(batches):
        held, key, out = [], None, []
        for b in batches:
            k = np.stack([b.column("pivot").to_numpy(), b.column("part").to_numpy().astype(np.int64)])
            ids, x, w = b.column("u").to_numpy(), _matrix(b.column("p")), b.column("worst").to_numpy()
            cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                here = (int(k[0, s]), int(k[1, s]))
                if here != key and held:
                    out.extend(near(*(np.concatenate([h[j] for h in held]) for j in range(3))))
                    held = []
                key = here
                held.append((ids[s:e], x[s:e], w[s:e]))
            if len(out) > 20000:
                yield _list_batch(*zip(*out, strict=True))
                out = []
        if held:
            out.extend(near(*(np.concatenate([h[j] for h in held]) for j in range(3))))
        if out:
            yield _list_batch(*zip(*out, strict=True))
    return rows.mapInArrow(run, LISTS)


def build_graph(nodes: DataFrame, size: int, degree: int = DEGREE, orders: int = ORDERS, chunk: int = CHUNK,
                part: int = PART, rounds: int = ROUNDS, still: float = STILL, small: int = SAMPLE) -> tuple[DataFrame, DataFrame, dict]:
    """(graph, packed vectors, bands). Graph: per node the ids and scores of its nearest found in its band."""
    packed, bands = _packed(nodes, small)
    packed = written(packed)
    count = packed.count()
    graph = written(_start(packed, count, size, orders, chunk, degree))
    for turn in range(rounds):
        found = _descend(graph, packed, degree, part, turn)
        better = written(_merged(graph.union(found), degree))
        new = better.join(graph.select("node", F.col("ids").alias("old")), "node").agg(F.sum(F.size(F.array_except("ids", "old")))).first()[0] or 0
        graph = better
        if new < still * count * degree:
            break
    return graph, packed, bands


def _compared(queries: DataFrame, some: DataFrame, keep: int) -> DataFrame:
    """Per query (``q``, ``qp``) and band its ``keep`` best of ``some`` nodes, so few that every task can hold them."""
    held = some.select("node", "band", "p").toArrow().combine_chunks()
    band = held.column("band").to_numpy()
    ids, x = held.column("node").to_numpy(), _matrix(held.column("p")) if len(held) else None
    sets = queries.sparkSession.sparkContext.broadcast([(int(k), ids[band == k], x[band == k]) for k in np.unique(band)])

    def run(batch):
        q, y = batch.column("q").to_numpy(), _matrix(batch.column("qp"))
        for a in range(0, len(q), 512):
            for k, nodes, z in sets.value:
                s = y[a:a + 512] @ z.T
                s[q[a:a + 512, None] == nodes[None, :]] = -np.inf
                n = min(keep, len(nodes))
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                s = np.take_along_axis(s, top, axis=1)
                out = _list_batch(q[a:a + 512], [nodes[t][r > -np.inf] for t, r in zip(top, s, strict=True)], [r[r > -np.inf] for r in s])
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(len(out), k, np.int32)), out.column(1), out.column(2)], ["q", "band", "ids", "scores"])
    return in_arrow(queries, run, "q long, band int, ids array<long>, scores array<float>")


def _promising(state: DataFrame, bands: dict[int, tuple[float, int]], top: int) -> DataFrame:
    """The bands of each query whose greatest possible inner product reaches the ``top``-th best found."""
    if len(bands) < 2:
        return state
    longest = max(b[0] for b in bands.values())
    scale = F.create_map(*[F.lit(x) for k, (t, _) in bands.items() for x in (k, float(2.0 ** max(t - longest, -1070)))])[F.col("band")]
    # Below the true value by more than single precision may err.
    sure = F.transform("scores", lambda x: (x.cast("double") - 1e-5) * scale)
    least = state.select("q", F.explode(sure).alias("s")).groupBy("q").agg(
        F.try_element_at(F.sort_array(F.collect_list("s"), asc=False), F.lit(top)).alias("least"))
    return state.join(least, "q", "left").where(F.col("least").isNull() | (scale >= F.col("least"))).drop("least")


def greedy(graph: DataFrame, packed: DataFrame, bands: dict[int, tuple[float, int]], queries: DataFrame,
           beam: int = BEAM, sample: int = SAMPLE, top: int = TOP) -> DataFrame:
    """Per query node (column ``node``) and band: its beam after greedy search, as lists (own node left out)."""
    def own(batch):
        y = _matrix(batch.column("p"))[:, :-1].astype(np.float64)
        p = np.hstack([_unit(y), np.zeros((len(y), 1))]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("band"), pa.array([x.tobytes() for x in p], pa.binary())], ["q", "own", "qp"])
    query = written(in_arrow(queries.select("node").distinct().join(packed, "node").select("node", "band", "p"), own, "q long, own int, qp binary"))
    # The share of each band that makes a sample; small bands whole.
    share = F.create_map(*[F.lit(x) for k, (_, n) in bands.items() for x in (k, int(min(1.0, sample / n) * _SCALE))])[F.col("band")]
    whole = [k for k, (_, n) in bands.items() if n <= sample]
    some = packed.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(_SCALE)) < share)
    start = _compared(query, some, beam)
    few = lambda c: F.when(F.col("band").isin(whole), F.col(c)).otherwise(F.slice(c, 1, min(STARTERS, beam)))

    def ranked(batch):
        out = [[], []]
        for ids, scores in zip(batch.column("ids").to_pylist(), batch.column("scores").to_pylist(), strict=True):
            a, b = _best(np.array(ids, np.int64), np.array(scores, np.float32), beam)
            out[0].append(a)
            out[1].append(b)
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("band"), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.float32()))],
                                         ["q", "band", "ids", "scores"])
    start = in_arrow(start, ranked, "q long, band int, ids array<long>, scores array<float>")
    state = written(_promising(written(start), bands, top).select("q", "band", few("ids").alias("ids"), few("scores").alias("scores"), F.array().cast("array<long>").alias("seen")))
    # The first candidates are those of the own node.
    met = query.join(graph, F.col("q") == F.col("node")).select("q", F.col("own").alias("band"), F.explode("ids").alias("c"))
    while True:
        old = state.select("q", F.explode("ids").alias("c"))
        met = met.where("q <> c").join(old, ["q", "c"], "left_anti")
        pairs = met.join(packed.select(F.col("node").alias("c"), "p"), "c").join(query, "q").select("q", "band", "c", "p", "qp")

        def scored(batch):
            # The query has no last component: the inner product with the node's own vector.
            x, y = _matrix(batch.column("p")), _matrix(batch.column("qp"))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("band"), batch.column("c"), pa.array((x * y).sum(axis=1), pa.float32())], ["q", "band", "c", "s"])
        fresh = in_arrow(pairs, scored, "q long, band int, c long, s float").groupBy("q", "band").agg(F.collect_list(F.struct("c", "s")).alias("l"))

        def merged(batch):
            out = [[], []]
            for ids, scores, c, s in zip(*(batch.column(k).to_pylist() for k in ("ids", "scores", "c", "s")), strict=True):
                a, b = _best(np.array(ids + (c or []), np.int64), np.array(scores + (s or []), np.float32), beam)
                out[0].append(a)
                out[1].append(b)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("band"), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.float32())),
                                              batch.column("seen")], ["q", "band", "ids", "scores", "seen"])
        both = state.join(fresh, ["q", "band"], "left").select("q", "band", "ids", "scores", "seen", F.col("l.c").alias("c"), F.col("l.s").alias("s"))
        state = written(in_arrow(both, merged, "q long, band int, ids array<long>, scores array<float>, seen array<long>"))
        # Nodes of the beam that were not expanded yet; whole bands need none.
        ask = written(state.where(~F.col("band").isin(whole)).select("q", "band", F.explode(F.array_except("ids", "seen")).alias("node")))
        if ask.isEmpty():
            break
        state = state.withColumn("seen", F.array_union("seen", "ids"))
        met = ask.join(graph.select("node", "ids"), "node").select("q", "band", F.explode("ids").alias("c")).distinct()
    return state.select("q", "ids")


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, sample: int = SAMPLE, **graph_options) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest found for the rows where ``is_query`` (of ``vec_id``) holds."""
    nodes, members, size = nodes_of(vectors, vec_id, vector)
    if not size:
        return members.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    graph, packed, bands = build_graph(nodes, size, small=sample, **graph_options)
    asked = written(members.where(is_query))
    found = greedy(graph, packed, bands, asked, sample=sample, top=top).select("q", F.explode(F.array_union("ids", F.array("q"))).alias("node"))
    alone = asked.select(F.col("node").alias("q"), "node").distinct()
    found = found.union(alone).distinct()
    pairs = found.join(nodes, "node").join(nodes.select(F.col("node").alias("q"), F.col("v").alias("w")), "q")

    def exact(batch):
        x, y = (np.stack(batch.column(k).to_numpy(zero_copy_only=False)).astype(np.float64) for k in ("v", "w"))
        with np.errstate(over="ignore", invalid="ignore"):
            s = (x * y).sum(axis=1)
            # Beyond double precision: infinite, with the sign of the scaled product.
            s = np.where(np.isfinite(s), s, np.inf * np.sign((_unit(x) * _unit(y)).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(s, pa.float64())], ["q", "node", "score"])
    scored = in_arrow(pairs, exact, "q long, node long, score double")
    # One more than asked of the smallest ids of a node is enough, as the query itself is left out.
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1).drop("r")
    each = scored.join(first, "node").groupBy("q").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "vec_id"))), 1, top + 1).alias("l"))
    mine = F.slice(F.filter("l", lambda x: x.vec_id != F.col("query_id")), 1, top)
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(each, "q").select(
        "query_id", F.posexplode(mine).alias("k", "x"))
    return out.select("query_id", (F.col("k") + 1).alias("rank"), "x.vec_id", (-F.col("x.n")).alias("score"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


register("op4_nn_descent", op4)
