"""Exact n-gram Jaccard join (grouped prefix join), and the classes its links make.

A document's set is that of the hashes (64 bits) of its distinct 5-word shingles. Sets are ordered
by one order for all documents (rare ones first; shingles are counted in all documents, by the first half of their hash, and those
found most often are put last, the most frequent ones at the very end), and two sets as similar as asked share one of their first few elements. Documents
with equal sets are one node; nodes with equal size and prefix make one group, and only groups meet.

Large groups of near copies would meet in all pairs. So the join runs in turns. In each of the first
ones, every bucket of the prefixes names a pivot, another one in each turn, and a group is verified against its best pivot
of another class; what is found linked is one class from then on. Turns
go on while they find more than a fiftieth of the links of the first one, each on the buckets that still hold groups of different
classes: classes only grow, so no other bucket can give a link again. The last turn takes every remaining pair of
groups that holds nodes of different classes, so no link between classes is lost, while links inside
a class need no pair. Size, position in the prefix, and marks of the elements (whether an odd number of them falls on a bit), whose
differing bits bound the symmetric difference from below, leave few pairs, which are verified on the texts.

Nulls and texts without words have empty sets and link with nothing. Repeated document ids: each row
is read, each different set of it is a node of its own, and links of any of them count for the id; ``n_shingles`` is given per row. A null id links with nothing and
is its own component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import (
    LOWER, apart, few, gram_hashes, in_arrow, mix, slices, small_batches, table, word_hashes, word_spans, written,
)
from scorelake.llm.components import components
from scorelake.llm.registry import register

N = 5
NUM, DEN = 3, 4
#: Frequent shingles that get their own place in the order at most. It changes the work, not the result.
KEEP = 1 << 20
#: Shingles are counted by the first half of their hash: ``PARTS`` parts of 64 fine ones, 16 bits in each. Shingles that a task sorts at once.
PARTS, RUN = 1 << 10, 1 << 18
HALF = np.uint64(32)
#: Shingles that a task gives out at once.
BATCH = 1 << 17
#: Bytes of text that are hashed at once; the arrays made of them are eight times as large.
STEP = 1 << 18
#: Bits of the filter that thins the texts to be moved for verification (2 MB, whatever the input).
FILTER_BITS = 1 << 24


def shingle_sets(column: pa.Array, n: int = N):
    """The set of each row, as sorted distinct hashes."""
    for _, _, data, offsets in slices(column, STEP):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, n)
        for k in range(len(offsets) - 1):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield words[:0]


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Sets of at least ``num / den`` similarity share one of so many first elements."""
    return n - -(-n * num // den) + 1 if n else 0


def _held(items: Iterable, size: Callable, most: int = BATCH) -> Iterator[list]:
    """Runs of items of ``most`` shingles or a little more."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def _packed(halves: np.ndarray) -> pa.RecordBatch:
    """Ascending half hashes, a row for each part that has some: how many are in each fine part, in bytes or (``wide``) words, and their last 16 bits."""
    at = np.searchsorted(halves, (np.arange(1, PARTS * 64, dtype=np.uint32) << np.uint32(16)))
    fine = np.diff(at, prepend=0, append=len(halves)).reshape(PARTS, 64)
    ends = np.cumsum(fine.sum(axis=1))
    low = halves.astype(np.uint16)
    some, wide = np.flatnonzero(fine.any(axis=1)), fine.max(axis=1) > 255
    return pa.RecordBatch.from_arrays([
        pa.array(some, pa.int32()), pa.array(wide[some]),
        pa.array([fine[p].astype(np.uint32 if wide[p] else np.uint8).tobytes() for p in some], pa.binary()),
        pa.array([low[ends[p] - fine[p].sum():ends[p]].tobytes() for p in some], pa.binary())], ["part", "wide", "fine", "low"])


def _most(part: int, counts: np.ndarray, most: int) -> pa.RecordBatch:
    """The half hashes of a part that were counted twice or more, from the greatest count down as far as they are at most ``most``."""
    at = np.flatnonzero(counts > 1)
    if len(at) > most:
        at = at[counts[at] > np.partition(counts[at], len(at) - most - 1)[len(at) - most - 1]]
    return pa.RecordBatch.from_arrays([pa.array((part << 22) + at, pa.int64()), pa.array(counts[at].astype(np.int64))], ["half", "n"])


def frequent_shingles(docs: DataFrame, n: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """First halves of the hashes of shingles found twice or more in all documents, as hashes that end in zeros, at most
    ``keep`` of them, ascending, with the number of documents. Shingles that share them are counted as one."""
    def halves(batches):
        for sets in _held((s for batch in batches for s in shingle_sets(batch.column("text"), n)), len, RUN):
            yield _packed(np.sort((np.concatenate(sets) >> HALF).astype(np.uint32)))

    def count(batches):  # the rows of a part follow each other
        part, counts = None, np.zeros(1 << 22, np.uint32)
        for batch in batches:
            for p, wide, fine, low in zip(*(batch.column(c).to_pylist() for c in ("part", "wide", "fine", "low")), strict=True):
                if p != part:
                    if part is not None:
                        yield _most(part, counts, most)
                        counts.fill(0)
                    part = p
                places = np.repeat(np.arange(64) << 16, np.frombuffer(fine, np.uint32 if wide else np.uint8)) + np.frombuffer(low, np.uint16)
                first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
                counts[places[first]] += np.diff(np.append(first, len(places))).astype(np.uint32)
        if part is not None:
            yield _most(part, counts, most)
    # A part gives out eight times what it has of the ``keep`` most frequent on average, so the table does not grow with the input.
    most = max(1 << 12, 8 * keep // PARTS)
    packed = docs.where(F.col("id").isNotNull()).select("text").mapInArrow(halves, "part int, wide boolean, fine binary, low binary")
    found = written(packed.repartition("part").sortWithinPartitions("part").mapInArrow(count, "half long, n long"))
    held, least = 0, 2
    # From the greatest count down, as far as they are at most ``keep``; counts from 4096 on are one step.
    for times, tokens in sorted(found.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count(F.lit(1)).alias("tokens")).collect(), reverse=True):
        held += tokens
        if held > keep:
            least = times + 1
            break
    rows = found.where(F.col("n") >= least).toArrow()
    keys, counts = rows.column("half").to_numpy().astype(np.uint64) << HALF, rows.column("n").to_numpy()
    at = np.argsort(keys)
    return keys[at], counts[at]


def _odd(places: np.ndarray, bits: int) -> bytes:
    """The bits on which an odd number of elements falls."""
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """Marks of the elements in 2 to 4 bits an element, 64 to 8192 bits in all."""
    bits = min(8192, max(64, 1 << (2 * len(s) - 1).bit_length())) if len(s) else 64
    return _odd(s & np.uint64(bits - 1), bits)


def marks(s: np.ndarray) -> list[int]:
    """1024 marks of the elements, as 16 numbers that Spark can compare while it joins."""
    return np.frombuffer(_odd(s >> np.uint64(20) & np.uint64(1023), 1024), np.int64).tolist()


def fewest_differences(a: bytes, b: bytes) -> int:
    """Sets with these bitmaps differ in so many elements at least."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _bits_of(keys: np.ndarray) -> np.ndarray:
    """A filter of 2 MB for ascending keys, by their first 24 bits: it spares most other elements the search."""
    filled = np.zeros(1 << 21, np.uint8)
    if len(keys):
        byte = (keys >> np.uint64(43)).astype(np.int64)
        first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        bit = np.uint8(1) << (keys >> np.uint64(40) & np.uint64(7)).astype(np.uint8)
        filled[byte[first]] = np.bitwise_or.reduceat(bit, first)
    return filled


def _ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray, filled: np.ndarray, left: np.uint64 = np.uint64(0)) -> np.ndarray:
    """The elements (ascending), frequent ones last by rank, then by their hash. ``hot`` has hashes whose last ``left`` bits are left out, as zeros."""
    some = np.flatnonzero(filled[(s >> np.uint64(43)).astype(np.int64)] >> (s >> np.uint64(40) & np.uint64(7)).astype(np.uint8) & np.uint8(1))
    if not len(some):
        return s
    asked = s[some] >> left << left
    at = np.minimum(np.searchsorted(hot, asked), len(hot) - 1)
    found = hot[at] == asked
    some, at = some[found], at[found]
    common = np.zeros(len(s), bool)
    common[some] = True
    return np.concatenate([s[~common], s[some][np.argsort(rank[at], kind="stable")]])


MARKS = [f"m{k}" for k in range(16)]
SKETCH = f"id long, size int, s1 long, s2 long, g long, bits binary, {', '.join(f'{m} long' for m in MARKS)}, prefix array<long>"
#: Sets that a task remembers, so that it sends the prefix of copies once.
REMEMBERED = 1 << 17


def _one(s: np.ndarray, size: int) -> int:
    """A sum of mixed elements: equal for equal sets, whatever their order."""
    return int(mix(s + np.uint64(size)).sum(dtype=np.uint64).view(np.int64))


def _two(s: np.ndarray, size: int) -> tuple[int, int]:
    """Two such sums."""
    return _one(s, size), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame, order, n: int, num: int, den: int) -> DataFrame:
    """Per row its id, size and hashes of the set, its group (a hash of size and prefix), marks, and the prefix: once
    for the rows of a group that a task remembers, null for the others, for null ids and empty sets."""
    def run(batches):
        ranked = order.value
        sent: set[int] = set()

        def rows(batch):
            for i, s in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                size = len(s)
                p = _ordered(s, *ranked)[:prefix_length(size, num, den)]
                g = _one(p, size)
                first = i is not None and size > 0 and g not in sent
                if first:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(g)
                yield i, size, *_two(s, size), g, bitmap(s), *marks(s), p.view(np.int64) if first else None
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * len(MARKS), pa.list_(pa.int64())]
        for held in _held((x for batch in batches for x in rows(batch)), lambda x: 64 + (0 if x[-1] is None else len(x[-1]))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)],
                                             ["id", "size", "s1", "s2", "g", "bits", *MARKS, "prefix"])
    return docs.mapInArrow(run, SKETCH)


def _entries(rows: DataFrame) -> DataFrame:
    """The prefixes of the groups: token, group, and size and place in one number."""
    return (rows.where("prefix is not null").select("g", "size", F.posexplode("prefix").alias("pos", "token"))
            .select("token", "g", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")).alias("at")))


def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Common elements that sets of these sizes need at least."""
    return F.ceil((a + b) * F.lit(num) / F.lit(num + den))


def _possible(num: int, den: int) -> Column:
    """Sizes, and the places of a common element, allow the similarity. For the first common element
    of two similar sets it always holds."""
    a, b = F.col("size_a"), F.col("size_b")
    rest = F.least(a - F.col("pos_a"), b - F.col("pos_b"))
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (rest * F.lit(num + den) >= (a + b) * num)


def _alike(num: int, den: int) -> Column:
    """The marks leave the similarity possible: every mark that differs is an element that differs."""
    differ = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS), F.lit(0))
    return differ * F.lit(num + den) <= (F.col("size_a") + F.col("size_b")) * F.lit(den - num)


def _one_class() -> Column:
    """All nodes of both groups are of one class."""
    return (F.col("c0_a") == F.col("c1_a")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0_a") == F.col("c0_b"))


def _pruned(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps leave possible."""
    m, rows = sizes.select("node", "size", "bits"), pairs.count()
    both = few(few(pairs.join(m.toDF("a", "size_a", "bits_a"), "a"), rows).join(m.toDF("b", "size_b", "bits_b"), "b"), rows)

    def run(batch):
        keep = [fewest_differences(x, y) * (num + den) <= (p + q) * (den - num) for x, y, p, q in zip(
            batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(),
            batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep))
    return in_arrow(both, run, "a long, b long")


def _texts(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Texts of the nodes that occur in pairs. A filter of fixed size, in numbers of 64 bits, keeps most others from being moved."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    filled = places.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("filled"))
    found = (docs.select("id", "text", place.alias("p")).withColumn("w", F.shiftright("p", 6)).join(F.broadcast(filled), "w")
             .where(F.col("filled").bitwiseAND(bit) != 0).select("id", "text").join(places, "id"))
    if places.where("several").isEmpty():
        return found.select("node", "text")

    def own(batch):
        # An id with several sets: the text must have the node's.
        keep = [not several or _two(s, len(s)) == (s1, s2) for several, s1, s2, s in zip(
            *(batch.column(c).to_pylist() for c in ("several", "s1", "s2")), shingle_sets(batch.column("text"), n), strict=True)]
        yield batch.select(["node", "text"]).filter(pa.array(keep))
    return in_arrow(found, own, "node long, text string")


def _verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those pairs whose texts are as similar as asked, as a written table."""
    rows = 2 * pairs.count()
    nodes = written(few(few(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows).join(places, "node"), rows))
    texts = written(_texts(docs, nodes, n))  # read for both sides
    both = (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b"))

    def run(batch):
        keep = []
        # One pair's sets at a time: those of a whole batch of long texts are many times its size.
        for x, y in zip(*(shingle_sets(batch.column(c), n) for c in ("text_a", "text_b")), strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * common >= num * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep))
    return written(in_arrow(both, run, "a long, b long"))


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` after these links. Only distinct pairs of classes go into the search for components."""
    rows = links.count()
    if label is None:
        return written(components(links, rows))
    ends, nodes = links, label.count() + 2 * rows
    for x in "ab":
        ends = few(ends.join(label.toDF(x, f"{x}_class"), x, "left").withColumn(x, F.coalesce(f"{x}_class", x)).drop(f"{x}_class"), rows)
    top = written(components(ends.select("a", "b").where("a <> b").distinct(), rows))
    old = (label.join(top.toDF("component", "higher"), "component", "left")
           .select("node", F.coalesce("higher", "component").alias("component")))
    return written(few(old.union(top.join(label, "node", "left_anti").select("node", "component")), nodes))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N,
                    num: int = NUM, den: int = DEN, keep: int = KEEP) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        return _classes(docs, n, num, den, keep)


def _classes(docs: DataFrame, n: int, num: int, den: int, keep: int) -> DataFrame:
    """The same. Whatever reads texts is run here; the result only joins what it found."""
    keys, counts = frequent_shingles(docs, n, keep)
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, counts))] = np.arange(len(keys))
    order = docs.sparkSession.sparkContext.broadcast((keys, rank, _bits_of(keys), HALF))
    all_rows = written(sketches(docs, order, n, num, den))
    order.destroy()
    held = all_rows.count()
    rows = all_rows.where("size > 0 and id is not null")
    # One node for each different set: a number. Its text is found by the lowest id that has the set.
    nodes = written(few(rows.groupBy("s1", "s2").agg(F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), held))
    member = written(few(few(rows.select("id", "s1", "s2").distinct(), held).join(nodes, ["s1", "s2"]).select("id", "node", "first"), held))
    several = member.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
    places = written(few(nodes.withColumnRenamed("first", "id").join(several, "id", "left").select(
        "node", "id", "s1", "s2", F.coalesce("several", F.lit(False)).alias("several")), held))
    sizes = few(rows.drop("prefix").join(places.select("id", "s1", "s2", "node"), ["id", "s1", "s2"]).drop("id", "s1", "s2"), held)
    sizes = written(few(sizes.dropDuplicates(["node"]), held))
    # Groups with their lowest node, and its marks.
    groups = sizes.groupBy("g").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members"))
    of_group = written(few(sizes.select("node", "g").join(groups, "g"), held))
    leads = written(few(of_group.where("node = lead").select("node", "lead").join(sizes.select("node", "g", "size", *MARKS), "node").drop("node"), held))
    entries = _entries(rows).repartition("token")
    # All columns are read here too, so that the plan sends the entries once and reads them for both sides.
    shared = (entries.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.max("at").alias("last"))
              .where("low < high and last is not null").select("token"))
    buckets = written(entries.join(shared, "token").dropDuplicates(["token", "g"]).select(
        "token", "g", F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"), F.shiftright("at", 32).cast("int").alias("size")))

    label, turn, first, found = None, 0, 0, 1
    while found * 50 > first:
        drawn = _drawn(turn, buckets, of_group, label)
        if turn:  # in the first turn all buckets are open
            drawn = written(few(drawn, buckets.count()))
            buckets = drawn.select(*buckets.columns)
        pairs = few(_near(turn, drawn, of_group, leads.select("g", "lead"), num, den), 2 * held)
        good = _verified(written(_pruned(written(pairs), sizes, num, den)), docs, places, n, num, den)
        label, found = _merged(label, good), good.count()
        first, turn = first or found, turn + 1
    pairs = _rest(buckets, of_group, leads, label, num, den)
    label = _merged(label, _verified(written(_pruned(written(pairs), sizes, num, den)), docs, places, n, num, den))
    # From nodes to documents; an id with several sets ties their classes.
    ids = places.select("node", "id")
    tied = few(label.join(ids.toDF("node", "a"), "node"), held).join(ids.toDF("component", "b"), "component").select("a", "b")
    final = components(tied.union(member.where("id <> first").select("id", "first")), 2 * held).toDF("id", "component_id")
    return (all_rows.select("id", "size").join(final, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id")))


def _labelled(of_group: DataFrame, label: DataFrame | None) -> DataFrame:
    """Nodes with their group and class. Without labels each node is a class of its own."""
    if label is None:
        return of_group.select("node", "g", "members", F.col("node").alias("c"))
    return of_group.join(label, "node", "left").select("node", "g", "members", F.coalesce("component", "node").alias("c"))


def _inside(buckets: DataFrame, of_group: DataFrame, label: DataFrame | None) -> DataFrame:
    """The buckets with the lowest and highest class of each group, and whether it has several members."""
    span = _labelled(of_group, label).groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), (F.max("members") > 1).alias("many"))
    return few(buckets.join(span, "g").select("token", "g", "pos", "size", "c0", "c1", "many"), buckets.count()).repartition("token")


def _drawn(turn: int, buckets: DataFrame, of_group: DataFrame, label: DataFrame | None) -> DataFrame:
    """The buckets with groups of different classes, and the pivot ``p`` of each."""
    inside = _inside(buckets, of_group, label)
    # The pivot is lowest by a hash of the group, another one in each turn, so buckets with common groups have common pivots.
    drawn = F.min(F.struct(F.xxhash64("g", F.lit(turn)).alias("h"), "g", "pos", "size", "c0", "c1", "many")).alias("p")
    pivots = inside.groupBy("token").agg(F.min("c0").alias("x"), F.max("c1").alias("y"), drawn).where("x < y").select("token", "p")
    return inside.join(pivots, "token")


def _near(turn: int, drawn: DataFrame, of_group: DataFrame, leads: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes, a below b: the lowest node of a group and that of its best pivot, the one of
    another class with which it shares most of its prefix."""
    cols, groups = ("g", "pos", "size", "c0", "c1"), leads.count()
    best = (drawn.select(*[F.col(c).alias(f"{c}_a") for c in cols], *[F.col(f"p.{c}").alias(f"{c}_b") for c in cols])
            .where((F.col("g_a") != F.col("g_b")) & _possible(num, den) & ~_one_class())
            .groupBy("g_a", "g_b").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("g_a").agg(F.max(F.struct("n", "g_b")).alias("best")).select("g_a", "best.g_b"))
    pairs = few(few(best.join(leads.toDF("g_a", "a"), "g_a"), groups).join(leads.toDF("g_b", "b"), "g_b").select("a", "b"), groups)
    if not turn:
        pairs = pairs.union(of_group.where("node <> lead").select("node", "lead"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(buckets: DataFrame, of_group: DataFrame, leads: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different classes, a below b: all that can still be linked."""
    labelled = written(few(_labelled(of_group, label), of_group.count()))
    cols = ("g", "pos", "size", "c0", "c1", "many", *MARKS)
    inside = _inside(buckets, of_group, label)
    # All columns are read on both sides, as above.
    mixed = (inside.groupBy("token").agg(F.min("c0").alias("x"), F.max("c1").alias("y"), *[F.max(c).alias(c) for c in ("g", "pos", "size", "many")])
             .where("x < y and g is not null and pos is not null and size is not null and many is not null").select("token"))
    # A group with several members is compared without marks: they are those of one member.
    open_ = few(inside.join(mixed, "token").join(leads.select("g", *MARKS), "g"), buckets.count())
    a, b = (open_.select("token", *[F.col(c).alias(f"{c}_{x}") for c in cols]) for x in "ab")
    met = (a.join(b, "token").where((F.col("g_a") < F.col("g_b")) & _possible(num, den)
                                    & (F.col("many_a") | F.col("many_b") | _alike(num, den)) & ~_one_class())
           .select("g_a", "g_b").distinct())
    span = labelled.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    mixed_groups = span.where("c0 < c1").select(F.col("g").alias("g_a"), F.col("g").alias("g_b"))
    x = labelled.select(F.col("g").alias("g_a"), F.col("node").alias("x"), F.col("c").alias("cx"))
    y = labelled.select(F.col("g").alias("g_b"), F.col("node").alias("y"), F.col("c").alias("cy"))
    out = met.union(mixed_groups).join(x, "g_a").join(y, "g_b").where("cx <> cy")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


@apart("doc_id", "text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the lowest id. Repeated rows of an id stay together."""
    classes = jaccard_classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') || '#' || least(5, len(w)) AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (WITH RECURSIVE r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b) SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = w.doc_id
"""

register("op7_ngram_jaccard", op7, SQL)
