"""Ranked lexical search over bit-sliced Bloom signatures.

Each document is a Bloom filter of its terms. The filters of a block of documents of similar size are
stored by bit position: a slice holds one bit of every document of the block. The conjunction of a
term's slices marks the documents that may hold it; none that does is left out. A term that occurs
several times is entered once for each of ``LEVELS`` that its count reaches, so slices bound the count as well.

For a query the slices of its terms are summed with the terms' weights, level by level; each sum times
what a further occurrence can add to a document of that length bounds the score from above. A few documents
with the greatest bounds are scored exactly; the last of the best ``top`` is the mark. Every document whose
bound doesn't fall below the mark (a tie goes to the smaller id) is then scored exactly on its text.

All documents are indexed. Queries travel in passes of bounded size (``pass_bytes`` of text); per query a pass
sends to the driver its mark and the counts of its terms. Bit sets of a fixed size thin the texts that are read again.

Terms are compared by 64-bit hashes and byte lengths when documents are counted, by their bytes when they are scored. Nulls: a null text has
no terms; a null id ranks after all others of the same score. Repeated documents rank row by row. Queries without terms
give no rows; rows equal in id and text are one query, texts that share an id are ranked each on its own. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import LOWER, bitset, has_bit, mix, slices, table, word_hashes, word_spans, written
from scorelake.llm.registry import register

TOP = 20
#: Documents of each query that are scored for the mark.
SEEDS = 24
#: Bits and slices of an entry: about one entry in 300 is seen in a document that lacks it.
BITS, HASHES = 12, 6
#: Most documents of a block, and most bits of a block of more than eight.
DOCS, BLOCK_BITS = 512, 1 << 23
PASS_BYTES = 4 << 20
#: Bits of the set that thins the texts to be scored.
THIN = 1 << 26

#: Bytes that belong to no term.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

ID_LAST = np.iinfo(np.int64).max


#: The counts that have slices of their own: 1, 2, 3, 4, 6, 8, 12, 16, 24 ...
LEVELS = np.array(sorted({1} | {f << k for f in (2, 3) for k in range(30)}), np.int64)


def part(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences give for each unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length measure of documents of ``n`` terms."""
    if len(n) and int(n.max()) * 25 * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // max(terms, 1) for x in n], np.int64)
    return 75 + 25 * n * documents // max(terms, 1)


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows: first row, row after the last, terms per row, then for each distinct term of a row
    its row, hash, byte length and count."""
    for a, b, data, offsets in slices(column):
        starts, ends, first = word_spans(data, offsets, GAP)
        rows = np.repeat(np.arange(b - a), np.diff(first))
        h = word_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((h, rows))
        h, r, size = h[order], rows[order], (ends - starts)[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
        yield a, b, np.diff(first), r[at], h[at], size[at], np.diff(np.append(at, len(h)))


def positions(h: np.ndarray, lev: int | np.ndarray, rows: int) -> list[np.ndarray]:
    """The slices of entries."""
    h = mix(h + np.asarray(lev, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(rows)).astype(np.int64) for k in range(HASHES)]


INDEX = "band int, keys array<long>, ids array<long>, sizes array<long>, bits binary"


def _block(band: int, docs: list[tuple]) -> tuple:
    rows, width = BITS << band, -(-len(docs) // 8) * 8
    on = np.zeros(rows * width, bool)
    for j, (_, _, _, h, lev) in enumerate(docs):
        for p in positions(h, lev, rows):
            on[p * width + j] = True
    return band, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], np.packbits(on, bitorder="little").tobytes()


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)],
                                      ["band", "keys", "ids", "sizes", "bits"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("id", "text"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The signatures of all documents with a term, a row for each block: ``band`` (the filters have
    ``BITS << band`` slices), row keys, ids and numbers of terms of its documents, and the slices."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            keys, ids = batch.column("key").to_numpy(zero_copy_only=False), batch.column("id").to_pylist()
            for a, b, n, row, h, _, tf in term_counts(batch.column("text")):
                reach = np.searchsorted(LEVELS, tf, "right")
                of = np.repeat(np.arange(len(h)), reach)
                lev = np.arange(len(of)) - np.repeat(np.cumsum(reach) - reach, reach)
                cut = np.searchsorted(row[of], np.arange(b - a + 1))
                for j in range(b - a):
                    size = int(cut[j + 1] - cut[j])
                    if not size:
                        continue
                    band = (size - 1).bit_length()
                    block = held.setdefault(band, [])
                    here = slice(cut[j], cut[j + 1])
                    block.append((int(keys[a + j]), ids[a + j], int(n[j]), h[of[here]], lev[here]))
                    if len(block) >= max(8, min(DOCS, BLOCK_BITS // (BITS << band))):
                        yield _batch([_block(band, held.pop(band))])
        for band, block in held.items():
            yield _batch([_block(band, block)])
    return written(_keyed(docs, doc_id, text).mapInArrow(run, INDEX))


class Queries:
    """A pass of queries: their terms with numbers, and the terms of each query with counts."""

    def __init__(self, texts: list[str]):
        words = [Counter(terms(t)) for t in texts]
        self.terms = sorted({w for c in words for w in c})
        self.number = {w: i for i, w in enumerate(self.terms)}
        self.uses = [(np.array([self.number[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for c in words]
        data = np.frombuffer(b"".join(self.terms), np.uint8)
        self.sizes = np.array([len(w) for w in self.terms], np.int64)
        ends = np.cumsum(self.sizes)
        self.hashes = word_hashes(data, ends - self.sizes, ends)
        self.order = np.argsort(self.hashes)
        self.weights = np.zeros(len(self.terms), np.int64)
        self.documents = self.length = 0

    def known(self, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms of queries, and the numbers of these."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranked = self.hashes[self.order]
        at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        number = self.order[at]
        hit = np.flatnonzero((ranked[at] == h) & (self.sizes[number] == size))
        return hit, number[hit]


def terms(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), GAP)
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(starts, ends, strict=True)]


def _weigh(docs: DataFrame, q: Queries) -> None:
    """Counts over all documents: how many have terms, how many terms, how many hold each term of the queries."""
    sent = docs.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        own, n, length = sent.value, 0, 0
        df = np.zeros(len(own.terms), np.int64)
        for batch in batches:
            for _, _, sizes, _, h, size, _ in term_counts(batch.column("text")):
                n, length = n + int((sizes > 0).sum()), length + int(sizes.sum())
                df += np.bincount(own.known(h, size)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, length], df[some]]))], ["term", "n"])
    found = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    q.documents, q.length = int(found.pop(-2, 0)), int(found.pop(-1, 0))
    for t, df in found.items():
        q.weights[t] = math.floor(1000 * math.log((2 * q.documents + 2) / (2 * df + 1)))
    sent.destroy()


def bounds(row: dict, q: Queries) -> np.ndarray:
    """Upper bounds of the scores: a row for each query, a column for each document of the block."""
    slices_, docs = BITS << row["band"], len(row["ids"])
    bits = np.frombuffer(row["bits"], np.uint8).reshape(slices_, -1)
    m = norm(np.array(row["sizes"], np.int64), q.documents, q.length)
    out = np.zeros((len(q.uses), docs))
    live, before, i = np.flatnonzero(q.weights > 0), None, 0
    spot = np.full(len(q.terms), -1, np.int64)
    uses, given = q.uses, np.zeros(docs, np.int64)
    while len(live):
        on = None
        for p in positions(q.hashes[live], i, slices_):
            on = bits[p] if on is None else on & bits[p]
        if before is not None:
            on &= before
        some = on.any(axis=1)
        live, on = live[some], on[some]
        if not len(live):
            break
        spot[:] = -1
        spot[live] = np.arange(len(live))
        seen = np.unpackbits(on, axis=1, count=docs, bitorder="little").astype(float)
        now = part(LEVELS[i + 1] - 1, m)
        gain = (now - given).astype(float)
        for k, (t, c) in enumerate(uses):
            at = spot[t]
            here = at >= 0
            if here.any():
                out[k] += ((q.weights[t[here]] * c[here]).astype(float) @ seen[at[here]]) * gain
        given, before, i = now, on, i + 1
    return out


def _rows(query: list, key: list, id_: list, bound: list) -> pa.RecordBatch:
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    ids = cat(id_, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(query, np.int64)), pa.array(cat(key, np.int64)), pa.array(ids, mask=ids == ID_LAST),
                                       pa.array(cat(bound, np.int64))], ["query", "key", "id", "bound"])


FOUND = "query long, key long, id long, bound long"


def _ids(row: dict) -> np.ndarray:
    return np.array([ID_LAST if x is None else x for x in row["ids"]], np.int64)


def _seeds(index: DataFrame, sent, seeds: int) -> DataFrame:
    """Per query the documents with the greatest bounds."""
    def run(batches):
        q = sent.value
        best = None
        for batch in batches:
            for row in batch.to_pylist():
                got = bounds(row, q).astype(np.int64)
                docs = got.shape[1]
                here = [got, np.broadcast_to(np.array(row["keys"], np.int64), (len(got), docs)), np.broadcast_to(_ids(row), (len(got), docs))]
                best = here if best is None else [np.concatenate([x, y], axis=1) for x, y in zip(best, here, strict=True)]
                if best[0].shape[1] > seeds:
                    top = np.argpartition(-best[0], seeds - 1, axis=1)[:, :seeds]
                    best = [np.take_along_axis(x, top, axis=1) for x in best]
        if best is not None:
            k, j = np.nonzero(best[0] > 0)
            yield _rows([k], [best[1][k, j]], [best[2][k, j]], [best[0][k, j]])
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "key")
    return index.mapInArrow(run, FOUND).withColumn("n", F.row_number().over(w)).where(F.col("n") <= seeds).drop("n")


def _open(index: DataFrame, sent, marks) -> DataFrame:
    """The documents that the marks don't exclude."""
    def run(batches):
        q, (score, last) = sent.value, marks.value
        for batch in batches:
            for row in batch.to_pylist():
                got, ids, keys = bounds(row, q).astype(np.int64), _ids(row), np.array(row["keys"], np.int64)
                k, j = np.nonzero((got > 0) & ((got > score[:, None]) | ((got == score[:, None]) & (ids[None, :] <= last[:, None]))))
                if len(k):
                    yield _rows([k], [keys[j]], [ids[j]], [got[k, j]])
    return index.mapInArrow(run, FOUND)


def _scored(docs: DataFrame, found: DataFrame, sent) -> DataFrame:
    """(query, id, score) of the found documents, from their texts."""
    spark = docs.sparkSession
    wanted = found.groupBy("key").agg(F.collect_set("query").alias("queries"))
    bits = spark.sparkContext.broadcast(bitset(found.select(F.pmod("key", F.lit(THIN)).alias("p")).distinct(), THIN))

    def near(batches):
        for batch in batches:
            hit = has_bit(bits.value, batch.column("key").to_numpy() % THIN)
            if hit.any():
                yield batch.filter(pa.array(hit))

    def run(batches):
        q = sent.value
        worth = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            query, id_, score = [], [], []
            for t, i, queries in zip(batch.column("text"), batch.column("id").to_pylist(), batch.column("queries").to_pylist(), strict=True):
                words = terms(t.as_py())
                m = norm(np.array([len(words)], np.int64), q.documents, q.length)[0]
                own = [(q.number[w], c) for w, c in Counter(words).items() if w in q.number]
                at, tf = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 2
                worth[at] = q.weights[at] * part(tf, m)
                for k in queries:
                    t_, c = q.uses[k]
                    query.append(k)
                    id_.append(i)
                    score.append(int((worth[t_] * c).sum()))
                worth[at] = 0
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(id_, pa.int64()), pa.array(score, pa.int64())], ["query", "id", "score"])
    return docs.mapInArrow(near, docs.schema).join(wanted, "key").select("id", "text", "queries").mapInArrow(run, "query long, id long, score long").where("score > 0")


def _best(scored: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", pass_bytes: int = PASS_BYTES, seeds: int = SEEDS, index: DataFrame | None = None) -> DataFrame:
    """The ``top`` documents of each query: item_id, rank, doc_id, score. ``index`` is that of ``build_index``."""
    spark = docs.sparkSession
    rows = _keyed(docs, doc_id, text)
    index = build_index(docs, doc_id, text) if index is None else index
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    passes = max(1, -(-(asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // pass_bytes))
    seeds, out = max(seeds, top), None
    for k in range(passes):
        # Texts are equal only if their hashes are, so a pass holds whole queries; its bytes are about pass_bytes.
        own = asked.where(F.pmod(F.xxhash64("t", "item_id"), F.lit(passes)) == k).collect()
        q = Queries([r.t for r in own])
        _weigh(rows, q)
        sent = spark.sparkContext.broadcast(q)
        first = written(_seeds(index, sent, seeds))
        score, last = np.zeros(len(own), np.int64), np.full(len(own), ID_LAST, np.int64)
        for r in _best(_scored(rows, first, sent), top).where(F.col("rank") == top).collect():  # a row for each query of the pass
            score[r.query], last[r.query] = r.score, ID_LAST if r.id is None else r.id
        marks = spark.sparkContext.broadcast((score, last))
        open_ = written(_open(index, sent, marks))
        best = written(_best(_scored(rows, open_, sent), top))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"query long, item_id {dict(asked.dtypes)['item_id']}")
        got = best.join(F.broadcast(names), "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")  # the queries of one pass
        out = got if out is None else out.union(got)
        sent.destroy()
        marks.destroy()
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS item_no, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
       FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_no, item_id, t, count(*) AS c FROM (SELECT item_no, item_id, unnest(w) AS t FROM iw) GROUP BY ALL),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM dw WHERE len(w) > 0),
tf AS (SELECT row_no, t, count(*) AS tf FROM (SELECT row_no, unnest(w) AS t FROM dw) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT t, count(*) AS df FROM tf GROUP BY 1), total),
parts AS (SELECT row_no, t, weight.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(dw.w) * docs) // terms))) AS p
          FROM tf JOIN weight USING (t) JOIN dw USING (row_no), total),
scored AS (SELECT item_no, item_id, row_no, CAST(sum(c * p) AS BIGINT) AS score FROM asked JOIN parts USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored JOIN dw USING (row_no) WHERE score > 0)
WHERE rank <= 20
"""

register("op11_bitsliced_search", op11, SQL)
