"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of 13 consecutive words of a benchmark item (an item of fewer words is one
pattern). Patterns of one length are searched together. A block of words at the end of the text
window looks up how far the window can move before any pattern could end there; at a shift of zero
the block picks a bucket of patterns, which are compared word by word with the text.

The patterns travel to the executors in passes of bounded size (``pass_bytes`` of item text); each
pass carries what the earlier ones found in every row, so no join or shuffle of the documents is
needed however large the benchmark is.

Nulls: a null text has no words; a benchmark row without words gives no pattern; a null item id
still marks words but is not counted or listed. Repeated item ids count once. Repeated documents are
judged row by row. Other columns of both tables are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import apart, sha256, table, written
from scorelake.llm.registry import register

#: Bytes of UTF-8: every byte of a character outside ASCII belongs to a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
BLOCK = 2
PASS_BYTES = 8 << 20


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Patterns of ``length`` words each, as tuples of words, with the ids that own them."""

    def __init__(self, length: int, patterns: dict[tuple, set[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p, ids in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block:end] if self.block > 1 else p[end - 1]
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.buckets[b].append((p, tuple(ids)))

    def find(self, text: list[bytes]) -> Iterable[tuple[int, tuple]]:
        """Start and ids of every occurrence."""
        shift, far, n, length = self.shift.get, self.far, len(text), self.length
        pair = self.block > 1
        end = length - 1
        while end < n:
            b = (text[end - 1], text[end]) if pair else text[end]
            move = shift(b, far)
            if move:
                end += move
                continue
            start = end - length + 1
            there = tuple(text[start:end + 1])
            for p, ids in self.buckets[b]:
                if p == there:
                    yield start, ids
            end += 1


def compile_patterns(items: Iterable[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            by_length[k][tuple(w[i:i + k])].add(item_id)
    return [WuManber(k, dict(p)) for k, p in sorted(by_length.items())]


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SEARCHED = "n_words long, hits array<struct<start:int,stop:int>>, items array<long>"


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
           item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (spans of words inside an occurrence of a benchmark
    window, merged) and ``items`` (ids of the items with an occurring window, ascending)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<start:int,stop:int>>").alias("hits"),
                      F.array().cast("array<long>").alias("items"))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k).collect()
        out = _one_pass(out, text, spark.sparkContext.broadcast(compile_patterns([(r.i, r.t) for r in rows], window)))
        if passes > 1:
            out = written(out)
    return out


def _one_pass(df: DataFrame, text: str, patterns) -> DataFrame:
    def run(batches):
        matchers = patterns.value
        for batch in batches:
            counts, hits, found = [], [], []
            before = batch.column("hits").to_pylist()
            earlier = batch.column("items").to_pylist()
            for k, t in enumerate(batch.column(text)):
                w = words(t.as_py())
                spans, ids = [(s["start"], s["stop"]) for s in before[k]], set(earlier[k])
                for m in matchers:
                    for start, owners in m.find(w):
                        spans.append((start, start + m.length))
                        ids.update(owners)
                counts.append(len(w))
                hits.append([{"start": a, "stop": b} for a, b in join_spans(spans)])
                ids.discard(None)
                found.append(sorted(ids))
            for name, values, kind in (("n_words", counts, pa.int64()), ("hits", hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                                       ("items", found, pa.list_(pa.int64()))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, kind))
            yield batch
    return df.mapInArrow(run, df.schema)


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)


def contaminated() -> F.Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return search(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


@apart("doc_id", "text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    found = search(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~contaminated()).select(*docs.columns)


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM bw WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT k FROM patterns),
windows AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw JOIN lengths ON len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM windows JOIN patterns USING (k, p)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

register("op2_decontaminate", op2, SQL)
