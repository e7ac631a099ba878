"""URL filter by Bloom filter cascades: exact membership without joins.

Level 0 encodes the listed keys; level 1 encodes the other keys of the corpus that level 0 lets pass
by mistake; level 2 those of level 0's keys that level 1 lets pass, and so on until no mistake is
left. The first level that rejects a key decides: an even one says no, an odd one yes. As the keys
the levels were built over are all keys that the corpus holds, the answer is exact for each of its
urls. Only filters travel to the executors. The keys of a list are dealt by a hash into slices, so
that the filters of a slice stay within ``max_bytes``, and one pass over the urls reads one slice.

A rule (host, path) fits its host and all subdomains, where the url's path starts with the rule's;
the longest rule (host and path together) wins. Urls without a rule are blocked if their host is
listed: by default, hosts with one of ``LISTED_WORDS`` in a label.

Null urls and urls without ``://`` have an empty host and path, no rule, and are allowed. Repeated
rows are judged each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import bitset, has_bit, in_arrow, mix, table, written
from scorelake.llm.registry import register

BITS_PER_KEY = 8
HASHES = 5
MAX_BYTES = 64 << 20
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LISTED_WORDS = ("casino", "poker", "bets", "pills", "viagra", "xxx", "porn", "warez")


def split_url(url: Column | str = "url") -> tuple[Column, Column]:
    """Host and path as the module says."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions of keys (two 64-bit hashes each) at a level: one row per key."""
    with np.errstate(over="ignore"):
        a = mix(h1 + np.uint64(level * 0x9E3779B9 + 1))
        b = mix(h2 ^ np.uint64(level * 0x85EBCA6B + 7)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


Level = tuple[np.ndarray, int]


def passes(level: Level, h1: np.ndarray, h2: np.ndarray, k: int) -> np.ndarray:
    if not len(h1):
        return np.zeros(0, bool)
    return has_bit(level[0], places(h1, h2, k, level[1]).ravel()).reshape(-1, HASHES).all(axis=1)


def member(cascade: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.full(len(h1), (len(cascade) - 1) % 2 == 0)
    open_ = np.ones(len(h1), bool)
    for k, level in enumerate(cascade):
        here = np.flatnonzero(open_)
        fail = here[~passes(level, h1[here], h2[here], k)]
        out[fail] = k % 2 == 1
        open_[fail] = False
    return out if cascade else np.zeros(len(h1), bool)


def _hashes(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("h1").to_numpy().view(np.uint64), batch.column("h2").to_numpy().view(np.uint64)


def _encode(keys: DataFrame, n: int, k: int) -> Level:
    bits = max(64, n * BITS_PER_KEY)

    def run(batch):
        yield pa.RecordBatch.from_arrays([pa.array(places(*_hashes(batch), k, bits).ravel().view(np.int64))], ["p"])
    return bitset(in_arrow(keys, run, "p long"), bits), bits


def build(keys: DataFrame) -> list[Level]:
    """The cascade of ``keys``: distinct (h1, h2, listed), all keys that will ever be asked for."""
    spark = keys.sparkSession
    keys = written(keys)
    here, there = keys.where("listed").select("h1", "h2"), keys.where("not listed").select("h1", "h2")
    levels: list[Level] = []
    while n := here.count():
        level = _encode(here, n, len(levels))
        levels.append(level)
        shared, k = spark.sparkContext.broadcast(level), len(levels) - 1

        def run(batch, shared=shared, k=k):
            yield batch.filter(pa.array(passes(shared.value, *_hashes(batch), k)))
        # Next are encoded those of the other side that this level lets pass.
        here, there = written(in_arrow(there, run, "h1 long, h2 long")), here
    return levels


def _sliced(listed: int, max_bytes: int) -> int:
    """Slices such that the levels of one (less than twice the first) stay within the bound."""
    return max(1, -(-2 * listed * BITS_PER_KEY // (8 * max_bytes)))


def members(rows: DataFrame, keys: str, universe: DataFrame, name: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` with ``name``: for the array of strings ``keys``, which of them are listed.
    ``universe``: distinct (key, listed) with every key of ``rows`` and every listed key."""
    spark = rows.sparkSession
    hashed = written(universe.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("b"), "key").alias("h2"), "listed"))
    slices = _sliced(hashed.where("listed").count(), max_bytes)
    h = F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("b"), x).alias("h2")))
    out = rows.withColumn("__h", h).withColumn(name, F.transform(keys, lambda x: F.lit(False)))
    schema = out.schema
    for s in range(slices):
        cascade = spark.sparkContext.broadcast(build(hashed.where(F.pmod("h2", F.lit(slices)) == s)))

        def run(batches, s=s, cascade=cascade):
            for b in batches:
                col, old = b.column("__h"), b.column(name)
                pairs = col.flatten()
                h1, h2 = (pairs.field(k).to_numpy().view(np.uint64) for k in ("h1", "h2"))
                hit = old.flatten().to_numpy(zero_copy_only=False).astype(bool)
                mine = np.flatnonzero((h2.view(np.int64) % slices) == s)
                hit[mine] = member(cascade.value, h1[mine], h2[mine])
                lengths = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(hit))
                yield b.set_column(b.schema.get_field_index(name), name, lists)
        out = out.mapInArrow(run, schema)
        if slices > 1:
            out = written(out)
    return out.drop("__h")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          words: Sequence[str] = LISTED_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row."""
    spark = pages.sparkSession
    host, path = split_url(url)
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # Only suffixes and prefixes of the lengths that occur among the rules can be a rule.
    labels = sorted({len(h.split(".")) for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    parts = F.split("host", r"\.")
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    keys = F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes])) if rules else F.array().cast("array<string>")
    rows = base.withColumn("keys", F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))).withColumn("hosts", F.array("host"))
    # Everything the urls can ask for; aggregates are combined before the shuffle, so a hot host is no hot task.
    asked = rows.select(F.explode("keys").alias("key")).distinct()
    hosts = written(rows.groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    out = rows
    for action in ("block", "allow"):
        own = [h + p for a, h, p in rules if a == action]
        listed = spark.createDataFrame([(k, True) for k in own], "key string, listed boolean")
        universe = asked.select("key", F.lit(False).alias("listed")).union(listed).groupBy("key").agg(F.max("listed").alias("listed"))
        out = members(out, "keys", universe, action, max_bytes)
    bad = F.lit(False)
    for w in words:
        bad = bad | F.contains("key", F.lit(w))
    out = members(out, "hosts", hosts.select("key", bad.alias("listed")), "listed", max_bytes)
    fits = F.filter(F.transform(F.arrays_zip("keys", "block", "allow"), lambda x: F.struct(
        F.length(x["keys"]).alias("n"), x["keys"].alias("rule"), x.block.alias("block"), x.allow.alias("allow"))), lambda x: x.block | x.allow)
    best = F.array_max(fits)
    return out.select("page_id", "host", "path", best.rule.alias("rule"),
                      F.when(best.isNotNull(), F.when(best.block, "block").otherwise("allow"))
                      .otherwise(F.when(F.element_at("listed", 1), "block").otherwise("allow")).alias("verdict"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


SQL = r"""
WITH p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(a, h, s)),
best AS (SELECT page_id, host, path, arg_max(h || s, length(h || s)) AS rule, arg_max(a, length(h || s)) AS a
  FROM (SELECT DISTINCT p.*, r.* FROM p JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) GROUP BY 1, 2, 3)
SELECT p.page_id, p.host, p.path, rule,
  coalesce(a, CASE WHEN regexp_matches(p.host, 'casino|poker|bets|pills|viagra|xxx|porn|warez') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id, host, path)
"""

register("op3_url_cascade", op3, SQL)
