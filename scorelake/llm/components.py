"""Connected components of a link table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import few, written


def _large(e: DataFrame, rows: int) -> DataFrame:
    """Every neighbour above a node is linked to the lowest of its neighbourhood instead."""
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = (both.where("b > a").join(low, "a").select(F.col("b").alias("x"), "m")
           .where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")))
    return few(few(out, rows).distinct(), rows)


def _small(e: DataFrame, rows: int) -> DataFrame:
    """Every node and its neighbours below it are linked to the lowest of these."""
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    down = e.join(low, "b").select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m")
    return few(few(down.select(F.col("m").alias("a"), F.col("x").alias("b")), rows).distinct(), rows)


def components(links: DataFrame, rows: int) -> DataFrame:
    """``links``: about ``rows`` pairs (a, b) of nodes in any order. Result: one row per linked node, ``node`` and
    ``component`` (its lowest node). The aggregates are combined before the shuffle and the joins are
    plain equi-joins, so a node with very many links is dealt out; rounds go on until nothing changes.
    Nulls and self-links link nothing; repeated links count once."""
    e = few(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), rows)
    e = written(few(e.distinct(), rows))
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(e)
    while before[0]:
        e = written(_small(_large(e, before[0]), before[0]))
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        few(e.select("a", "a").distinct(), before[0]).toDF("node", "component"))
