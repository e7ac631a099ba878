"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

The share of a source's tokens in all tokens is raised to an exponent and normalised. The exponent is
bisected (32 parts at a time, each round one aggregate over the sources) until the weights have a
target entropy, or until no source is repeated more often than a limit allows. A weight times the
token budget is what the source gives: whole epochs, and a part of one more. An epoch is a permutation of
the source's documents in blocks: a hash of epoch and document orders them, its leading bits are
the block. What of the last epoch fits the budget is found block by block: sums per block, the block in which
the budget ends, sums of the blocks in that, until few documents are left to be ordered. No step orders or gathers a source.

A null source is a source of its own. Empty documents have no tokens and cost nothing; null texts count
as empty. Rows with equal source and doc_id (null too) move together. A source without tokens has no weight.
Ties of the hash are settled by doc_id. An empty table gives no rows. Extra columns pass through the stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import apart, table, written
from scorelake.llm.registry import register

#: Production setting: as flat as possible, while no document is used more than three times.
BUDGET = 1.0
MAX_REPEATS = 3.0
#: Documents of the last block that are ordered one by one; 1024 blocks at each level.
LAST_BLOCK = 256
BITS = 10

WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _solve(sources: DataFrame, value, target: float, rising: bool, low: float = 0.0, high: float = 1.0) -> float:
    """The exponent between ``low`` and ``high`` at which ``value(a)`` (an aggregate) meets the target."""
    for _ in range(7):
        steps = [low + (high - low) * k / 32 for k in range(33)]
        got = sources.agg(*[value(a).alias(f"v{k}") for k, a in enumerate(steps)]).first()
        k = next((k for k in range(1, 33) if (got[k] >= target) == rising), 32)
        low, high = steps[k - 1], steps[k]
    return high


def weights(sources: DataFrame, budget: float, entropy: float | None = None, max_repeats: float | None = None) -> DataFrame:
    """``sources`` (source, tokens) with ``weight``, ``exponent`` and ``goal`` (tokens to give).
    ``budget`` in tokens; ``entropy`` as a share of the greatest possible."""
    total = sources.agg(F.sum("tokens"), F.count(F.when(F.col("tokens") > 0, 1)), F.min(F.when(F.col("tokens") > 0, F.col("tokens")))).first()
    all_tokens, n, least = total[0] or 0, total[1] or 0, total[2] or 0
    some = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(all_tokens, 1)))).alias("p"))
    exponent = 1.0
    if n > 1 and entropy is not None:
        def value(a: float) -> Column:
            s, t = F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p"))
            return F.log(s) - a * t / s
        exponent = _solve(some, value, entropy * math.log(n), rising=False, high=64.0)
    elif n > 1 and max_repeats is not None:
        p = least / all_tokens

        def value(a: float) -> Column:  # repeats of the smallest source
            return F.lit(p ** (a - 1) * budget / all_tokens) / F.sum(F.pow("p", F.lit(a)))
        flat = p ** -1 * budget / all_tokens / n
        exponent = 0.0 if flat <= max_repeats else _solve(some, lambda a: -value(a), -max_repeats, rising=True)
    scale = some.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(all_tokens, 1))), F.lit(exponent)) / F.lit(scale)).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumn("exponent", F.lit(exponent)).withColumn("goal", F.floor(F.col("weight") * budget).cast("long"))


def _place(epoch: Column) -> Column:
    """A document's place in the permutation of an epoch, 0 to 2**60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(epoch, "source_key", "doc_id"), 4)


def _cuts(units: DataFrame, plan: DataFrame, last_block: int) -> DataFrame:
    """Per source the last (place, doc_id) that fits what the last epoch may give; null place if nothing does."""
    open_ = plan.select("source_key", F.col("part").alias("room"), "epochs").where("room > 0")
    rows = written(units.join(open_, "source_key").select("source_key", _place(F.col("epochs")).alias("place"), "doc_id", "tokens", "room"))
    cuts, level = None, 0
    while True:
        sizes = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
        small = sizes.where((F.col("n") <= last_block) | F.lit(level >= 6))
        w = Window.partitionBy("source_key").orderBy("place", "doc_id")
        done = (rows.join(small.select("source_key"), "source_key").withColumn("run", F.sum("tokens").over(w)).where("run <= room")
                .groupBy("source_key").agg(F.max(F.struct("place", "doc_id")).alias("cut")))
        cuts = done if cuts is None else cuts.union(done)
        rest = rows.join(small.select("source_key"), "source_key", "left_anti")
        # The block in which the room ends, and what the blocks before it leave of the room.
        block = F.shiftrightunsigned("place", 60 - BITS * (level + 1)).alias("block")
        sums = rest.groupBy("source_key", block, "room").agg(F.sum("tokens").alias("t"), F.max(F.struct("place", "doc_id")).alias("last"))
        run = sums.withColumn("run", F.sum("t").over(Window.partitionBy("source_key").orderBy("block")))
        run = written(run)
        whole = run.where("run <= room").groupBy("source_key").agg(F.max("last").alias("cut"))
        ends = run.where("run > room").groupBy("source_key").agg(F.min(F.struct("block", (F.col("room") - F.col("run") + F.col("t")).alias("room"))).alias("e"))
        cuts = cuts.union(whole)
        rows = written(rest.drop("room").join(ends, "source_key").where(block == F.col("e.block")).select(
            "source_key", "place", "doc_id", "tokens", F.col("e.room").alias("room")))
        level += 1
        if rows.isEmpty():
            break
    return written(cuts.groupBy("source_key").agg(F.max("cut").alias("cut")))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", budget: float = BUDGET,
                entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, last_block: int = LAST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(units, plan). Units: (source_key, doc_id, tokens, copies), one row per document. Plan: per
    source its tokens, weight, exponent, goal, whole epochs and the tokens of the last one.
    ``budget`` as a multiple of the tokens there are."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), n_tokens(text).alias("tokens"))
    units = written(rows.groupBy(_key().alias("source_key"), "doc_id").agg(F.sum("tokens").alias("tokens")))
    sources = written(units.groupBy("source_key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    amount = budget * float(sources.agg(F.sum("tokens")).first()[0] or 0)
    plan = weights(sources, amount, entropy, max_repeats)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(0).cast("int")
    plan = written(plan.withColumn("epochs", epochs).withColumn("part", F.col("goal") - F.col("epochs") * F.col("tokens")))
    cuts = _cuts(units, plan, last_block)
    both = units.join(plan.select("source_key", "epochs").join(cuts, "source_key", "left"), "source_key")
    place = F.struct(_place(F.col("epochs")).alias("place"), "doc_id")
    taken = F.coalesce((place <= F.col("cut")).cast("int"), F.lit(0))
    return both.select("source_key", "doc_id", "tokens", (F.col("epochs") + taken).alias("copies")), plan


def _unkey(c: str = "source_key") -> Column:
    return F.when(F.substring(c, 1, 1) == "s", F.expr(f"substring({c}, 2)"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, plan = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    used = units.join(plan.select("source_key", "weight", "exponent"), "source_key").where("copies > 0")
    each = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select("doc_id", _unkey().alias("source"), "epoch", F.shiftrightunsigned(_place(F.col("epoch")), 60 - BITS).alias("block"),
                       _place(F.col("epoch")).alias("place"), F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"))


@apart("doc_id", "source", "text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, one row for each use: the columns of ``docs``, ``epoch`` and ``place``."""
    units, _ = mix_sources(docs)
    uses = units.where("copies > 0").select(F.col("doc_id").alias("__id"), "source_key", "copies")
    keyed = docs.withColumn("source_key", _key())
    both = keyed.join(uses, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (keyed["source_key"] == uses["source_key"])).drop(uses["source_key"])
    each = both.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select(*docs.columns, "epoch", _place(F.col("epoch")).alias("place"))


register("op9_temperature_mixing", op9)
