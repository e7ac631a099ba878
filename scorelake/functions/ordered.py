"""Ordered computations over long sequences, split into chunks.

A plain window over ``(piece, part, voice)`` puts a whole voice into one task,
so one very long piece would hold up the job. Every function here windows only
inside a *chunk* of the sequence (usually one bar of one voice) and passes the
little state that crosses a border through a table with one row per chunk,
built by a map-side combined aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    return left.join(right, list(keys), how)


def with_row_number(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                    order: Sequence[str | Column], name: str) -> DataFrame:
    """0-based position of each row inside ``keys``, ordered by ``chunk`` then
    ``order``."""
    group = [*keys, *chunk]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group).orderBy(*order)
    return (_same_keys(df, starts, group)
            .withColumn(name, F.col("__start") + F.row_number().over(inside) - 1)
            .drop("__start"))


def with_neighbours(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                    order: Sequence[str], values: Sequence[str],
                    prev: str | None = None, next: str | None = None) -> DataFrame:
    """Struct columns holding ``values`` of the preceding / following row of
    ``keys``; null at the ends."""
    group = [*keys, *chunk]
    payload = F.struct(*values)
    rank = F.struct(*order)
    borders = df.groupBy(*group).agg(
        F.min_by(payload, rank).alias("__first"), F.max_by(payload, rank).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(*chunk)
    inside = Window.partitionBy(*group).orderBy(*order)
    picks = []
    if prev:
        picks.append(F.lag("__last").over(across).alias("__before"))
    if next:
        picks.append(F.lead("__first").over(across).alias("__after"))
    out = _same_keys(df, borders.select(*group, *picks), group)
    if prev:
        out = out.withColumn(prev, F.coalesce(F.lag(payload).over(inside), F.col("__before"))).drop("__before")
    if next:
        out = out.withColumn(next, F.coalesce(F.lead(payload).over(inside), F.col("__after"))).drop("__after")
    return out


def with_running_max(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                     order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Running maximum (current row included) of each expression. With an
    increasing expression that is null off the marked rows, this is the latest
    marked value."""
    group = [*keys, *chunk]
    tagged = df.withColumns({f"__v_{n}": c for n, c in values.items()})
    tops = tagged.groupBy(*group).agg(*[F.max(f"__v_{n}").alias(f"__m_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*group, *[F.max(f"__m_{n}").over(before).alias(f"__c_{n}") for n in values])
    inside = (Window.partitionBy(*group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = _same_keys(tagged, carry, group)
    out = out.withColumns({
        n: F.greatest(F.max(f"__v_{n}").over(inside), F.col(f"__c_{n}")) for n in values})
    return out.drop(*[f"__v_{n}" for n in values], *[f"__c_{n}" for n in values])


def with_running_sum(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                     order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Running sum (current row included)."""
    group = [*keys, *chunk]
    tagged = df.withColumn("__v", value)
    sums = tagged.groupBy(*group).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*group, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__c"))
    inside = (Window.partitionBy(*group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (_same_keys(tagged, carry, group)
            .withColumn(name, F.sum("__v").over(inside) + F.col("__c"))
            .drop("__v", "__c"))


BLOCK = 512


def with_lookahead(df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str],
                   size: int, name: str) -> DataFrame:
    """Array column with ``values`` of the current row and the next ``size - 1``
    rows of ``keys`` (fewer at the end). ``pos`` must be the dense 0-based
    position. Rows are cut into blocks of fixed length; the head of each block
    is also sent to the block before it."""
    reach = size - 1
    block = F.floor(F.col(pos) / BLOCK)
    head = (F.col(pos) % BLOCK < reach) & (block > 0)
    copies = F.when(head, F.array(block, block - 1)).otherwise(F.array(block))
    spread = df.withColumn("__block", F.explode(copies))
    ahead = (Window.partitionBy(*keys, "__block").orderBy(pos).rowsBetween(0, reach))
    return (spread.withColumn(name, F.collect_list(F.struct(*values)).over(ahead))
            .where(F.col("__block") == block).drop("__block"))
