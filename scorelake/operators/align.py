"""Alignment and comparison of two versions of a piece.

Counterparts are looked up by key, never paired row by row: the other side is
aggregated to one row per key (count, first id, bounded sets) before the join,
so a key shared by very many notes costs one row, not a product.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = ["piece_id", "measure_idx"]
# The keys on which two notes count as counterparts.
KEYS = {
    "full": ["onset_tick", "dur_tick", "ps"],
    "pitch": ["onset_tick", "ps"],
    "pitch_class": ["onset_tick", "pc"],
}


def _keys(kind: str, parts: str | None) -> list[str]:
    return [*BAR, *([parts] if parts else []), *KEYS[kind]]


def align_notes(left: DataFrame, right: DataFrame, kind: str = "full", left_id: str = "event_id",
                right_id: str = "out_id", parts: str | None = None) -> DataFrame:
    """Each left note with the size and the first member of its counterpart
    list. ``parts`` names a column both sides must share, or none to ignore
    parts. Swap the sides for the reverse lookup; ``counterparts`` holds the
    lists."""
    keys = _keys(kind, parts)
    lists = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(right_id).alias("first_counterpart"))
    return (left.join(lists, keys, "left")
            .select(*left.columns, F.coalesce("__n", F.lit(0)).alias("n_counterparts"), "first_counterpart"))


def counterparts(left: DataFrame, right: DataFrame, kind: str = "full", left_id: str = "event_id",
                 right_id: str = "out_id", parts: str | None = None) -> DataFrame:
    """The counterpart lists in factorised form: one row per note of either side
    that has a counterpart, tagged with its key. A note's list is the rows of
    the other side with the same key, so the size stays linear."""
    keys = _keys(kind, parts)
    l_keys = left.select(*keys).distinct()
    shared = l_keys.join(right.select(*keys).distinct(), keys, "left_semi")
    l = left.select(*keys, F.lit("left").alias("side"), F.col(left_id).alias("note_id"))
    r = right.select(*keys, F.lit("right").alias("side"), F.col(right_id).alias("note_id"))
    return l.unionByName(r).join(shared, keys, "left_semi")


def align_pitch_class_onset(notes: DataFrame, other: DataFrame) -> DataFrame:
    """How each note is kept: ``all`` (same pitch and length), ``pitch class``
    (same pitch), ``pitch space`` (pitch class only) or null; ``align`` says
    whether at all."""
    keys = _keys("pitch_class", None)
    shapes = other.groupBy(*keys).agg(F.collect_set(F.struct("ps", "dur_tick")).alias("__shapes"))
    joined = notes.join(shapes, keys, "left")
    same_pitch = F.exists("__shapes", lambda x: x["ps"] == F.col("ps"))
    same_all = F.exists("__shapes", lambda x: (x["ps"] == F.col("ps")) & (x["dur_tick"] == F.col("dur_tick")))
    kind = (F.when(same_all, "all").when(same_pitch, "pitch class")
            .when(F.col("__shapes").isNotNull(), "pitch space"))
    return (joined.withColumn("align_type", kind).withColumn("align", F.col("align_type").isNotNull())
            .drop("__shapes"))


def reverse_align_type(other: DataFrame, notes: DataFrame) -> DataFrame:
    """Where each note of the arrangement comes from."""
    return (align_pitch_class_onset(other, notes)
            .withColumn("rev_align_type", F.coalesce("align_type", F.lit("fabricated")))
            .drop("align_type", "align"))


RIGHT_HAND, LEFT_HAND = 1, 2


def align_min_octave_hand(notes: DataFrame, out: DataFrame) -> DataFrame:
    """Hand per note: the staff that needs the smaller octave shift; on a tie
    the staff feasible for most notes of the voice and measure; then the
    right."""
    keys = _keys("pitch_class", None)
    octaves = out.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("staff") == RIGHT_HAND, F.col("octave"))).alias("__r"),
        F.collect_set(F.when(F.col("staff") == LEFT_HAND, F.col("octave"))).alias("__l"))

    def shift(side: str) -> Column:
        return F.array_min(F.transform(side, lambda o: F.abs(o - F.col("octave"))))
    near = (notes.join(octaves, keys, "left")
            .withColumn("shift_right", shift("__r")).withColumn("shift_left", shift("__l")).drop("__r", "__l"))
    cell = ["piece_id", "measure_idx", "part_idx", "voice"]
    votes = near.groupBy(*cell).agg(
        F.when(F.count("shift_right") >= F.count("shift_left"), RIGHT_HAND).otherwise(LEFT_HAND).alias("__major"))
    right, left = F.col("shift_right"), F.col("shift_left")
    hand = (F.when(right.isNull() & left.isNull(), 0)
            .when(left.isNull() | (right < left), RIGHT_HAND)
            .when(right.isNull() | (left < right), LEFT_HAND)
            .otherwise(F.col("__major")))
    return near.join(votes, cell, "left").withColumn("hand", hand).drop("__major")


def justified(labelled: DataFrame, out: DataFrame) -> DataFrame:
    """Whether some note was given to the staff of each arrangement note for
    its sake."""
    keys = _keys("pitch_class", None)
    used = (labelled.where(F.col("hand") > 0).select(*keys, F.col("hand").alias("staff")).distinct()
            .withColumn("__used", F.lit(True)))
    return (out.join(used, [*keys, "staff"], "left")
            .withColumn("justified", F.coalesce("__used", F.lit(False))).drop("__used"))


_PAIRS = T.ArrayType(T.StructType([T.StructField("in_octave", T.IntegerType()),
                                   T.StructField("out_octave", T.IntegerType())]))


def match_octaves(ins: list[int], outs: list[int]) -> list[tuple[int, int]]:
    """One-to-one matching of sorted octaves with least sum of squared
    differences. The cost is convex, so a matching without crossings is best;
    ties go to lower octaves."""
    small_is_in = len(ins) <= len(outs)
    a, b = (ins, outs) if small_is_in else (outs, ins)
    inf = float("inf")
    # best[i][j]: a[i:] matched into b[j:]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        best[i][len(b)] = inf
        for j in reversed(range(len(b))):
            best[i][j] = min((a[i] - b[j]) ** 2 + best[i + 1][j + 1], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(a):
        if (a[i] - b[j]) ** 2 + best[i + 1][j + 1] <= best[i][j + 1]:
            pairs.append((a[i], b[j]) if small_is_in else (b[j], a[i]))
            i += 1
        j += 1
    return pairs


@F.pandas_udf(_PAIRS)
def _match_udf(ins: pd.Series, outs: pd.Series) -> pd.Series:
    return pd.Series([
        [{"in_octave": x, "out_octave": y} for x, y in match_octaves(sorted(int(v) for v in i), sorted(int(v) for v in o))]
        for i, o in zip(ins, outs)])


def octave_matching(notes: DataFrame, out: DataFrame) -> DataFrame:
    """Matched octaves per (bar, onset, name). Octave sets are bounded by the
    pitch range, so each matching is tiny."""
    keys = [*BAR, "onset_tick", "name"]
    ins = notes.groupBy(*keys).agg(F.collect_set("octave").alias("__in"))
    outs = out.groupBy(*keys).agg(F.collect_set("octave").alias("__out"))
    return (ins.join(outs, keys).withColumn("__p", F.explode(_match_udf("__in", "__out")))
            .select(*keys, "__p.in_octave", "__p.out_octave"))


def align_min_octave_matching(notes: DataFrame, out: DataFrame, use_hand: bool = True) -> DataFrame:
    """Hand (or keep flag) of each note from the octave matching; the label is
    the staff of the matched octave's first arrangement note."""
    keys = [*BAR, "onset_tick", "name"]
    staff = out.groupBy(*keys, F.col("octave").alias("out_octave")).agg(F.min("staff").alias("__staff"))
    matched = (octave_matching(notes, out).join(staff, [*keys, "out_octave"])
               .select(*keys, F.col("in_octave").alias("octave"), "__staff"))
    joined = notes.join(matched, [*keys, "octave"], "left")
    label = (F.coalesce("__staff", F.lit(0)).alias("hand") if use_hand
             else F.col("__staff").isNotNull().alias("align"))
    return joined.select(*notes.columns, label)


def justified_by_matching(notes: DataFrame, out: DataFrame) -> DataFrame:
    keys = [*BAR, "onset_tick", "name"]
    used = (octave_matching(notes, out).select(*keys, F.col("out_octave").alias("octave"))
            .withColumn("__used", F.lit(True)))
    return (out.join(used, [*keys, "octave"], "left")
            .withColumn("justified", F.coalesce("__used", F.lit(False))).drop("__used"))


def score_difference(left: DataFrame, right: DataFrame, left_id: str = "event_id",
                     right_id: str = "out_id", parts: str | None = None) -> DataFrame:
    """``-`` for notes the right side lacks, ``+`` for notes it adds, empty for
    matches; lengths do not matter."""
    keys = _keys("pitch", parts)

    def side(df: DataFrame, other: DataFrame, note_id: str, name: str, mark: str) -> DataFrame:
        there = other.select(*keys).distinct().withColumn("__there", F.lit(True))
        return df.join(there, keys, "left").select(
            "piece_id", F.lit(name).alias("side"), F.col(note_id).alias("note_id"),
            F.when(F.col("__there"), "").otherwise(mark).alias("difference"))
    return side(left, right, left_id, "left", "-").unionByName(side(right, left, right_id, "right", "+"))


def transfer_markings(source: DataFrame, target: DataFrame, markings: list[str]) -> DataFrame:
    """Copy markings to target notes from the first source note (in score
    order) with the same onset and pitch."""
    keys = _keys("pitch", None)
    order = F.struct("part_idx", "measure_idx", "voice", "offset_ql", "event_id")
    first = source.groupBy(*keys).agg(F.min_by(F.struct(*markings), order).alias("__m"))
    return target.join(first, keys, "left").select(
        *[c for c in target.columns if c not in markings], *[F.col(f"__m.{m}").alias(m) for m in markings])


def unmap_labels(mapping: DataFrame, group_labels: DataFrame, label: str) -> DataFrame:
    """Group labels back on every original note."""
    return mapping.join(group_labels.select("piece_id", "group_idx", label), ["piece_id", "group_idx"], "left")
