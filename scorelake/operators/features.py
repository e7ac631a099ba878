"""Per-note features.

Bar and onset features aggregate first (with map-side combine) and join the
small result back, so a crowded bar never lands in one window task. Features
of a voice's flow work on items, one per voice onset, and use the chunked
ordered helpers.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_neighbours, with_running_max
from scorelake.functions.pitch import MIDDLE_C
from scorelake.session import spread
from scorelake.sources.views import BAR, ONSET, VOICE

PART_BAR = [*BAR, "part_idx"]


def _heard(notes: DataFrame) -> DataFrame:
    return notes.where(~F.col("is_rest"))


def _with_part_flag(notes: DataFrame, score: Column, best, name: str) -> DataFrame:
    """Mark the notes of the parts whose ``score`` equals the bar's best."""
    heard = _heard(notes)
    per_part = heard.groupBy(*PART_BAR).agg(score.alias("__s"))
    per_part = per_part.withColumn("__b", best("__s").over(Window.partitionBy(*BAR)))
    flags = per_part.select(*PART_BAR, (F.col("__s") == F.col("__b")).alias(name))
    return heard.join(flags, PART_BAR, "left")


def active_rhythm(notes: DataFrame) -> DataFrame:
    """Per bar, the part(s) with most notes."""
    return _with_part_flag(notes, F.count(F.lit(1)), F.max, "active_rhythm")


def sustained_rhythm(notes: DataFrame) -> DataFrame:
    """Per bar, the non-empty part(s) with fewest notes."""
    return _with_part_flag(notes, F.count(F.lit(1)), F.min, "sustained_rhythm")


def bass_line(notes: DataFrame) -> DataFrame:
    """Per bar, the part(s) with the lowest median pitch."""
    return _with_part_flag(notes, F.percentile("ps", F.lit(0.5)), F.min, "bass_line")


def bar_flags(notes: DataFrame) -> DataFrame:
    """The three part flags from one aggregate and one join."""
    heard = _heard(notes)
    w = Window.partitionBy(*BAR)
    per_part = heard.groupBy(*PART_BAR).agg(
        F.count(F.lit(1)).alias("__n"), F.percentile("ps", F.lit(0.5)).alias("__m"))
    flags = per_part.select(
        *PART_BAR,
        (F.col("__n") == F.max("__n").over(w)).alias("active_rhythm"),
        (F.col("__n") == F.min("__n").over(w)).alias("sustained_rhythm"),
        (F.col("__m") == F.min("__m").over(w)).alias("bass_line"))
    return heard.join(flags, PART_BAR, "left")


# --- voice flow -----------------------------------------------------------

ITEM = [*VOICE, "measure_idx", "onset_tick", "is_rest"]


def voice_items(notes: DataFrame) -> DataFrame:
    """One row per chord, note or rest of a voice. Chord members share one item
    whose length is that of the longest member; a rest at the same onset comes
    first."""
    return notes.groupBy(*ITEM).agg(F.max("dur_tick").alias("item_dur"),
                                    F.first("onset_ql").alias("item_onset"))


ITEM_ORDER = ["onset_tick", "sounding"]


def _items(notes: DataFrame) -> DataFrame:
    return voice_items(notes).withColumn("sounding", ~F.col("is_rest"))


def entrance_effect(notes: DataFrame) -> DataFrame:
    """Time since the first note after the latest rest of the voice."""
    items = with_neighbours(_items(notes), VOICE, ["measure_idx"], ITEM_ORDER, ["is_rest"], prev="__p")
    entry = ~F.col("is_rest") & F.coalesce(F.col("__p.is_rest"), F.lit(True))
    items = with_running_max(items, VOICE, ["measure_idx"], ITEM_ORDER,
                             {"__entry": F.when(entry, F.col("item_onset"))})
    values = items.where(~F.col("is_rest")).select(
        *ITEM, (F.col("item_onset") - F.col("__entry")).alias("entrance_effect"))
    return _heard(notes).join(values, ITEM, "left")


def onset_after_rest(notes: DataFrame) -> DataFrame:
    """Notes right after a rest, or first in the part; the state runs on from
    one voice of a part to the next."""
    items = with_neighbours(_items(notes), ["piece_id", "part_idx"], ["voice", "measure_idx"],
                            ITEM_ORDER, ["is_rest"], prev="__p")
    values = items.where(~F.col("is_rest")).select(
        *ITEM, F.coalesce(F.col("__p.is_rest"), F.lit(True)).alias("onset_after_rest"))
    return _heard(notes).join(values, ITEM, "left")


def rhythm_variety(notes: DataFrame) -> DataFrame:
    """First of a voice, next to a rest, or different in length from a
    neighbour."""
    items = with_neighbours(_items(notes), VOICE, ["measure_idx"], ITEM_ORDER,
                            ["is_rest", "item_dur"], prev="__p", next="__n")
    before = F.col("__p").isNull() | F.col("__p.is_rest") | (F.col("__p.item_dur") != F.col("item_dur"))
    after = F.col("__n").isNotNull() & (F.col("__n.is_rest") | (F.col("__n.item_dur") != F.col("item_dur")))
    values = items.where(~F.col("is_rest")).select(*ITEM, (before | after).alias("rhythm_variety"))
    return _heard(notes).join(values, ITEM, "left")


# --- single rows ----------------------------------------------------------

def strong_beats(notes: DataFrame, division: float) -> DataFrame:
    return _heard(notes).withColumn(
        "strong_beats", F.pmod(F.col("offset_ql"), F.lit(float(division))) < 1e-3)


def offset_value(notes: DataFrame) -> DataFrame:
    return _heard(notes).withColumn("offset_value", F.col("measure_onset_ql") + F.col("offset_ql"))


def pitch_distance(notes: DataFrame) -> DataFrame:
    return _heard(notes).withColumn("pitch_distance", F.abs(F.col("ps") - MIDDLE_C))


# --- bars and onsets ------------------------------------------------------

def occurrence(notes: DataFrame) -> DataFrame:
    """Per measure and voice, the most frequent spelled name(s), if repeated."""
    heard = _heard(notes)
    cell = [*VOICE, "measure_idx"]
    counts = heard.groupBy(*cell, "name").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__top", F.max("__n").over(Window.partitionBy(*cell)))
    flags = counts.select(*cell, "name", ((F.col("__n") == F.col("__top")) & (F.col("__n") > 1)).alias("occurrence"))
    return heard.join(flags, [*cell, "name"], "left")


def vertical_doubling(notes: DataFrame) -> DataFrame:
    """Names that occur at least twice at an onset."""
    heard = _heard(notes)
    counts = heard.groupBy(*ONSET, "name").agg((F.count(F.lit(1)) >= 2).alias("vertical_doubling"))
    return heard.join(counts, [*ONSET, "name"], "left")


PITCH_CLASSES = range(12)


def bar_histogram(notes: DataFrame) -> DataFrame:
    """L2-normalised pitch-class histogram of each bar."""
    counts = _heard(notes).groupBy(*BAR).agg(
        *[F.count(F.when(F.col("pc") == k, 1)).alias(f"__{k}") for k in PITCH_CLASSES])
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"__{k}") * F.col(f"__{k}") for k in PITCH_CLASSES]))
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    return counts.select(*BAR, *[(F.col(f"__{k}") / norm).alias(f"pc_stat_{k}") for k in PITCH_CLASSES])


def pitch_class_statistics(notes: DataFrame) -> DataFrame:
    return _heard(notes).join(bar_histogram(notes), BAR, "left")


def highest_pitch(notes: DataFrame) -> DataFrame:
    heard = _heard(notes)
    tops = heard.groupBy(*ONSET).agg(F.max("ps").alias("__top"))
    return heard.join(tops, ONSET, "left").withColumn("highest_pitch", F.col("ps") == F.col("__top")).drop("__top")


def highest_pitch_in_rhythm(notes: DataFrame) -> DataFrame:
    heard = _heard(notes)
    keys = [*ONSET, "dur_tick"]
    tops = heard.groupBy(*keys).agg(F.max("ps").alias("__top"))
    return (heard.join(tops, keys, "left")
            .withColumn("highest_pitch_in_rhythm", F.col("ps") == F.col("__top")).drop("__top"))


# --- output density -------------------------------------------------------

# Fixed values of the fitted density model.
BLUR_SIGMA = 4.0
BLUR_REACH = 20.0
LAST_DURATION = 4.0
SMOOTHING = 0.01
SCALE, BASE_POWER, DETAIL_POWER = 1.61, 0.545, 0.759


def onset_rates(notes: DataFrame) -> DataFrame:
    """Distinct pitches per onset, time to the next onset, and their ratio."""
    onsets = (_heard(notes).groupBy("piece_id", "measure_idx", "onset_tick")
              .agg(F.count_distinct("ps").alias("in_count"), F.first("onset_ql").alias("onset_ql")))
    onsets = with_neighbours(onsets, ["piece_id"], ["measure_idx"], ["onset_tick"], ["onset_ql"], next="__n")
    span = F.coalesce(F.col("__n.onset_ql") - F.col("onset_ql"), F.lit(LAST_DURATION))
    return (onsets.withColumn("span", span).withColumn("rate", F.col("in_count") / F.col("span")).drop("__n"))


def _blur(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Blurred rate at the onsets of one time bucket."""
    import math

    import numpy as np

    pdf = pdf.sort_values("onset_ql")
    start = pdf["onset_ql"].to_numpy()
    end = start + pdf["span"].to_numpy()
    rate = pdf["rate"].to_numpy()
    home = pdf[pdf["home"]]
    out = np.empty(len(home))
    scale = BLUR_SIGMA * math.sqrt(2)
    for i, centre in enumerate(home["onset_ql"].to_numpy()):
        a = np.searchsorted(end, centre - BLUR_REACH, side="right")
        b = np.searchsorted(start, centre + BLUR_REACH, side="left")
        # The spans tile the time, so neighbours share a border; only the outer
        # ones can reach beyond the window.
        border = np.append(start[a:b], end[b - 1]) - centre
        border = np.clip(border, -BLUR_REACH, BLUR_REACH)
        share = np.diff([math.erf(x / scale) for x in border.tolist()]) / 2
        out[i] = float(np.dot(rate[a:b], share))
    return pd.DataFrame({"piece_id": home["piece_id"], "measure_idx": home["measure_idx"],
                         "onset_tick": home["onset_tick"], "in_count": home["in_count"],
                         "span": home["span"], "rate": home["rate"], "blurred": out})


def output_count_by_onset(notes: DataFrame) -> DataFrame:
    """Expected number of kept notes per onset. Onsets are distinct ticks, so a
    bucket of twenty quarter lengths and its surroundings is bounded."""
    rates = onset_rates(notes)
    own = F.floor(F.col("onset_ql") / BLUR_REACH)
    first = F.floor((F.col("onset_ql") - BLUR_REACH) / BLUR_REACH)
    last = F.floor((F.col("onset_ql") + F.col("span") + BLUR_REACH) / BLUR_REACH)
    copies = (rates.withColumn("bucket", F.explode(F.sequence(first, last)))
              .withColumn("home", F.col("bucket") == own))
    blurred = spread(copies, "piece_id", "bucket").groupBy("piece_id", "bucket").applyInPandas(
        _blur, "piece_id int, measure_idx int, onset_tick long, in_count long, span double, "
               "rate double, blurred double")
    base = F.col("blurred") + SMOOTHING
    return (blurred.withColumn("base", base).withColumn("detail", F.col("rate") / F.col("base"))
            .withColumn("output_count", SCALE * F.pow("base", F.lit(BASE_POWER))
                        * F.pow("detail", F.lit(DETAIL_POWER)) * F.col("span")))


def output_count_estimate(notes: DataFrame) -> DataFrame:
    counts = output_count_by_onset(notes).select(*ONSET, F.col("output_count").alias("output_count_estimate"))
    return _heard(notes).join(counts, ONSET, "left")


# --- products and user features -------------------------------------------

def product_terms(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """Products of two up to ``degree`` columns; missing values count as 0."""
    def value(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    terms = {"_and_".join(group): reduce(lambda a, b: a * b, [value(c) for c in group])
             for d in range(2, degree + 1) for group in combinations(columns, d)}
    return df.withColumns(terms) if terms else df


def apply_features(notes: DataFrame, features: list[tuple]) -> DataFrame:
    """User extension point: each ``(function, fields)`` adds the declared
    columns, renamed ``<position>_<field>``."""
    out = notes
    for position, (function, fields) in enumerate(features):
        out = out.transform(function)
        missing = [f.name for f in fields if f.name not in out.columns]
        if missing:
            raise ValueError(f"feature {position} does not add {missing}")
        out = out.withColumnsRenamed({f.name: f"{position}_{f.name}" for f in fields})
    return out
