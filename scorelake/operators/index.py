"""Keys, filters and layouts of the note table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_row_number
from scorelake.sources.views import BAR, ONSET, VOICE


def bar_index(notes: DataFrame) -> DataFrame:
    """Per bar, how many of the piece's parts have it; a bar is complete when
    all do."""
    cells = notes.groupBy(*BAR, "part_idx").agg(F.count(F.lit(1)).alias("n"))
    bars = cells.groupBy(*BAR).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_rows"))
    parts = cells.select("piece_id", "part_idx").distinct().groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("piece_parts"))
    return bars.join(parts, "piece_id").withColumn("complete", F.col("n_parts") == F.col("piece_parts"))


def incomplete_bars(notes: DataFrame) -> DataFrame:
    return bar_index(notes).where(~F.col("complete"))


def voice_streams(notes: DataFrame) -> DataFrame:
    """Position of each row in its voice; a missing voice counts as ``'1'``."""
    filled = (notes.withColumn("voice", F.coalesce("voice", F.lit("1")))
              .withColumn("sounding", ~F.col("is_rest")))
    return with_row_number(filled, VOICE, ["measure_idx"],
                           ["onset_tick", "sounding", "ps", "event_id"], "voice_pos").drop("sounding")


def onset_frames(notes: DataFrame) -> DataFrame:
    """One row per sounding onset with its distinct pitches, low to high. The
    pitch set is bounded by the pitch range, so a crowded onset stays small;
    the notes themselves keep the onset key."""
    return notes.where(~F.col("is_rest")).groupBy(*ONSET).agg(
        F.first("onset_ql").alias("onset_ql"), F.count(F.lit(1)).alias("n_notes"),
        F.array_sort(F.collect_set("ps")).alias("pitches"))


def chords(notes: DataFrame) -> DataFrame:
    """Notes of one voice at one onset as a chord row."""
    return notes.where(~F.col("is_rest")).groupBy(*VOICE, "measure_idx", "offset_ql", "onset_tick").agg(
        F.array_sort(F.collect_set(F.struct("ps", "name"))).alias("chord_notes"))


def explode_chords(chord_rows: DataFrame, column: str = "chord_notes") -> DataFrame:
    """Chord members as notes that keep the chord's offset."""
    others = [c for c in chord_rows.columns if c != column]
    return chord_rows.select(*others, F.explode(column).alias("__n")).select(*others, "__n.*")


def extract_feature(key: str, default: float) -> Column:
    return F.coalesce(F.col(key), F.lit(default))


def annotate(notes: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Write ``values(piece_id, note_idx, value)`` into column ``key``; nulls
    and missing rows leave it as it is."""
    old = F.col(key) if key in notes.columns else F.lit(None)
    joined = notes.join(values.select("piece_id", "note_idx", F.col("value").alias("__new")),
                        ["piece_id", "note_idx"], "left")
    return joined.withColumn(key, F.coalesce(F.col("__new"), old)).drop("__new")


def drop_zero_duration(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("dur_tick") > 0)


def attack_only(notes: DataFrame) -> DataFrame:
    """Notes that are struck: untied, or at the start of a tie."""
    return notes.where(F.col("tie").isNull() | (F.col("tie") == "start"))


def piano_roll(notes: DataFrame, low: int = 12, high: int = 96) -> DataFrame:
    """Active pitches per frame (onset), one row each."""
    return (notes.where(~F.col("is_rest")).select(*ONSET, F.col("ps").cast("int").alias("ps"))
            .where(F.col("ps").between(low, high)).distinct())


def piano_roll_dense(notes: DataFrame, size: int = 97) -> DataFrame:
    """Each frame as an array of ``size`` 0/1 cells."""
    frames = piano_roll(notes).groupBy(*ONSET).agg(F.collect_set("ps").alias("on"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                        lambda i: F.array_contains("on", i).cast("tinyint"))
    return frames.select(*ONSET, cells.alias("cells"))


def roll_slots(notes: DataFrame, quantum: int = 16, layers: int = 5, bar_ql: float = 4.0) -> DataFrame:
    """Notes spread over the slots of their measure, at most ``layers`` per part
    and slot, in order of onset and id. The end of a note is cut at the bar."""
    lo = F.floor(F.col("offset_ql") * quantum / bar_ql)
    hi = F.least(F.floor((F.col("offset_ql") + F.col("dur_ql")) * quantum / bar_ql), F.lit(quantum))
    spread = (notes.where(~F.col("is_rest") & (hi > lo))
              .withColumn("slot", F.explode(F.sequence(lo, hi - 1))))
    # With a fixed bound on the rank, Spark drops the rows beyond it before the
    # shuffle as well.
    w = Window.partitionBy("piece_id", "measure_idx", "part_idx", "slot").orderBy("onset_tick", "event_id")
    return (spread.withColumn("layer", F.row_number().over(w) - 1).where(F.col("layer") < layers)
            .select("piece_id", "part_idx", "measure_idx", "slot", "layer", "event_id", "ps"))
