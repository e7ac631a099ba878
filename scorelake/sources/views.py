"""Score views over the ``events`` table.

``notes`` is a corpus of multi-part scores, ``out_notes`` a two-staff
arrangement of it, ``motif_notes`` a version with few distinct pitches. All
times are multiples of 0.25 quarter lengths, so arithmetic is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_row_number
from scorelake.functions.pitch import SHARP_NAMES, quantise

# Columns of the event table; naming them saves a pass over the file footers.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
VOICE = ["piece_id", "part_idx", "voice"]
BAR = ["piece_id", "measure_idx"]
ONSET = ["piece_id", "measure_idx", "onset_tick"]
# Order inside one voice: time, rests before notes, then pitch, then id.
VOICE_ORDER = ["onset_tick", "sounding", "ps_order", "event_id"]


def notes(spark: SparkSession, sf_dir: str, indexed: bool = False) -> DataFrame:
    """One row per note or rest; ``indexed`` adds ``note_idx``."""
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    step = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 90)
    raw_ps = (36 + F.round(F.col("value") * 100).cast("long") % 49).cast("int")
    dur = (F.when(F.col("event_type") == "click", 0.25).when(F.col("event_type") == "view", 0.5)
           .when(F.col("event_type") == "signup", 1.0).when(F.col("event_type") == "purchase", 2.0)
           .otherwise(0.5))
    names = F.array(*[F.lit(n) for n in SHARP_NAMES])
    heard = ~F.col("is_rest")
    base = events.select(
        F.floor(F.col("user_id") / 15).cast("int").alias("piece_id"),
        (F.col("user_id") % 4).cast("int").alias("part_idx"),
        (1 + F.col("event_id") % 2).cast("string").alias("voice"),
        (F.dayofmonth("ts") - 1).cast("int").alias("measure_idx"),
        (step * 0.25).cast("double").alias("offset_ql"),
        (F.col("event_type") == "error").alias("is_rest"),
        dur.alias("dur_ql"),
        raw_ps.alias("raw_ps"),
        F.when(F.col("event_id") % 13 == 0, "start").when(F.col("event_id") % 13 == 2, "stop").alias("raw_tie"),
        "event_id",
    )
    out = base.select(
        "piece_id", "part_idx", "voice", "measure_idx",
        (F.col("measure_idx") * 4).cast("double").alias("measure_onset_ql"),
        "offset_ql",
        (F.col("measure_idx") * 4 + F.col("offset_ql")).alias("onset_ql"),
        "dur_ql",
        quantise(F.col("measure_idx") * 4 + F.col("offset_ql")).alias("onset_tick"),
        quantise(F.col("dur_ql")).alias("dur_tick"),
        "is_rest",
        F.when(heard, F.col("raw_ps")).alias("ps"),
        F.when(heard, F.col("raw_ps") % 12).alias("pc"),
        F.when(heard, F.floor(F.col("raw_ps") / 12).cast("int") - 1).alias("octave"),
        F.when(heard, F.element_at(names, F.col("raw_ps") % 12 + 1)).alias("name"),
        F.when(heard, F.col("raw_tie")).alias("tie"),
        "event_id",
    )
    return with_note_index(out) if indexed else out


def with_note_index(df: DataFrame) -> DataFrame:
    """Position in the piece: part, measure, voice, offset, id."""
    return with_row_number(df, ["piece_id"], ["part_idx", "measure_idx", "voice"],
                           ["offset_ql", "event_id"], "note_idx")


def sounding(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_rest"))


def out_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arranged version: about two thirds of the notes, some moved an octave
    up, some twice as long."""
    kept = sounding(notes(spark, sf_dir)).where(F.col("event_id") % 3 != 0)
    ps = F.col("ps") + F.when(F.col("event_id") % 5 == 0, 12).otherwise(0)
    dur = F.when(F.col("event_id") % 7 == 0, F.col("dur_ql") * 2).otherwise(F.col("dur_ql"))
    kept = kept.withColumn("ps", ps).withColumn("dur_ql", dur)
    return kept.select(
        "piece_id", F.when(F.col("ps") >= 60, 1).otherwise(2).alias("staff"),
        "measure_idx", "offset_ql", "onset_ql", "onset_tick", "dur_ql",
        quantise(F.col("dur_ql")).alias("dur_tick"),
        "ps", (F.col("ps") % 12).alias("pc"), (F.floor(F.col("ps") / 12).cast("int") - 1).alias("octave"),
        "name", "tie", F.col("event_id").alias("out_id"))


def motif_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``notes`` without rests, on three pitches and two durations."""
    ps = F.when(F.col("ps") % 4 == 0, 62).when(F.col("ps") % 4 == 1, 67).otherwise(60)
    base = sounding(notes(spark, sf_dir)).withColumn("ps", ps)
    dur = F.when(F.col("dur_ql") == 2.0, 1.0).otherwise(0.25)
    return (base.withColumn("dur_ql", dur).withColumn("dur_tick", quantise(F.col("dur_ql")))
            .withColumn("pc", F.col("ps") % 12).withColumn("octave", F.floor(F.col("ps") / 12).cast("int") - 1)
            .withColumn("name", F.when(F.col("ps") == 62, "D").when(F.col("ps") == 67, "G").otherwise("C")))
