"""Run logs and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = ("timestamp long, title string, "
                "scores array<struct<name:string,xml:string,featureData:string,title:string,help:string>>, "
                "features array<struct<name:string,dtype:string,range:array<double>>>")


def parse_run_index(texts: DataFrame) -> DataFrame:
    """(path, text) of index files as runs, malformed ones skipped, newest
    first. The run is named by its folder."""
    parsed = texts.withColumn("run", F.from_json("text", INDEX_SCHEMA, {"mode": "PERMISSIVE"}))
    name = F.element_at(F.split("path", "/"), -2)
    return (parsed.where(F.col("run.timestamp").isNotNull()).select(name.alias("name"), "run.*")
            .orderBy(F.desc("timestamp"), "name"))


def read_run_index(spark: SparkSession, path: str) -> DataFrame:
    """All ``<run>/index.json`` under a folder."""
    texts = spark.read.text(f"{path}/*/index.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_run_index(texts)


def feature_ranges(notes: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Lowest and highest value of each float feature; notes without it count
    with the default, which is always included."""
    ends = notes.agg(*[F.min(F.coalesce(F.col(c).cast("double"), F.lit(v))).alias(f"lo_{c}") for c, v in defaults.items()],
                     *[F.max(F.coalesce(F.col(c).cast("double"), F.lit(v))).alias(f"hi_{c}") for c, v in defaults.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(v)).alias("default"),
                              F.least(F.col(f"lo_{c}"), F.lit(float(v))).alias("low"),
                              F.greatest(F.col(f"hi_{c}"), F.lit(float(v))).alias("high")) for c, v in defaults.items()])
    return ends.select(F.explode(rows).alias("r")).select("r.*")


def note_json(columns: list[str]) -> Column:
    """Features and position of a note as JSON."""
    place = [F.concat("name", F.col("octave").cast("string")).alias("_pitch"), F.col("name").alias("_pitch_class"),
             F.col("ps").alias("_ps"), F.col("dur_ql").alias("_duration"), F.col("onset_ql").alias("_offset")]
    return F.to_json(F.struct(*columns, *place))


def write_run(notes: DataFrame, path: str, meta: dict, defaults: dict[str, float], columns: list[str],
              structures: DataFrame | None = None) -> None:
    """Notes and structures as JSON lines by piece, and an index of features
    with their ranges."""
    notes.select("piece_id", "event_id", note_json(columns).alias("features")).write.mode("overwrite").partitionBy("piece_id").json(f"{path}/notes")
    if structures is not None:
        structures.write.mode("overwrite").partitionBy("piece_id").json(f"{path}/structures")
    ranges = feature_ranges(notes, defaults)
    index = ranges.agg(F.array_sort(F.collect_list(F.struct(
        "name", F.lit("float").alias("dtype"), F.array("low", "high").alias("range")))).alias("features"))
    index.select(*[F.lit(v).alias(k) for k, v in meta.items()], "features").coalesce(1).write.mode("overwrite").json(f"{path}/index")


def write_transitions(training: DataFrame, path: str) -> None:
    """Labelled transitions as CSV with a header, one folder per mode."""
    out = training.select(F.col("from_numeral").alias("1"), F.col("to_numeral").alias("2"), F.col("trans").alias("Trans"),
                          F.col("match").alias("Match"), "mode")
    out.write.mode("overwrite").partitionBy("mode").option("header", True).csv(path)


def write_reduced(entries: DataFrame, path: str) -> None:
    """The reduced score as a table, by piece."""
    entries.write.mode("overwrite").partitionBy("piece_id").parquet(path)


def read_reduced(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("piece_id", F.col("piece_id").cast(T.IntegerType()))
