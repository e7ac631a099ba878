"""Model and score metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_running_sum
from scorelake.operators.align import KEYS, BAR
from scorelake.operators.index import attack_only


def post_predict(proba: Column, label_type: str) -> Column:
    """Predicted label from probabilities: ``p >= 0.5`` for ``align``, the first
    largest of three for ``hand``."""
    if label_type == "align":
        return proba >= 0.5
    if label_type == "hand":
        return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")
    raise ValueError("label_type must be align or hand")


def accuracy(pred: Column, truth: Column) -> Column:
    return F.avg((pred == truth).cast("double"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, truth: Column, score: Column, buckets: int = 4096) -> DataFrame:
    """Area under the ROC curve by mid-ranks. Scores in [0, 1] are first counted
    per distinct value, then summed up per bucket, so no single task ranks all
    rows."""
    counts = (df.select(truth.alias("t"), score.alias("s")).groupBy("s")
              .agg(F.count(F.when(F.col("t"), 1)).alias("pos"), F.count(F.when(~F.col("t"), 1)).alias("neg"))
              .withColumn("all", F.lit(0)).withColumn("bucket", F.floor(F.col("s") * buckets)))
    below = with_running_sum(counts, ["all"], ["bucket"], ["s"], F.col("neg"), "neg_upto")
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return below.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


# Metric name -> (key, whether staves must agree).
SCORE_METRICS = {
    "e2e_accuracy": ("pitch", True),
    "bin_e2e_accuracy": ("pitch", False),
    "pc_e2e_accuracy": ("pitch_class", False),
}


def score_metrics(gen: DataFrame, test: DataFrame) -> DataFrame:
    """Per piece, matched / (test + generated - matched) over attacks, in three
    strictnesses. ``staff`` names the staff on both sides."""
    struck = attack_only(gen)
    sizes = attack_only(test).groupBy("piece_id").agg(F.count(F.lit(1)).alias("__test"))
    tagged, hits = struck, []
    for name, (kind, staves) in SCORE_METRICS.items():
        keys = [*BAR, *(["staff"] if staves else []), *KEYS[kind]]
        there = test.select(*keys).distinct().withColumn(f"__{name}", F.lit(1))
        tagged = tagged.join(there, keys, "left")
        hits.append(F.count(f"__{name}").alias(f"__{name}"))
    per = tagged.groupBy("piece_id").agg(F.count(F.lit(1)).alias("__gen"), *hits)
    both = per.join(sizes, "piece_id", "full").na.fill(0)
    def ratio(name: str) -> Column:
        hit = F.col(f"__{name}")
        total = F.col("__test") + F.col("__gen") - hit
        return F.when(total != 0, hit / total).otherwise(F.lit(0.0)).alias(name)
    return both.select("piece_id", *[ratio(n) for n in SCORE_METRICS])


def metric_table(per_file: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row per file and an ``average`` row."""
    rows = per_file.select(F.col(key).cast("string").alias("file"), *metrics)
    mean = per_file.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("file", F.lit("average"))
    return rows.unionByName(mean)


def correction_mark(truth: Column, pred: Column) -> Column:
    """The true label where the prediction is wrong, else empty."""
    return F.when(truth != pred, truth.cast("string")).otherwise("")


def loss_per_onset(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per piece, squared errors per onset over squared onset sizes."""
    onsets = df.groupBy("piece_id", "onset_tick").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(truth) != F.col(pred), 1)).alias("wrong"))
    return onsets.groupBy("piece_id").agg(
        (F.sum(F.col("wrong") * F.col("wrong")) / F.sum(F.col("n") * F.col("n"))).alias("loss"))
