"""Text sources of the tonal analysis: harmony corpora, flow weights, gold
chords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import harmony as hm


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).where(F.length(F.trim("line")) > 0)


def read_harmony_corpus(texts: DataFrame) -> DataFrame:
    """(path, text) files: a title line, then sections of ``tonic TAB mode TAB
    n`` and n lines ``root_quality_inversion``. Flats are written ``b`` in the
    files and ``-`` in the result."""
    rows = _lines(texts).where(F.col("pos") > 0)
    head = F.size(F.split("line", "\t")) >= 3
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.transform(F.split("line", "\t"), lambda x: F.trim(x))
    flat = lambda c: F.replace(c, F.lit("b"), F.lit("-"))
    marked = rows.withColumn("h", head)
    filled = marked.select(
        "path", "pos", "line", "h", (F.sum(F.col("h").cast("int")).over(w) - 1).cast("int").alias("section"),
        F.last(F.when(F.col("h"), flat(cells[0])), ignorenulls=True).over(w).alias("tonic"),
        F.last(F.when(F.col("h"), F.when(cells[1] == "Major", "Major").otherwise("Minor")), ignorenulls=True).over(w).alias("mode"),
        F.last(F.when(F.col("h"), F.col("pos")), ignorenulls=True).over(w).alias("head_pos"),
        F.last(F.when(F.col("h"), cells[2].cast("int")), ignorenulls=True).over(w).alias("n"))
    tokens = F.split(F.trim("line"), "_")
    at = F.col("pos") - F.col("head_pos") - 1
    return filled.where(~F.col("h") & (at < F.col("n"))).select(
        "path", "section", at.alias("pos"), "tonic", "mode", flat(tokens[0]).alias("root"), tokens[1].alias("quality"),
        tokens[2].cast("int").alias("inversion"))


def read_flow_weights(lines: DataFrame) -> DataFrame:
    """(attribute, value, weight) of the lines ``+ weight (normalized)
    attribute=value``; the intercept, which has no value, is left out."""
    pattern = r"^\s*\+?\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s.*?(\S+)=(\S+)\s*$"
    found = lines.where(F.col("value").rlike(pattern))
    return found.select(F.regexp_extract("value", pattern, 2).alias("attribute"), F.regexp_extract("value", pattern, 3).alias("value"),
                        F.regexp_extract("value", pattern, 1).cast("double").alias("weight"))


def flow_weights(weights: DataFrame, mode: str) -> DataFrame:
    """(from, to, weight) for all pairs of a mode's numerals: the weight of the
    row (``1``), the column (``2``) and the cell (``Trans``) added up."""
    names = hm.numeral_names(mode)
    grid = weights.sparkSession.createDataFrame([(a, b) for a in names for b in names], "from_numeral string, to_numeral string")

    def part(attribute: str, key: str, out: str) -> DataFrame:
        return weights.where(F.col("attribute") == attribute).groupBy(F.col("value").alias(key)).agg(F.sum("weight").alias(out))
    full = (grid.join(F.broadcast(part("1", "from_numeral", "r")), "from_numeral", "left")
            .join(F.broadcast(part("2", "to_numeral", "c")), "to_numeral", "left")
            .withColumn("trans", F.concat_ws("-", "from_numeral", "to_numeral"))
            .join(part("Trans", "trans", "t"), "trans", "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return full.select("from_numeral", "to_numeral", (zero("r") + zero("c") + zero("t")).alias("weight"))


def flow_percent(weights: DataFrame) -> DataFrame:
    """Weights scaled so that the least is 0 and the greatest 100."""
    ends = weights.agg(F.min("weight").alias("__lo"), F.max("weight").alias("__hi"))  # one row
    return weights.join(F.broadcast(ends)).withColumn(
        "percent", F.round(100 * (F.col("weight") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), 3)).drop("__lo", "__hi")


def flow_matrix(weights: DataFrame, mode: str) -> DataFrame:
    """The scaled weights as a matrix, one row per first numeral."""
    return flow_percent(weights).groupBy("from_numeral").pivot("to_numeral", hm.numeral_names(mode)).agg(F.first("percent"))


def read_gold_chords(texts: DataFrame) -> DataFrame:
    """(path, text) files: a header ``name,n``, then ``index,tone,tone,tone``
    with a fourth tone at most. Other lines are left out."""
    cells = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = _lines(texts).where(F.col("pos") > 0).withColumn("cells", cells).where(F.size("cells").isin(4, 5))
    return rows.select("path", F.col("cells")[0].cast("int").alias("index"), F.slice("cells", 2, F.size("cells") - 1).alias("chord"))
