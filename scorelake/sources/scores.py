"""MusicXML corpora to note rows.

One file is one input row. A small parser turns it into one row per timed
element in document order; onsets, ties to the corpus and numbering are Spark
windows over bars and small per-measure tables.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_row_number
from scorelake.functions.pitch import LETTER_PC, quantise

ELEMENTS = ("path string, part_idx int, measure_idx int, doc_pos int, kind string, bar_ql double, partial boolean, "
            "dur_ql double, chord boolean, is_rest boolean, voice string, tie string, ps int, octave int, name string")
_FIELDS = ", ".join(f.replace(" ", ":") for f in ELEMENTS.split(", ")[1:])


def read_score_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _number(node: ET.Element | None, tag: str, default: float = 0.0) -> float:
    found = None if node is None else node.findtext(tag)
    return float(found) if found else default


def _sounding_pitch(pitch: ET.Element, chromatic: int, diatonic: int) -> tuple[int, int, str]:
    """(ps, octave, spelled name) after moving a written pitch."""
    step, octave = pitch.findtext("step", "C").strip(), int(_number(pitch, "octave"))
    alter = int(_number(pitch, "alter"))
    ps = 12 * (octave + 1) + LETTER_PC[step] + alter + chromatic
    place = octave * 7 + "CDEFGAB".index(step) + diatonic
    letter, octave = "CDEFGAB"[place % 7], place // 7
    shift = ps - (12 * (octave + 1) + LETTER_PC[letter])
    return ps, octave, letter + ("#" * shift if shift > 0 else "-" * -shift)


def parse_score(path: str, text: str) -> list[tuple]:
    """Rows of one file; none if it is not a part-wise score."""
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError:
        return []
    if root.tag != "score-partwise":
        return []
    rows = []
    for part_idx, part in enumerate(root.findall("part")):
        divisions, bar_ql, chromatic, diatonic, pos = 1.0, 4.0, 0, 0, 0
        for measure_idx, measure in enumerate(part.findall("measure")):
            partial = measure.get("implicit") == "yes"
            for node in measure:
                pos += 1
                if node.tag == "attributes":
                    divisions = _number(node, "divisions", divisions)
                    time = node.find("time")
                    if time is not None and time.findtext("beats", "").isdigit():
                        bar_ql = _number(time, "beats") * 4 / _number(time, "beat-type", 4)
                    move = node.find("transpose")
                    if move is not None:
                        octaves = int(_number(move, "octave-change"))
                        chromatic = int(_number(move, "chromatic")) + 12 * octaves
                        diatonic = int(_number(move, "diatonic")) + 7 * octaves
                if node.tag not in ("note", "backup", "forward"):
                    continue
                dur = 0.0 if node.find("grace") is not None else _number(node, "duration") / divisions
                pitch, ties = node.find("pitch"), {t.get("type") for t in node.findall("tie")}
                tie = "continue" if ties == {"start", "stop"} else next(iter(ties), None)
                ps, octave, name = (None, None, None) if pitch is None else _sounding_pitch(pitch, chromatic, diatonic)
                rows.append((path, part_idx, measure_idx, pos, node.tag, bar_ql, partial, dur,
                             node.find("chord") is not None, node.find("rest") is not None,
                             node.findtext("voice"), tie, ps, octave, name))
            if not len(measure.findall("note")):
                rows.append((path, part_idx, measure_idx, pos, "empty", bar_ql, partial, 0.0, False, False, None, None, None, None, None))
    return rows


def _elements(text: str) -> list[tuple]:
    return [row[1:] for row in parse_score("", text)]


def parse_scores(texts: DataFrame) -> DataFrame:
    """Notes and rests of all score texts, with positions, at sounding pitch and
    without empty lengths. Files that are not single scores give no rows.
    ``piece`` is the path, ``piece_id`` its number (a hash), ``event_id`` that of the note, so
    the rows have all columns of the note table and every operator takes them."""
    # Without Arrow, whose batches would hold the texts of thousands of files and all their rows at once.
    parse = F.udf(_elements, f"array<struct<{_FIELDS}>>", useArrow=False)
    rows = texts.select("path", F.inline(parse("text")))
    bar = ["path", "part_idx", "measure_idx"]
    timed = F.col("kind").isin("note", "forward") & ~F.col("chord")
    move = F.when(F.col("kind") == "backup", -F.col("dur_ql")).when(timed, F.col("dur_ql")).otherwise(0.0)
    before = Window.partitionBy(*bar).orderBy("doc_pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*bar).orderBy("doc_pos").rowsBetween(Window.unboundedPreceding, 0)
    cursor = rows.withColumn("__at", F.coalesce(F.sum(move).over(before), F.lit(0.0)))
    # A chord member starts with the note it is added to.
    main = F.last(F.when((F.col("kind") == "note") & ~F.col("chord"), F.col("__at")), ignorenulls=True).over(upto)
    placed = cursor.withColumn("offset_ql", F.when(F.col("chord"), main).otherwise(F.col("__at")))

    filled = placed.groupBy("path", "measure_idx").agg(
        F.max("bar_ql").alias("bar_ql"), F.max("partial").alias("partial"),
        F.max(F.col("offset_ql") + F.when(F.col("kind") == "note", F.col("dur_ql")).otherwise(0.0)).alias("used"))
    lengths = filled.select("path", "measure_idx", F.when(F.col("partial"), F.col("used")).otherwise(F.col("bar_ql")).alias("len"))
    past = Window.partitionBy("path").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("path", "measure_idx", F.coalesce(F.sum("len").over(past), F.lit(0.0)).alias("measure_onset_ql"))

    kept = placed.where((F.col("kind") == "note") & (F.col("dur_ql") > 0)).join(starts, ["path", "measure_idx"])
    kept = with_row_number(kept, ["path"], ["part_idx", "measure_idx"], ["doc_pos"], "note_idx")
    onset = F.col("measure_onset_ql") + F.col("offset_ql")
    return kept.select(
        F.col("path").alias("piece"), F.xxhash64("path").alias("piece_id"), F.xxhash64("path", "note_idx").alias("event_id"), "part_idx", F.coalesce("voice", F.lit("1")).alias("voice"), "measure_idx", "note_idx",
        "measure_onset_ql", "offset_ql", onset.alias("onset_ql"), "dur_ql", quantise(onset).alias("onset_tick"),
        quantise(F.col("dur_ql")).alias("dur_tick"), "is_rest", "ps", (F.col("ps") % 12).alias("pc"), "octave", "name", "tie")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_scores(read_score_texts(spark, path))


# --- manifests ------------------------------------------------------------


def read_pairs(lines: DataFrame) -> DataFrame:
    """Lines ``in:out`` as (in_path, out_path); the output may be missing."""
    parts = F.split(F.trim("value"), ":", 2)
    return lines.where(F.length(F.trim("value")) > 0).select(
        parts[0].alias("in_path"), F.nullif(F.get(parts, 1), F.lit("")).alias("out_path"))


def join_pairs(pairs: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes of all inputs, and of the outputs that exist, keyed by the input's
    path."""
    ins = pairs.join(notes, pairs["in_path"] == notes["piece"]).drop("piece", "out_path")
    outs = pairs.where(F.col("out_path").isNotNull()).join(notes, F.col("out_path") == notes["piece"]).drop("piece")
    return ins, outs
