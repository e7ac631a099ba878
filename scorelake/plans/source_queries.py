"""Source and sink queries on texts that Spark derives from the tables.

Each derived document covers at most 256 neighbouring rows of one bar, so no
document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.operators import tonal as tn
from scorelake.plans.registry import joined, register, with_sql
from scorelake.plans.tonal_queries import CORPUS_SQL, GRAM_SQL, SLICE_SQL, TRAIN_SQL, corpus, events, training
from scorelake.sources import runs, scores, texts
from scorelake.sources.views import BAR, notes, sounding


def sheet():
    return F.floor(F.col("event_id") / 256).alias("sheet")


def bar_documents(s, d):
    """Every bar of every part as MusicXML texts, notes placed by moving the
    cursor forward and back."""
    n = notes(s, d).withColumn("at", (F.col("offset_ql") * 4).cast("int")).withColumn("len", (F.col("dur_ql") * 4).cast("int"))
    sharp = F.col("name").contains("#")
    pitch = F.concat(F.lit("<pitch><step>"), F.substring("name", 1, 1), F.lit("</step>"),
                     F.when(sharp, "<alter>1</alter>").otherwise(""), F.lit("<octave>"), F.col("octave").cast("string"), F.lit("</octave></pitch>"))
    body = F.when(F.col("is_rest"), "<rest/>").otherwise(pitch)
    tie = F.when(F.col("tie").isNotNull(), F.concat(F.lit('<tie type="'), F.col("tie"), F.lit('"/>'))).otherwise("")
    ahead = F.when(F.col("at") > 0, F.concat(F.lit("<forward><duration>"), F.col("at").cast("string"), F.lit("</duration></forward>"))).otherwise("")
    xml = F.concat(ahead, F.lit("<note>"), body, F.lit("<duration>"), F.col("len").cast("string"), F.lit("</duration>"), tie,
                   F.lit("<voice>"), F.col("voice"), F.lit("</voice></note><backup><duration>"),
                   (F.col("at") + F.col("len")).cast("string"), F.lit("</duration></backup>"))
    docs = n.groupBy("piece_id", "measure_idx", "part_idx", sheet()).agg(F.array_sort(F.collect_list(F.struct("event_id", xml.alias("x")))).alias("x"))
    text = F.concat(F.lit('<score-partwise><part id="P"><measure number="1"><attributes><divisions>4</divisions></attributes>'),
                    F.array_join(F.transform("x", lambda e: e["x"]), ""), F.lit("</measure></part></score-partwise>"))
    return docs.select(F.concat_ws("/", "piece_id", "measure_idx", "part_idx", "sheet").alias("path"), text.alias("text"))


register("read_scores", lambda s, d: scores.parse_scores(bar_documents(s, d)).select(
    "piece", "note_idx", "voice", "onset_tick", "dur_tick", "is_rest", "ps", "pc", "octave", "name", "tie"), with_sql("""
SELECT concat_ws('/', piece_id, measure_idx, part_idx, event_id // 256) AS piece,
  ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx, part_idx, event_id // 256 ORDER BY event_id) - 1 AS note_idx, voice,
  (offset_ql * 1024)::BIGINT AS onset_tick, dur_tick, is_rest, ps, pc, octave, name, tie FROM notes"""))

FILE_BARS, FILE_PARTS = 8, 4


def score_documents(s, d):
    """Files of eight measures in four parts; the second part is written an octave higher and transposed back."""
    n = notes(s, d).withColumn("at", (F.col("offset_ql") * 4).cast("int")).withColumn("len", (F.col("dur_ql") * 4).cast("int"))
    octave = F.col("octave") + (F.col("part_idx") == 1).cast("int")
    pitch = F.concat(F.lit("<pitch><step>"), F.substring("name", 1, 1), F.lit("</step>"), F.when(F.col("name").contains("#"), "<alter>1</alter>").otherwise(""),
                     F.lit("<octave>"), octave.cast("string"), F.lit("</octave></pitch>"))
    moved = lambda way, by: F.concat(F.lit(f"<{way}><duration>"), by.cast("string"), F.lit(f"</duration></{way}>"))
    xml = F.concat(moved("forward", F.col("at")), F.lit("<note>"), F.when(F.col("is_rest"), "<rest/>").otherwise(pitch), F.lit("<duration>"),
                   F.col("len").cast("string"), F.lit("</duration><voice>"), F.col("voice"), F.lit("</voice></note>"), moved("backup", F.col("at") + F.col("len")))
    bars = n.groupBy("piece_id", F.floor(F.col("measure_idx") / FILE_BARS).alias("file"), "part_idx", "measure_idx").agg(
        F.array_sort(F.collect_list(F.struct("event_id", xml.alias("x")))).alias("x"))
    place = (F.col("part_idx") * FILE_BARS + F.col("measure_idx") % FILE_BARS).cast("int")
    files = bars.groupBy("piece_id", "file").agg(F.map_from_entries(F.collect_list(F.struct(
        place, F.array_join(F.transform("x", lambda e: e["x"]), "")))).alias("bars"))

    def measure(p, m):
        octaves = F.when(p == 1, "<transpose><chromatic>0</chromatic><octave-change>-1</octave-change></transpose>").otherwise("")
        first = F.when(m == 0, F.concat(F.lit("<attributes><divisions>4</divisions><time><beats>4</beats><beat-type>4</beat-type></time>"), octaves,
                                        F.lit("</attributes>"))).otherwise("")
        return F.concat(F.lit("<measure>"), first, F.coalesce(F.element_at("bars", (p * FILE_BARS + m).cast("int")), F.lit("")), F.lit("</measure>"))
    upto = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    parts = F.transform(upto(FILE_PARTS), lambda p: F.concat(F.lit("<part>"), F.array_join(F.transform(upto(FILE_BARS), lambda m: measure(p, m)), ""), F.lit("</part>")))
    return files.select(F.concat_ws("/", "piece_id", "file").alias("path"), F.concat(F.lit("<score-partwise>"), F.array_join(parts, ""), F.lit("</score-partwise>")).alias("text"))


def read_files(s, d):
    return scores.parse_scores(score_documents(s, d))


FILES_SQL = f"""
filed AS (SELECT concat_ws('/', piece_id, measure_idx // {FILE_BARS}) AS piece, part_idx, measure_idx % {FILE_BARS} AS bar, n.* EXCLUDE (part_idx) FROM notes n)"""

register("read_score_files", lambda s, d: read_files(s, d).select(
    "piece", "part_idx", "voice", "measure_idx", "note_idx", "onset_tick", "dur_tick", "is_rest", "ps", "pc", "octave", "name"), with_sql(FILES_SQL, """
SELECT piece, part_idx, voice, bar::INT AS measure_idx, ROW_NUMBER() OVER (PARTITION BY piece ORDER BY part_idx, bar, event_id) - 1 AS note_idx,
  ((bar * 4 + offset_ql) * 1024)::BIGINT AS onset_tick, dur_tick, is_rest, ps, pc, octave, name FROM filed"""))
# An operator on rows that were read: pitch-class slices at every onset.
register("chordify_files", lambda s, d: tn.chordify(read_files(s, d)).join(
    score_documents(s, d).select("path", F.xxhash64("path").alias("piece_id")), "piece_id").select(
    F.col("path").alias("piece"), "measure_idx", "event_tick", F.array_join("pcs", ",").alias("pcs")), with_sql(FILES_SQL, """
spans AS (SELECT piece, bar, (offset_ql * 1024)::BIGINT AS s, (offset_ql * 1024)::BIGINT + dur_tick AS e, pc FROM filed WHERE NOT is_rest)""", """
SELECT t.piece, t.bar::INT AS measure_idx, t.s AS event_tick, array_to_string(list_sort(list(DISTINCT n.pc)), ',') AS pcs
FROM (SELECT DISTINCT piece, bar, s FROM spans) t JOIN spans n ON n.piece = t.piece AND n.bar = t.bar AND n.s <= t.s AND t.s < n.e GROUP BY ALL"""))

register("read_pairs", lambda s, d: scores.read_pairs(s.read.parquet(f"{d}/events.parquet").select(F.concat(
    F.col("event_type"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit(":"), F.col("user_id").cast("string"))).otherwise("")
).alias("value"))).groupBy("in_path", "out_path").agg(F.count(F.lit(1)).alias("n")), """
SELECT event_type AS in_path, CASE WHEN event_id % 4 > 0 THEN user_id::VARCHAR END AS out_path, COUNT(*) AS n FROM events GROUP BY ALL""")


def corpus_documents(s, d):
    """Each part's bar as files with one section."""
    c = corpus(s, d).withColumn("line", F.concat_ws("_", "root", "quality", F.col("inversion").cast("string")))
    docs = c.groupBy("piece_id", "part_idx", "measure_idx", sheet(), "tonic", "mode").agg(
        F.array_sort(F.collect_list(F.struct("onset_tick", "event_id", "line"))).alias("l"))
    text = F.concat_ws("\n", F.lit("file\ttitle\tcomposer"), F.concat_ws("\t", "tonic", "mode", F.size("l").cast("string")),
                       F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return docs.select(F.concat_ws("/", "piece_id", "part_idx", "measure_idx", "sheet").alias("path"), text.alias("text"))


register("read_harmony_corpus", lambda s, d: texts.read_harmony_corpus(corpus_documents(s, d)), with_sql(CORPUS_SQL, """
SELECT concat_ws('/', piece_id, part_idx, measure_idx, event_id // 256) AS path, 0 AS section,
  (ROW_NUMBER() OVER (PARTITION BY piece_id, part_idx, measure_idx, event_id // 256 ORDER BY onset_tick, event_id) - 1)::INT AS pos,
  tonic, mode, root, quality, inversion FROM corp"""))


def weight_lines(s, d, mode):
    """Counts of the home-key transitions of a mode as the text of a weight model."""
    t = training(s, d).where((F.col("mode") == mode) & (F.col("match") == "Yes"))
    def lines(attribute, column):
        return t.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.concat(
            F.lit(" +      "), (F.col("n") / 64).cast("string"), F.lit(f" (normalized) {attribute}="), F.col("v")).alias("value"))
    intercept = t.agg(F.concat(F.lit(" +   "), F.count(F.lit(1)).cast("string")).alias("value"))
    return lines("1", "from_numeral").unionByName(lines("2", "to_numeral")).unionByName(lines("Trans", "trans")).unionByName(intercept)


def _flow(s, d, mode):
    return texts.flow_weights(texts.read_flow_weights(weight_lines(s, d, mode)), mode)


def weight_sql(mode):
    """The weights of a mode's numerals, and these between 0 and 100; tables named after the mode."""
    names, m = ", ".join(f"('{n}')" for n in hm.numeral_names(mode)), mode.lower()
    return f"""
ix_{m} AS (SELECT * FROM (VALUES {names}) v(name)),
home_{m} AS (SELECT * FROM train WHERE mode = '{mode}' AND match = 'Yes' AND from_numeral <> 'N/A' AND to_numeral <> 'N/A'),
w_{m} AS (SELECT a.name AS from_numeral, b.name AS to_numeral,
        (SELECT COUNT(*) FROM home_{m} WHERE from_numeral = a.name) / 64 + (SELECT COUNT(*) FROM home_{m} WHERE to_numeral = b.name) / 64
        + (SELECT COUNT(*) FROM home_{m} WHERE from_numeral = a.name AND to_numeral = b.name) / 64 AS weight FROM ix_{m} a CROSS JOIN ix_{m} b),
scaled_{m} AS (SELECT *, ROUND(100 * (weight - MIN(weight) OVER ()) / (MAX(weight) OVER () - MIN(weight) OVER ()), 3) AS percent FROM w_{m})"""


def both_modes(one):
    """A query over each mode, with its name as ``mode``."""
    major, minor = (one(m).withColumn("mode", F.lit(m)) for m in hm.NUMERALS)
    return major.unionByName(minor)


register("read_flow_weights", lambda s, d: both_modes(lambda m: _flow(s, d, m)), with_sql(
    CORPUS_SQL, GRAM_SQL, TRAIN_SQL, *[weight_sql(m) for m in hm.NUMERALS], " UNION ALL ".join(
        f"SELECT from_numeral, to_numeral, weight, '{m}' AS mode FROM w_{m.lower()}" for m in hm.NUMERALS)))
for _name, _mode in (("flow_matrix", "Major"), ("flow_matrix_minor", "Minor")):
    register(_name, lambda s, d, mode=_mode: texts.flow_matrix(_flow(s, d, mode), mode), with_sql(
        CORPUS_SQL, GRAM_SQL, TRAIN_SQL, weight_sql(_mode), "SELECT from_numeral, " + ", ".join(
            f"MAX(percent) FILTER (to_numeral = '{n}') AS \"{n}\"" for n in hm.numeral_names(_mode)) + f" FROM scaled_{_mode.lower()} GROUP BY from_numeral"))


def gold_documents(s, d):
    line = F.concat_ws(",", F.col("event_idx").cast("string"), F.array_join("pitches", ", "))
    docs = events(s, d).groupBy(*BAR).agg(F.array_sort(F.collect_list(F.struct("event_idx", line.alias("l")))).alias("l"))
    return docs.select(F.concat_ws("/", *BAR).alias("path"), F.concat_ws(
        "\n", F.concat(F.lit("bar,"), F.size("l").cast("string")), F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("text"))


register("read_gold_chords", lambda s, d: texts.read_gold_chords(gold_documents(s, d)).withColumn("chord", joined("chord")),
         with_sql(SLICE_SQL, """
SELECT concat_ws('/', piece_id, measure_idx) AS path, event_idx::INT AS index, array_to_string(pitches, ',') AS chord
FROM son WHERE len(pitches) IN (3, 4)"""))

register("read_run_index", lambda s, d: runs.parse_run_index(s.read.parquet(f"{d}/events.parquet").select(
    F.concat(F.lit("log/run"), F.col("event_id").cast("string"), F.lit("/index.json")).alias("path"),
    F.when(F.col("event_id") % 10 == 0, F.lit('{"timestamp": ')).otherwise(F.to_json(F.struct(
        F.unix_timestamp("ts").alias("timestamp"), F.col("event_type").alias("title")))).alias("text"))).select(
    "name", "timestamp", "title"), """
SELECT 'run' || event_id AS name, FLOOR(epoch(ts))::BIGINT AS timestamp, event_type AS title FROM events WHERE event_id % 10 <> 0""")

register("feature_ranges", lambda s, d: runs.feature_ranges(sounding(notes(s, d)), {"ps": 60.0, "dur_ql": 0.0, "offset_ql": 5.0}), with_sql("""
SELECT 'ps' AS name, 60.0::DOUBLE AS "default", LEAST(MIN(ps), 60)::DOUBLE AS low, GREATEST(MAX(ps), 60)::DOUBLE AS high FROM heard
UNION ALL SELECT 'dur_ql', 0.0, LEAST(MIN(dur_ql), 0), GREATEST(MAX(dur_ql), 0) FROM heard
UNION ALL SELECT 'offset_ql', 5.0, LEAST(MIN(offset_ql), 5), GREATEST(MAX(offset_ql), 5) FROM heard"""))
register("note_json", lambda s, d: sounding(notes(s, d)).select("event_id", runs.note_json(["part_idx", "measure_idx"]).alias("features")))
