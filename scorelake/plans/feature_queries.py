"""Index and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.pitch import quantise, respell_sharp, spelling_to_pc
from scorelake.operators import features as ft
from scorelake.operators import index as ix
from scorelake.plans.registry import joined, register, rounded, with_sql
from scorelake.sources.views import notes

# --- index ----------------------------------------------------------------

register("bar_index", lambda s, d: ix.bar_index(notes(s, d)), with_sql("""
SELECT b.piece_id, measure_idx, n_parts, n_rows, piece_parts, n_parts = piece_parts AS complete
FROM (SELECT piece_id, measure_idx, COUNT(DISTINCT part_idx) AS n_parts, COUNT(*) AS n_rows
      FROM notes GROUP BY ALL) b
JOIN (SELECT piece_id, COUNT(DISTINCT part_idx) AS piece_parts FROM notes GROUP BY ALL) p USING (piece_id)"""))

register("voice_streams", lambda s, d: ix.voice_streams(notes(s, d)).select(
    "piece_id", "part_idx", "voice", "event_id", "voice_pos"), with_sql("""
SELECT piece_id, part_idx, voice, event_id,
       ROW_NUMBER() OVER (PARTITION BY piece_id, part_idx, voice
         ORDER BY onset_tick, NOT is_rest, ps NULLS FIRST, event_id) - 1 AS voice_pos
FROM notes"""))

register("note_index", lambda s, d: notes(s, d, indexed=True).select("piece_id", "event_id", "note_idx"),
         with_sql("SELECT piece_id, event_id, note_idx FROM notes"))

register("onset_frames", lambda s, d: ix.onset_frames(notes(s, d)).withColumn("pitches", joined("pitches")),
         with_sql("""
SELECT piece_id, measure_idx, onset_tick, onset_ql, COUNT(*) AS n_notes,
       array_to_string(list_sort(list(DISTINCT ps)), ',') AS pitches
FROM heard GROUP BY piece_id, measure_idx, onset_tick, onset_ql"""))

register("explode_chords", lambda s, d: ix.explode_chords(ix.chords(notes(s, d))), with_sql("""
SELECT DISTINCT piece_id, part_idx, voice, measure_idx, offset_ql, onset_tick, ps, name FROM heard"""))

register("extract_feature", lambda s, d: notes(s, d).select(
    "event_id", ix.extract_feature("ps", -1.0).alias("value")), with_sql(
    "SELECT event_id, COALESCE(ps, -1)::DOUBLE AS value FROM notes"))


def _annotate(s, d):
    base = notes(s, d, indexed=True)
    values = base.select("piece_id", "note_idx", F.when(F.col("event_id") % 3 == 0, F.col("ps") + 12).alias("value"))
    return ix.annotate(base, values, "ps").select("piece_id", "note_idx", "event_id", "ps")


register("annotate", _annotate, with_sql("""
SELECT piece_id, note_idx, event_id, COALESCE(CASE WHEN event_id % 3 = 0 THEN ps + 12 END, ps) AS ps FROM notes"""))

register("attack_only", lambda s, d: ix.attack_only(ix.drop_zero_duration(notes(s, d).where(~F.col("is_rest")))).select(
    "event_id", "ps", "tie"), with_sql("""
SELECT event_id, ps, tie FROM heard WHERE dur_tick > 0 AND (tie IS NULL OR tie = 'start')"""))

register("quantise", lambda s, d: notes(s, d).select(
    "event_id", quantise(F.col("onset_ql")).alias("onset"), quantise(F.col("dur_ql")).alias("dur")), with_sql("""
SELECT event_id, FLOOR(onset_ql * 1024)::BIGINT AS onset, FLOOR(dur_ql * 1024)::BIGINT AS dur FROM notes"""))


def _spelled(s, d):
    """Notes respelled with letters and accidentals that follow from their ids."""
    letters = F.array(*[F.lit(x) for x in "CDEFGAB"])
    marks = F.array(*[F.lit(x) for x in ("", "#", "##", "-", "--", "###")])
    n = notes(s, d).where(~F.col("is_rest"))
    return n.select("event_id", F.concat(F.element_at(letters, (F.col("event_id") % 7 + 1).cast("int")),
                                         F.element_at(marks, (F.col("ps") % 6 + 1).cast("int"))).alias("spelled"))


SPELLED = """
spelled AS (
  SELECT event_id, ['C','D','E','F','G','A','B'][event_id % 7 + 1] || ['','#','##','-','--','###'][ps % 6 + 1] AS spelled
  FROM heard),
pcs AS (
  SELECT *, CASE spelled[1] WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5
              WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END
            + length(spelled) - length(replace(spelled, '#', ''))
            - length(spelled) + length(replace(spelled, '-', '')) AS raw FROM spelled)"""

register("spelling_to_pc", lambda s, d: _spelled(s, d).withColumn("pc", spelling_to_pc(F.col("spelled"))),
         with_sql(SPELLED, """
SELECT event_id, spelled, CASE WHEN spelled LIKE '%###' THEN -1 ELSE ((raw + 12) % 12)::INT END AS pc FROM pcs"""))

register("respell_sharp", lambda s, d: _spelled(s, d).withColumn("sharp", respell_sharp(F.col("spelled"))),
         with_sql(SPELLED, """
SELECT event_id, spelled,
       ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][((raw + 12) % 12) + 1] AS sharp FROM pcs"""))

register("piano_roll", lambda s, d: ix.piano_roll(notes(s, d)), with_sql("""
SELECT DISTINCT piece_id, measure_idx, onset_tick, ps FROM heard WHERE ps BETWEEN 12 AND 96"""))

register("piano_roll_dense", lambda s, d: ix.piano_roll_dense(notes(s, d)).withColumn("cells", joined("cells", "")),
         with_sql("""
SELECT piece_id, measure_idx, onset_tick,
       array_to_string([CASE WHEN list_contains(on_set, i) THEN 1 ELSE 0 END FOR i IN range(0, 97)], '') AS cells
FROM (SELECT piece_id, measure_idx, onset_tick, list(DISTINCT ps) AS on_set FROM heard
      WHERE ps BETWEEN 12 AND 96 GROUP BY ALL)"""))

register("roll_slots", lambda s, d: ix.roll_slots(notes(s, d)), with_sql("""
SELECT piece_id, part_idx, measure_idx, slot, layer, event_id, ps FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx, part_idx, slot ORDER BY onset_tick, event_id) - 1 AS layer
  FROM (SELECT *, UNNEST(range(FLOOR(offset_ql * 4)::BIGINT, LEAST(FLOOR((offset_ql + dur_ql) * 4), 16)::BIGINT)) AS slot
        FROM heard)) WHERE layer < 5"""))

# --- features -------------------------------------------------------------


def _flag(fn, *cols):
    return lambda s, d: fn(notes(s, d)).select("event_id", *cols)


COUNTS = """
part_bar AS (SELECT piece_id, measure_idx, part_idx, COUNT(*) AS n, MEDIAN(ps) AS m FROM heard GROUP BY ALL),
flags AS (SELECT *, n = MAX(n) OVER b AS active_rhythm, n = MIN(n) OVER b AS sustained_rhythm,
                 m = MIN(m) OVER b AS bass_line
          FROM part_bar WINDOW b AS (PARTITION BY piece_id, measure_idx))"""
for _name, _fn in (("active_rhythm", ft.active_rhythm), ("sustained_rhythm", ft.sustained_rhythm),
                   ("bass_line", ft.bass_line)):
    register(_name, _flag(_fn, _name), with_sql(COUNTS, f"""
SELECT event_id, {_name} FROM heard JOIN flags USING (piece_id, measure_idx, part_idx)"""))
register("bar_flags", _flag(ft.bar_flags, "active_rhythm", "sustained_rhythm", "bass_line"), with_sql(COUNTS, """
SELECT event_id, active_rhythm, sustained_rhythm, bass_line
FROM heard JOIN flags USING (piece_id, measure_idx, part_idx)"""))

ITEMS = """
items AS (SELECT piece_id, part_idx, voice, onset_tick, is_rest, MAX(dur_tick) AS dur, ANY_VALUE(onset_ql) AS onset_ql
          FROM notes GROUP BY piece_id, part_idx, voice, onset_tick, is_rest)"""

register("entrance_effect", _flag(ft.entrance_effect, "entrance_effect"), with_sql(ITEMS, """
l AS (SELECT *, COALESCE(LAG(is_rest) OVER (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest), TRUE) AS after_rest FROM items)""", """
e AS (SELECT *, MAX(CASE WHEN NOT is_rest AND after_rest THEN onset_ql END) OVER
          (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest ROWS UNBOUNDED PRECEDING) AS entry FROM l)""", """
SELECT event_id, e.onset_ql - entry AS entrance_effect
FROM heard JOIN e USING (piece_id, part_idx, voice, onset_tick, is_rest)"""))

register("onset_after_rest", _flag(ft.onset_after_rest, "onset_after_rest"), with_sql(ITEMS, """
SELECT event_id, after_rest AS onset_after_rest FROM heard JOIN (
  SELECT *, COALESCE(LAG(is_rest) OVER (PARTITION BY piece_id, part_idx ORDER BY voice, onset_tick, NOT is_rest), TRUE) AS after_rest
  FROM items) USING (piece_id, part_idx, voice, onset_tick, is_rest)"""))

register("rhythm_variety", _flag(ft.rhythm_variety, "rhythm_variety"), with_sql(ITEMS, """
SELECT event_id,
       (p_rest IS NULL OR p_rest OR p_dur <> dur OR COALESCE(n_rest OR n_dur <> dur, FALSE)) AS rhythm_variety
FROM heard JOIN (
  SELECT *, LAG(is_rest) OVER w AS p_rest, LAG(dur) OVER w AS p_dur, LEAD(is_rest) OVER w AS n_rest, LEAD(dur) OVER w AS n_dur
  FROM items WINDOW w AS (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest))
USING (piece_id, part_idx, voice, onset_tick, is_rest)"""))

register("strong_beats", lambda s, d: ft.strong_beats(notes(s, d), 1.0).select("event_id", "strong_beats"),
         with_sql("SELECT event_id, offset_ql % 1.0 < 1e-3 AS strong_beats FROM heard"))
register("offset_value", _flag(ft.offset_value, "offset_value"),
         with_sql("SELECT event_id, measure_onset_ql + offset_ql AS offset_value FROM heard"))
register("pitch_distance", _flag(ft.pitch_distance, "pitch_distance"),
         with_sql("SELECT event_id, ABS(ps - 60) AS pitch_distance FROM heard"))

register("occurrence", _flag(ft.occurrence, "occurrence"), with_sql("""
c AS (SELECT piece_id, part_idx, voice, measure_idx, name, COUNT(*) AS n FROM heard GROUP BY ALL)""", """
SELECT event_id, n > 1 AND n = top AS occurrence FROM heard JOIN (
  SELECT *, MAX(n) OVER (PARTITION BY piece_id, part_idx, voice, measure_idx) AS top FROM c)
USING (piece_id, part_idx, voice, measure_idx, name)"""))

register("vertical_doubling", _flag(ft.vertical_doubling, "vertical_doubling"), with_sql("""
SELECT event_id, COUNT(*) OVER (PARTITION BY piece_id, measure_idx, onset_tick, name) >= 2 AS vertical_doubling FROM heard"""))

_HIST = ", ".join(f"COUNT(*) FILTER (pc = {k}) AS c{k}" for k in range(12))
_NORM = "SQRT(" + " + ".join(f"c{k} * c{k}" for k in range(12)) + ")"
register("pitch_class_statistics", lambda s, d: ft.pitch_class_statistics(notes(s, d)).select(
    "event_id", *[rounded(f"pc_stat_{k}").alias(f"pc_stat_{k}") for k in range(12)]), with_sql(f"""
SELECT event_id, {', '.join(f'ROUND(c{k} / {_NORM}, 6) AS pc_stat_{k}' for k in range(12))}
FROM heard JOIN (SELECT piece_id, measure_idx, {_HIST} FROM heard GROUP BY piece_id, measure_idx)
USING (piece_id, measure_idx)"""))

register("highest_pitch", _flag(ft.highest_pitch, "highest_pitch"), with_sql("""
SELECT event_id, ps = MAX(ps) OVER (PARTITION BY piece_id, measure_idx, onset_tick) AS highest_pitch FROM heard"""))
register("highest_pitch_in_rhythm", _flag(ft.highest_pitch_in_rhythm, "highest_pitch_in_rhythm"), with_sql("""
SELECT event_id, ps = MAX(ps) OVER (PARTITION BY piece_id, measure_idx, onset_tick, dur_tick) AS highest_pitch_in_rhythm
FROM heard"""))

register("output_count_estimate", lambda s, d: ft.output_count_estimate(notes(s, d)).select(
    "event_id", rounded("output_count_estimate").alias("output_count_estimate")))

register("product_terms", lambda s, d: ft.product_terms(
    ft.bar_flags(notes(s, d)).withColumn("low", F.col("ps") < 60),
    ["active_rhythm", "sustained_rhythm", "bass_line", "low"], 3).select(
    "event_id", "active_rhythm_and_bass_line", "sustained_rhythm_and_low",
    "active_rhythm_and_bass_line_and_low"), with_sql(COUNTS, """
SELECT event_id, (active_rhythm AND bass_line)::INT::DOUBLE AS active_rhythm_and_bass_line,
       (sustained_rhythm AND ps < 60)::INT::DOUBLE AS sustained_rhythm_and_low,
       (active_rhythm AND bass_line AND ps < 60)::INT::DOUBLE AS active_rhythm_and_bass_line_and_low
FROM heard JOIN flags USING (piece_id, measure_idx, part_idx)"""))
