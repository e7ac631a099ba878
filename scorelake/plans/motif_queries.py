"""Motif queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import motif as mo
from scorelake.plans.registry import MOTIF_SQL, joined, register, rounded, with_sql
from scorelake.sources.views import VOICE, motif_notes, notes


def items(s, d):
    return mo.motif_items(notes(s, d))


def raw_grams(s, d):
    return mo.notegrams(items(s, d))


ITEM_SQL = """
item AS (
  SELECT piece_id, part_idx, voice, measure_idx, onset_tick, is_rest, MIN(onset_ql) AS onset_ql,
    ARG_MIN(STRUCT_PACK(name := name, ps := ps, pc := pc, dur_ql := dur_ql, tie := tie), (ps, event_id)) AS b
  FROM {src} WHERE NOT is_rest GROUP BY ALL
  UNION ALL
  SELECT piece_id, part_idx, voice, measure_idx, onset_tick, is_rest, MIN(onset_ql) AS onset_ql,
    ARG_MIN(STRUCT_PACK(name := name, ps := ps, pc := pc, dur_ql := dur_ql, tie := tie), event_id) AS b
  FROM {src} WHERE is_rest GROUP BY ALL),
seq AS (SELECT *, ROW_NUMBER() OVER w - 1 AS pos, b.name AS name, b.ps AS ps, b.tie AS tie, b.dur_ql AS dur_ql, b.pc AS pc
        FROM item WINDOW w AS (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest)),
ahead AS (SELECT *, list(STRUCT_PACK(name := name, ps := ps, dur_ql := dur_ql, is_rest := is_rest)) OVER
            (PARTITION BY piece_id, part_idx, voice ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS raw FROM seq),
gram AS (SELECT * FROM ahead WHERE len(raw) = 4 AND len(list_filter(raw, lambda x: x.is_rest OR x.dur_ql < 0.01)) = 0
           AND COALESCE(tie NOT IN ('continue', 'stop'), TRUE))"""

register("notegrams", lambda s, d: raw_grams(s, d).select(
    *VOICE, "pos", F.array_join(F.transform("raw", lambda n: n["name"]), ",").alias("names")), with_sql(
    ITEM_SQL.format(src="notes"), """
SELECT piece_id, part_idx, voice, pos, array_to_string(list_transform(raw, lambda x: x.name), ',') AS names FROM gram"""))
register("drop_chordal_grams", lambda s, d: mo.drop_chordal_grams(raw_grams(s, d)).select(*VOICE, "pos"))
register("extend_ties", lambda s, d: mo.extend_ties(raw_grams(s, d), items(s, d)).select(
    *VOICE, "pos", "n_raw", mo.gram_key(F.col("notes")).alias("gram_key")))


def _encoders(s, d):
    """All encoders on the unmerged groups, which both engines build alike."""
    g = raw_grams(s, d).withColumn("raw", F.transform("raw", lambda n: F.struct(*[n[f].alias(f) for f in mo.NOTE])))
    return g.select(*VOICE, "pos", mo.gram_key(F.col("raw")).alias("gram_key"),
                    *[joined(e(F.col("raw"))).alias(n) for n, e in mo.ENCODERS.items()])


_DEC = "printf('%.1f', {})"
_SAME = "x.name = r.name AND x.ps = r.ps AND x.dur_ql = r.dur_ql"
register("sequence_encoders", _encoders, with_sql(ITEM_SQL.format(src="notes"), f"""
SELECT piece_id, part_idx, voice, pos,
  array_to_string([x.name || ',' || {_DEC.format('x.dur_ql')} FOR x IN raw], ';') AS gram_key,
  array_to_string([x.name FOR x IN raw], ',') AS note_names,
  array_to_string([regexp_replace(x.name, '[^A-GR]', '', 'g') FOR x IN raw], ',') AS note_letters,
  array_to_string([{_DEC.format('x.dur_ql')} FOR x IN raw], ',') AS rhythms,
  array_to_string([CASE WHEN {_SAME.replace('r.', 'raw[1].')} THEN '*' ELSE (x.ps - raw[1].ps)::DOUBLE::VARCHAR END FOR x IN raw], ',') AS interval_vector,
  array_to_string([CASE WHEN {_SAME.replace('r.', 'raw[1].')} THEN '*' ELSE {_DEC.format('x.dur_ql / raw[1].dur_ql')} END FOR x IN raw], ',') AS rhythm_vector,
  array_to_string([CASE WHEN {_SAME.replace('r.', 'raw[4].')} THEN '*' ELSE {_DEC.format('x.dur_ql / raw[4].dur_ql')} END FOR x IN list_reverse(raw)], ',') AS rhythm_reverse_vector,
  array_to_string([(ascii(raw[i + 1].name) - ascii(raw[i].name))::VARCHAR FOR i IN [1, 2, 3]], ',') AS letter_transitions,
  array_to_string([CASE WHEN raw[i].ps = raw[i + 1].ps THEN '=' WHEN raw[i].ps < raw[i + 1].ps THEN '<' ELSE '>' END FOR i IN [1, 2, 3]], ',') AS contour,
  array_to_string([(raw[i + 1].ps - raw[i].ps)::DOUBLE::VARCHAR FOR i IN [1, 2, 3]], ',') AS semitone_transitions,
  array_to_string([{_DEC.format('raw[i + 1].dur_ql / raw[i].dur_ql')} FOR i IN [1, 2, 3]], ',') AS rhythm_transitions
FROM gram"""))


def unmerged_keys(s, d):
    """Keyed groups of the motif view before ties and the chordal filter."""
    g = mo.notegrams(mo.motif_items(motif_notes(s, d)))
    g = g.withColumn("notes", F.transform("raw", lambda n: F.struct(*[n[f].alias(f) for f in mo.NOTE])))
    return g.withColumn("gram_key", mo.gram_key(F.col("notes")))


KEY_SQL = """
keyed AS (SELECT *, array_to_string([x.name || ',' || printf('%.1f', x.dur_ql) FOR x IN raw], ';') AS gram_key FROM gram),
grp AS (SELECT piece_id, gram_key, COUNT(*) AS n FROM keyed GROUP BY ALL)"""
_MSRC = ITEM_SQL.format(src="motif_notes")
register("group_grams", lambda s, d: mo.group_grams(unmerged_keys(s, d)).select("piece_id", "gram_key", "n"),
         with_sql(MOTIF_SQL, _MSRC, KEY_SQL, "SELECT piece_id, gram_key, n FROM grp"))


def _stand_in(s, d):
    """Groups labelled by their first two notes, a label SQL can make too."""
    return mo.group_grams(unmerged_keys(s, d)).withColumn("cluster", F.substring_index("gram_key", ";", 2))


register("significant_clusters", lambda s, d: mo.significant_clusters(_stand_in(s, d), 10, 1.0).withColumn(
    "z_score", rounded("z_score")), with_sql(MOTIF_SQL, _MSRC, KEY_SQL, """
sized AS (SELECT piece_id, array_to_string(string_split(gram_key, ';')[1:2], ';') AS cluster, SUM(n)::BIGINT AS size FROM grp GROUP BY ALL)""", """
SELECT piece_id, cluster, size, ROUND(z, 6) AS z_score FROM (
  SELECT *, (size - AVG(size) OVER p) / STDDEV_POP(size) OVER p AS z FROM sized WINDOW p AS (PARTITION BY piece_id))
WHERE size >= 10 AND z >= 1.0"""))
register("gram_dissimilarity", lambda s, d: mo.distance_to_commonest(
    mo.group_grams(mo.motif_grams(motif_notes(s, d)))).withColumn("dissimilarity", rounded("dissimilarity")))
register("cluster_grams", lambda s, d: mo.cluster_grams(mo.group_grams(mo.motif_grams(motif_notes(s, d)))))


def motifs(s, d):
    return mo.find_motifs(motif_notes(s, d))


register("motif_report", lambda s, d: mo.motif_report(motifs(s, d)))
register("motif_flag", lambda s, d: mo.motif_flag(motif_notes(s, d), motifs(s, d)).select("event_id", "motif"))
