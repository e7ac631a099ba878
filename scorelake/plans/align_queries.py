"""Alignment, metric and structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import align as al
from scorelake.operators import graph as gr
from scorelake.operators import metrics as mt
from scorelake.plans.registry import OUT_SQL, register, rounded, with_sql
from scorelake.sources.views import notes, out_notes, sounding


def heard(s, d, indexed=False):
    return sounding(notes(s, d, indexed))


_JOIN = {"full": "piece_id, measure_idx, onset_tick, dur_tick, ps",
         "pitch": "piece_id, measure_idx, onset_tick, ps",
         "pitch_class": "piece_id, measure_idx, onset_tick, pc"}

for _kind, _keys in _JOIN.items():
    register(f"align_notes_{_kind}", lambda s, d, k=_kind: al.align_notes(heard(s, d), out_notes(s, d), k).select(
        "event_id", "n_counterparts", "first_counterpart"), with_sql(OUT_SQL, f"""
SELECT event_id, COUNT(out_id) AS n_counterparts, MIN(out_id) AS first_counterpart
FROM heard LEFT JOIN out_notes USING ({_keys}) GROUP BY event_id"""))

register("align_notes_reverse", lambda s, d: al.align_notes(out_notes(s, d), heard(s, d), "pitch", "out_id", "event_id").select(
    "out_id", "n_counterparts", "first_counterpart"), with_sql(OUT_SQL, f"""
SELECT out_id, COUNT(event_id) AS n_counterparts, MIN(event_id) AS first_counterpart
FROM out_notes LEFT JOIN heard USING ({_JOIN['pitch']}) GROUP BY out_id"""))

register("counterparts", lambda s, d: al.counterparts(heard(s, d), out_notes(s, d), "pitch_class"), with_sql(OUT_SQL, """
SELECT piece_id, measure_idx, onset_tick, pc, 'left' AS side, event_id AS note_id
FROM heard SEMI JOIN out_notes USING (piece_id, measure_idx, onset_tick, pc)
UNION ALL
SELECT piece_id, measure_idx, onset_tick, pc, 'right' AS side, out_id AS note_id
FROM out_notes SEMI JOIN heard USING (piece_id, measure_idx, onset_tick, pc)"""))

ALIGN_SQL = """
aligned AS (
  SELECT h.event_id, h.piece_id, h.onset_tick,
         CASE WHEN BOOL_OR(h.ps = o.ps AND h.dur_tick = o.dur_tick) THEN 'all'
              WHEN BOOL_OR(h.ps = o.ps) THEN 'pitch class'
              WHEN COUNT(o.out_id) > 0 THEN 'pitch space' END AS align_type,
         COUNT(o.out_id) > 0 AS align
  FROM heard h LEFT JOIN out_notes o USING (piece_id, measure_idx, onset_tick, pc)
  GROUP BY h.event_id, h.piece_id, h.onset_tick)"""
register("align_pitch_class_onset", lambda s, d: al.align_pitch_class_onset(heard(s, d), out_notes(s, d)).select(
    "event_id", "align_type", "align"), with_sql(OUT_SQL, ALIGN_SQL, "SELECT event_id, align_type, align FROM aligned"))
register("reverse_align_type", lambda s, d: al.reverse_align_type(out_notes(s, d), heard(s, d)).select(
    "out_id", "rev_align_type"), with_sql(OUT_SQL, """
SELECT out_id, CASE WHEN BOOL_OR(h.ps = o.ps AND h.dur_tick = o.dur_tick) THEN 'all'
            WHEN BOOL_OR(h.ps = o.ps) THEN 'pitch class'
            WHEN COUNT(event_id) > 0 THEN 'pitch space' ELSE 'fabricated' END AS rev_align_type
FROM out_notes o LEFT JOIN heard h USING (piece_id, measure_idx, onset_tick, pc) GROUP BY out_id"""))

HAND_SQL = """
near AS (
  SELECT h.*, r, l FROM heard h LEFT JOIN (
    SELECT event_id, MIN(ABS(o.octave - h.octave)) FILTER (staff = 1) AS r, MIN(ABS(o.octave - h.octave)) FILTER (staff = 2) AS l
    FROM heard h JOIN out_notes o USING (piece_id, measure_idx, onset_tick, pc) GROUP BY event_id) USING (event_id)),
labelled AS (
  SELECT *, CASE WHEN r IS NULL AND l IS NULL THEN 0 WHEN l IS NULL OR r < l THEN 1 WHEN r IS NULL OR l < r THEN 2
            WHEN COUNT(r) OVER v >= COUNT(l) OVER v THEN 1 ELSE 2 END AS hand
  FROM near WINDOW v AS (PARTITION BY piece_id, measure_idx, part_idx, voice))"""
register("align_min_octave_hand", lambda s, d: al.align_min_octave_hand(heard(s, d), out_notes(s, d)).select(
    "event_id", "shift_right", "shift_left", "hand"), with_sql(OUT_SQL, HAND_SQL,
    "SELECT event_id, r AS shift_right, l AS shift_left, hand FROM labelled"))
register("justified", lambda s, d: al.justified(al.align_min_octave_hand(heard(s, d), out_notes(s, d)), out_notes(s, d)).select(
    "out_id", "staff", "justified"), with_sql(OUT_SQL, HAND_SQL, """
SELECT out_id, staff, EXISTS (SELECT 1 FROM labelled l WHERE l.piece_id = o.piece_id AND l.measure_idx = o.measure_idx
  AND l.onset_tick = o.onset_tick AND l.pc = o.pc AND l.hand = o.staff) AS justified FROM out_notes o"""))
register("align_min_octave_matching", lambda s, d: al.align_min_octave_matching(heard(s, d), out_notes(s, d)).select(
    "event_id", "hand"))
register("justified_by_matching", lambda s, d: al.justified_by_matching(heard(s, d), out_notes(s, d)).select("out_id", "justified"))

register("score_difference", lambda s, d: al.score_difference(heard(s, d), out_notes(s, d)), with_sql(OUT_SQL, """
SELECT piece_id, 'left' AS side, event_id AS note_id,
  CASE WHEN EXISTS (SELECT 1 FROM out_notes o WHERE o.piece_id = h.piece_id AND o.measure_idx = h.measure_idx AND o.onset_tick = h.onset_tick AND o.ps = h.ps) THEN '' ELSE '-' END AS difference FROM heard h
UNION ALL
SELECT piece_id, 'right' AS side, out_id AS note_id,
  CASE WHEN EXISTS (SELECT 1 FROM heard h WHERE o.piece_id = h.piece_id AND o.measure_idx = h.measure_idx AND o.onset_tick = h.onset_tick AND o.ps = h.ps) THEN '' ELSE '+' END AS difference FROM out_notes o"""))

register("transfer_markings", lambda s, d: al.transfer_markings(
    heard(s, d).withColumn("mark", F.col("event_id") * 10), out_notes(s, d), ["mark"]).select("out_id", "mark"),
    with_sql(OUT_SQL, """
SELECT out_id, mark FROM out_notes LEFT JOIN (
  SELECT piece_id, measure_idx, onset_tick, ps, FIRST(event_id * 10 ORDER BY note_idx) AS mark FROM heard GROUP BY ALL)
USING (piece_id, measure_idx, onset_tick, ps)"""))

# --- metrics --------------------------------------------------------------


def predictions(s, d):
    """True labels with stand-in probabilities that follow from the ids."""
    labelled = al.align_min_octave_hand(heard(s, d), out_notes(s, d))
    p1, p2 = (F.col("event_id") * 7 % 50) / 100, (F.col("event_id") * 11 % 50) / 100
    return labelled.select("piece_id", "onset_tick", "event_id", "hand", F.array(1 - p1 - p2, p1, p2).alias("proba"))


PRED_SQL = """
pred AS (
  SELECT piece_id, onset_tick, event_id, hand, (event_id * 7 % 50) / 100 AS p1, (event_id * 11 % 50) / 100 AS p2,
         1 - p1 - p2 AS p0,
         CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred_hand
  FROM labelled)"""


def _predicted(s, d):
    return predictions(s, d).withColumn("pred", mt.post_predict(F.col("proba"), "hand"))


register("post_predict", lambda s, d: _predicted(s, d).select(
    "event_id", "pred", mt.post_predict(F.col("proba")[1] + F.col("proba")[2], "align").alias("kept")),
    with_sql(OUT_SQL, HAND_SQL, PRED_SQL, "SELECT event_id, pred_hand AS pred, p1 + p2 >= 0.5 AS kept FROM pred"))
register("model_accuracy", lambda s, d: _predicted(s, d).agg(
    rounded(mt.accuracy(F.col("pred"), F.col("hand"))).alias("accuracy"),
    rounded(mt.accuracy(F.col("proba")[1] + F.col("proba")[2] >= 0.5, F.col("hand") != 0)).alias("bin_accuracy")),
    with_sql(OUT_SQL, HAND_SQL, PRED_SQL, """
SELECT ROUND(AVG((pred_hand = hand)::INT), 6) AS accuracy,
       ROUND(AVG(((p1 + p2 >= 0.5) = (hand <> 0))::INT), 6) AS bin_accuracy FROM pred"""))
register("confusion_matrix", lambda s, d: mt.confusion(_predicted(s, d), "hand", "pred"),
         with_sql(OUT_SQL, HAND_SQL, PRED_SQL, """
SELECT hand AS truth, pred_hand AS pred, COUNT(*) AS n FROM pred GROUP BY ALL"""))
register("roc_auc", lambda s, d: mt.roc_auc(
    predictions(s, d), F.col("hand") != 0, F.col("proba")[1] + F.col("proba")[2]).select(rounded("auc").alias("auc")),
    with_sql(OUT_SQL, HAND_SQL, PRED_SQL, """
SELECT ROUND((SUM(r) FILTER (hand <> 0) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM (
  SELECT hand, RANK() OVER (ORDER BY p1 + p2) + (COUNT(*) OVER (PARTITION BY p1 + p2) - 1) / 2.0 AS r,
         COUNT(*) FILTER (hand <> 0) OVER () AS n1, COUNT(*) FILTER (hand = 0) OVER () AS n0
  FROM pred) GROUP BY n1, n0"""))


def _test_score(s, d):
    return heard(s, d).withColumn("staff", F.when(F.col("ps") >= 60, 1).otherwise(2))


def _metric_rows(s, d):
    return mt.score_metrics(out_notes(s, d), _test_score(s, d))


_SM = list(mt.SCORE_METRICS)
SCORE_SQL = """
test AS (SELECT *, CASE WHEN ps >= 60 THEN 1 ELSE 2 END AS staff FROM heard),
gen AS (
  SELECT *, EXISTS (SELECT 1 FROM test t WHERE t.piece_id = o.piece_id AND t.measure_idx = o.measure_idx AND t.onset_tick = o.onset_tick AND t.ps = o.ps AND t.staff = o.staff) AS a,
    EXISTS (SELECT 1 FROM test t WHERE t.piece_id = o.piece_id AND t.measure_idx = o.measure_idx AND t.onset_tick = o.onset_tick AND t.ps = o.ps) AS b,
    EXISTS (SELECT 1 FROM test t WHERE t.piece_id = o.piece_id AND t.measure_idx = o.measure_idx AND t.onset_tick = o.onset_tick AND t.pc = o.pc) AS c
  FROM out_notes o WHERE tie IS NULL OR tie = 'start'),
per AS (
  SELECT piece_id, ma / (nt + ng - ma) AS e2e_accuracy, mb / (nt + ng - mb) AS bin_e2e_accuracy, mc / (nt + ng - mc) AS pc_e2e_accuracy
  FROM (SELECT piece_id, COUNT(*) AS ng, COUNT(*) FILTER (a) AS ma, COUNT(*) FILTER (b) AS mb, COUNT(*) FILTER (c) AS mc FROM gen GROUP BY piece_id)
  JOIN (SELECT piece_id, COUNT(*) AS nt FROM test WHERE tie IS NULL OR tie = 'start' GROUP BY piece_id) USING (piece_id))"""
_RSM = ", ".join(f"ROUND({m}, 6) AS {m}" for m in _SM)
register("score_metrics", lambda s, d: _metric_rows(s, d).select("piece_id", *[rounded(m).alias(m) for m in _SM]),
         with_sql(OUT_SQL, SCORE_SQL, f"SELECT piece_id, {_RSM} FROM per"))
register("metric_table", lambda s, d: mt.metric_table(_metric_rows(s, d), "piece_id", _SM).select(
    "file", *[rounded(m).alias(m) for m in _SM]), with_sql(OUT_SQL, SCORE_SQL, f"""
SELECT piece_id::VARCHAR AS file, {_RSM} FROM per
UNION ALL SELECT 'average' AS file, {', '.join(f'ROUND(AVG({m}), 6)' for m in _SM)} FROM per"""))
register("correction_marks", lambda s, d: _predicted(s, d).select(
    "event_id", mt.correction_mark(F.col("hand"), F.col("pred")).alias("correction")),
    with_sql(OUT_SQL, HAND_SQL, PRED_SQL, """
SELECT event_id, CASE WHEN hand <> pred_hand THEN hand::VARCHAR ELSE '' END AS correction FROM pred"""))
register("loss_per_onset", lambda s, d: mt.loss_per_onset(_predicted(s, d), "hand", "pred").select(
    "piece_id", rounded("loss").alias("loss")), with_sql(OUT_SQL, HAND_SQL, PRED_SQL, """
SELECT piece_id, ROUND(SUM(w * w) / SUM(n * n), 6) AS loss FROM (
  SELECT piece_id, onset_tick, COUNT(*) AS n, COUNT(*) FILTER (hand <> pred_hand) AS w FROM pred GROUP BY ALL) GROUP BY piece_id"""))

# --- contraction ----------------------------------------------------------

CONTRACT_SQL = """
items AS (SELECT DISTINCT piece_id, part_idx, voice, onset_tick, is_rest FROM notes),
follow AS (SELECT *, LEAD(onset_tick) OVER w AS next_onset, LEAD(is_rest) OVER w AS next_rest FROM items
           WINDOW w AS (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest)),
firsts AS (SELECT piece_id, part_idx, voice, onset_tick, ps, MIN(note_idx) AS v FROM heard GROUP BY ALL),
tie_edges AS (
  SELECT h.piece_id, h.note_idx AS u, t.v FROM heard h
  JOIN follow f ON f.piece_id = h.piece_id AND f.part_idx = h.part_idx AND f.voice = h.voice AND f.onset_tick = h.onset_tick AND NOT f.is_rest AND NOT f.next_rest
  JOIN firsts t ON t.piece_id = h.piece_id AND t.part_idx = h.part_idx AND t.voice = h.voice AND t.onset_tick = f.next_onset AND t.ps = h.ps
  WHERE h.tie IN ('start', 'continue')),
pitch_edges AS (
  SELECT piece_id, u, note_idx AS v FROM (
    SELECT *, MIN(note_idx) OVER (PARTITION BY piece_id, measure_idx, onset_tick, ps) AS u FROM heard) WHERE note_idx <> u)"""
COMPONENT_SQL = """
both_ways AS (SELECT piece_id, u, v FROM (SELECT * FROM tie_edges UNION SELECT * FROM pitch_edges)
              UNION SELECT piece_id, v, u FROM (SELECT * FROM tie_edges UNION SELECT * FROM pitch_edges)),
reach AS (
  SELECT piece_id, note_idx, note_idx AS other FROM heard
  UNION
  SELECT r.piece_id, r.note_idx, b.v FROM reach r JOIN both_ways b ON b.piece_id = r.piece_id AND b.u = r.other),
parents AS (SELECT piece_id, note_idx, MIN(other) AS parent_idx FROM reach GROUP BY piece_id, note_idx),
mapping AS (SELECT *, DENSE_RANK() OVER (PARTITION BY piece_id ORDER BY parent_idx) - 1 AS group_idx,
                   note_idx <> parent_idx AS is_contracted FROM parents)"""


def contract_sql(*parts):
    return with_sql(CONTRACT_SQL, COMPONENT_SQL, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


def contraction_edges(n):
    return gr.contract_ties(n).unionByName(gr.contract_by_pitch_onset(n))


def mapping(s, d):
    n = notes(s, d, indexed=True)
    return gr.contraction_index(gr.contraction_parents(n, contraction_edges(n)))


register("contract_ties", lambda s, d: gr.contract_ties(notes(s, d, indexed=True)),
         with_sql(CONTRACT_SQL, "SELECT piece_id, u, v FROM tie_edges"))
register("contract_by_pitch_onset", lambda s, d: gr.contract_by_pitch_onset(notes(s, d, indexed=True)),
         with_sql(CONTRACT_SQL, "SELECT piece_id, u, v FROM pitch_edges"))


def _parents(s, d):
    n = notes(s, d, indexed=True)
    return gr.contraction_parents(n, contraction_edges(n))


register("flatten_contractions", _parents, contract_sql("SELECT * FROM parents"))
register("contraction_index", lambda s, d: mapping(s, d), contract_sql(
    "SELECT piece_id, note_idx, parent_idx, group_idx, is_contracted FROM mapping"))
register("map_features", lambda s, d: gr.map_features(heard(s, d, True), mapping(s, d), ["ps", "dur_ql"]), contract_sql("""
SELECT piece_id, group_idx, MAX(ps) AS ps, MAX(dur_ql) AS dur_ql FROM heard JOIN mapping USING (piece_id, note_idx)
GROUP BY piece_id, group_idx"""))
register("map_features_custom", lambda s, d: gr.map_features(
    heard(s, d, True), mapping(s, d), ["ps"], aggregator=F.min), contract_sql("""
SELECT piece_id, group_idx, MIN(ps) AS ps FROM heard JOIN mapping USING (piece_id, note_idx)
GROUP BY piece_id, group_idx"""))


def _unmap(s, d):
    m = mapping(s, d)
    labels = gr.map_features(heard(s, d, True), m, ["ps"]).withColumn("label", F.col("ps") % 3)
    return al.unmap_labels(m, labels, "label").select("piece_id", "note_idx", "label")


register("unmap_labels", _unmap, contract_sql("""
SELECT piece_id, note_idx, MAX(ps) OVER (PARTITION BY piece_id, group_idx) % 3 AS label
FROM heard JOIN mapping USING (piece_id, note_idx)"""))

# --- structures, on contracted notes ---------------------------------------


def cells(s, d):
    return gr.pitch_cells(notes(s, d, indexed=True))


def between_groups(s, d, edges, columns=("one",)):
    """Edges under group numbers, with the greatest feature of each pair of groups."""
    return gr.map_structure(edges.withColumn("one", F.lit(1.0)), mapping(s, d), list(columns))


# The twins pair all notes that sound, and only then rename and take the maximum.
GROUP_SQL = """
g AS (SELECT heard.*, group_idx FROM heard JOIN mapping USING (piece_id, note_idx)),
same_onset AS (SELECT a.piece_id, LEAST(a.group_idx, b.group_idx) AS u, GREATEST(a.group_idx, b.group_idx) AS v,
    a.ps AS ps_u, b.ps AS ps_v, a.dur_ql AS dur_u, b.dur_ql AS dur_v
  FROM g a JOIN g b ON a.piece_id = b.piece_id AND a.measure_idx = b.measure_idx AND a.onset_tick = b.onset_tick
    AND a.note_idx < b.note_idx AND a.group_idx <> b.group_idx),
e1 AS (SELECT DISTINCT a.piece_id, LEAST(a.group_idx, b.group_idx) AS u, GREATEST(a.group_idx, b.group_idx) AS v
  FROM g a JOIN g b ON a.piece_id = b.piece_id AND a.measure_idx = b.measure_idx AND a.note_idx < b.note_idx AND a.group_idx <> b.group_idx
    AND a.onset_tick < b.onset_tick + b.dur_tick AND b.onset_tick < a.onset_tick + a.dur_tick),
e2 AS (SELECT DISTINCT piece_id, u, v FROM same_onset),
e3 AS (SELECT DISTINCT piece_id, u, v FROM same_onset
  WHERE (ps_u - ps_v + 120) % 12 IN (1, 2, 6, 10, 11)),
e4 AS (SELECT piece_id, u, v, MAX(ABS(LOG2(dur_u / dur_v))) AS log_ratio FROM same_onset WHERE dur_u <> dur_v GROUP BY ALL)"""
KEYS = ("piece_id", "u", "v")

register("simultaneous_notes", lambda s, d: between_groups(s, d, gr.simultaneous_notes(cells(s, d))).select(*KEYS),
         contract_sql(GROUP_SQL, "SELECT * FROM e1"))
register("onset_notes", lambda s, d: between_groups(s, d, gr.onset_notes(cells(s, d))).select(*KEYS),
         contract_sql(GROUP_SQL, "SELECT * FROM e2"))
register("onset_bad_interval_notes", lambda s, d: between_groups(s, d, gr.onset_bad_interval_notes(cells(s, d))).select(*KEYS),
         contract_sql(GROUP_SQL, "SELECT * FROM e3"))
register("onset_duration_varying_notes", lambda s, d: between_groups(
    s, d, gr.onset_duration_varying_notes(cells(s, d)), ["log_ratio"]).withColumn("log_ratio", rounded("log_ratio")),
    contract_sql(GROUP_SQL, "SELECT piece_id, u, v, ROUND(log_ratio, 6) AS log_ratio FROM e4"))

ADJ_SQL = """
items AS (SELECT DISTINCT piece_id, part_idx, voice, onset_tick, is_rest FROM notes),
links AS (SELECT *, LAG(voice) OVER w AS p_voice, LAG(onset_tick) OVER w AS p_onset, LAG(is_rest) OVER w AS p_rest FROM items
          WINDOW w AS (PARTITION BY piece_id, part_idx ORDER BY voice, onset_tick, NOT is_rest)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, part_idx, voice, onset_tick ORDER BY ps DESC, note_idx) AS rk FROM heard),
adj AS (
  SELECT n.piece_id, n.note_idx AS u, p.note_idx AS v, 1.0::DOUBLE AS one, LOG2(p.dur_ql) AS log_d, LOG2(p.dur_ql) * LOG2(p.dur_ql) AS log_d_sq
  FROM ranked n JOIN links l ON l.piece_id = n.piece_id AND l.part_idx = n.part_idx AND l.voice = n.voice AND l.onset_tick = n.onset_tick
    AND NOT l.is_rest AND NOT l.p_rest
  JOIN ranked p ON p.piece_id = n.piece_id AND p.part_idx = n.part_idx AND p.voice = l.p_voice AND p.onset_tick = l.p_onset AND p.rk = n.rk)"""
register("adjacent_notes", lambda s, d: gr.adjacent_notes(notes(s, d, indexed=True)),
         with_sql(ADJ_SQL, "SELECT * FROM adj"))


def _map_structure(s, d):
    return gr.map_structure(gr.adjacent_notes(notes(s, d, indexed=True)), mapping(s, d), ["one", "log_d"])


register("map_structure", _map_structure, contract_sql(ADJ_SQL.replace("items AS (SELECT DISTINCT piece_id, part_idx, voice, onset_tick, is_rest FROM notes),\n", ""), """
SELECT a.piece_id, LEAST(x.group_idx, y.group_idx) AS u, GREATEST(x.group_idx, y.group_idx) AS v, MAX(one) AS one, MAX(log_d) AS log_d
FROM adj a JOIN mapping x ON x.piece_id = a.piece_id AND x.note_idx = a.u JOIN mapping y ON y.piece_id = a.piece_id AND y.note_idx = a.v
WHERE x.group_idx <> y.group_idx GROUP BY ALL"""))


def _edge_features(s, d):
    cell, m = cells(s, d), mapping(s, d)

    def grouped(edges, *columns):
        return gr.map_structure(edges.withColumn("one", F.lit(1.0)), m, list(columns)), list(columns)
    return gr.edge_features([
        grouped(gr.simultaneous_notes(cell), "one"),
        grouped(gr.onset_notes(cell), "one"),
        grouped(gr.onset_bad_interval_notes(cell), "one"),
        grouped(gr.onset_duration_varying_notes(cell), "log_ratio"),
        grouped(gr.adjacent_notes(notes(s, d, indexed=True)), "one", "log_d", "log_d_sq"),
    ]).select("piece_id", "u", "v", "s0_one", "s1_one", "s2_one", rounded("s3_log_ratio").alias("s3_log_ratio"),
              "s4_one", rounded("s4_log_d").alias("s4_log_d"), rounded("s4_log_d_sq").alias("s4_log_d_sq"))


register("edge_features", _edge_features, contract_sql(
    ADJ_SQL.replace("items AS (SELECT DISTINCT piece_id, part_idx, voice, onset_tick, is_rest FROM notes),\n", ""), GROUP_SQL, """
e5 AS (SELECT a.piece_id, LEAST(x.group_idx, y.group_idx) AS u, GREATEST(x.group_idx, y.group_idx) AS v,
    MAX(one) AS one, MAX(log_d) AS log_d, MAX(log_d_sq) AS log_d_sq
  FROM adj a JOIN mapping x ON x.piece_id = a.piece_id AND x.note_idx = a.u JOIN mapping y ON y.piece_id = a.piece_id AND y.note_idx = a.v
  WHERE x.group_idx <> y.group_idx GROUP BY ALL),
e AS (SELECT piece_id, u, v FROM e1 UNION SELECT piece_id, u, v FROM e2 UNION SELECT piece_id, u, v FROM e5)""", """
SELECT e.piece_id, e.u, e.v, (e1.u IS NOT NULL)::INT::DOUBLE AS s0_one, (e2.u IS NOT NULL)::INT::DOUBLE AS s1_one,
  (e3.u IS NOT NULL)::INT::DOUBLE AS s2_one, ROUND(COALESCE(log_ratio, 0), 6) AS s3_log_ratio, COALESCE(one, 0) AS s4_one,
  ROUND(COALESCE(log_d, 0), 6) AS s4_log_d, ROUND(COALESCE(log_d_sq, 0), 6) AS s4_log_d_sq
FROM e LEFT JOIN e1 USING (piece_id, u, v) LEFT JOIN e2 USING (piece_id, u, v) LEFT JOIN e3 USING (piece_id, u, v)
  LEFT JOIN e4 USING (piece_id, u, v) LEFT JOIN e5 USING (piece_id, u, v)"""))
