"""Model, regression and onset-chain queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelake.operators import align as al
from scorelake.operators import features as ft
from scorelake.operators import graph as gr
from scorelake.operators import learn as ln
from scorelake.operators import metrics as mt
from scorelake.plans.align_queries import (ADJ_SQL, ALIGN_SQL, HAND_SQL, contract_sql, mapping)
from scorelake.plans.feature_queries import COUNTS, ITEMS
from scorelake.plans.registry import OUT_SQL, joined, register, rounded, with_sql
from scorelake.plans.source_queries import both_modes
from scorelake.plans.tonal_queries import training
from scorelake.session import cut_lineage
from scorelake.sources.views import ONSET, notes, out_notes, sounding


def labelled(s, d):
    """Features with the true hand and keep labels."""
    feats = ln.note_features(notes(s, d))
    hands = al.align_min_octave_hand(sounding(notes(s, d)), out_notes(s, d)).select("event_id", "hand")
    return feats.join(hands, "event_id").withColumn("align", F.col("hand") > 0)


FEATURE_SQL = """
f_near AS (SELECT *, LAG(is_rest) OVER v AS p_rest, LAG(dur) OVER v AS p_dur, LEAD(is_rest) OVER v AS n_rest, LEAD(dur) OVER v AS n_dur,
           COALESCE(LAG(is_rest) OVER (PARTITION BY piece_id, part_idx ORDER BY voice, onset_tick, NOT is_rest), TRUE) AS after_rest
         FROM items WINDOW v AS (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest)),
f_flow AS (SELECT *, MAX(CASE WHEN NOT is_rest AND COALESCE(p_rest, TRUE) THEN onset_ql END) OVER
           (PARTITION BY piece_id, part_idx, voice ORDER BY onset_tick, NOT is_rest ROWS UNBOUNDED PRECEDING) AS entry FROM f_near),
f_freq AS (SELECT piece_id, part_idx, voice, measure_idx, name, COUNT(*) AS k FROM heard GROUP BY ALL),
f_tops AS (SELECT *, k > 1 AND k = MAX(k) OVER (PARTITION BY piece_id, part_idx, voice, measure_idx) AS occurrence FROM f_freq)"""
FEATURE_BODY = """
SELECT event_id, active_rhythm, sustained_rhythm, bass_line, h.onset_ql - entry AS entrance_effect, after_rest AS onset_after_rest,
  (p_rest IS NULL OR p_rest OR p_dur <> dur OR COALESCE(n_rest OR n_dur <> dur, FALSE)) AS rhythm_variety,
  offset_ql % 0.5 < 1e-3 AS strong_beats, occurrence,
  COUNT(*) OVER (PARTITION BY piece_id, measure_idx, onset_tick, name) >= 2 AS vertical_doubling,
  ps = MAX(ps) OVER (PARTITION BY piece_id, measure_idx, onset_tick) AS highest_pitch, ABS(ps - 60) AS pitch_distance
FROM heard h JOIN flags USING (piece_id, measure_idx, part_idx) JOIN f_flow USING (piece_id, part_idx, voice, onset_tick, is_rest)
JOIN f_tops USING (piece_id, part_idx, voice, measure_idx, name)"""
register("note_features", lambda s, d: ln.note_features(notes(s, d)).select("event_id", *ln.FEATURES), with_sql(COUNTS, ITEMS, FEATURE_SQL, FEATURE_BODY))
register("assemble", lambda s, d: ln.assemble(labelled(s, d), ln.FEATURES, "hand").select(
    "event_id", joined(vector_to_array("features")).alias("features"), "label"))


def _model(kind, label):
    def run(s, d):
        out = ln.fit_predict(kind, labelled(s, d).select("piece_id", "event_id", label, *ln.FEATURES), ln.FEATURES, label)
        return out.select("event_id", "label", "prediction")
    return run


for _kind, _label in (("multinomial", "hand"), ("gaussian_bayes", "hand"), ("network", "align"), ("weighted", "align"),
                      ("svm", "align"), ("logistic", "align"), ("tree", "align"), ("forest", "align")):
    register(f"model_{_kind}", _model(_kind, _label))


def _weights(s, d):
    table = ln.assemble(cut_lineage(labelled(s, d).select("hand", *ln.FEATURES)), ln.FEATURES, "hand")
    return ln.describe_weights(ln.model("multinomial").fit(table), ln.FEATURES, s)


register("describe_weights", _weights)

def _bayes_sql(n):
    """Gaussian naive Bayes per fold over the columns x0, x1 ...: sums of all pieces less those of the own one."""
    each = lambda f, sep=", ": sep.join(f(i) for i in range(n))
    return f"""
own AS (SELECT piece_id, hand, COUNT(*) AS n, {each(lambda i: f"SUM(x{i}) AS s{i}, SUM(x{i} * x{i}) AS q{i}")} FROM x GROUP BY ALL),
tot AS (SELECT hand, SUM(n) AS n, {each(lambda i: f"SUM(s{i}) AS s{i}, SUM(q{i}) AS q{i}")} FROM own GROUP BY hand),
fold AS (SELECT p.piece_id, t.hand, t.n - COALESCE(o.n, 0) AS n, {each(lambda i: f"t.s{i} - COALESCE(o.s{i}, 0) AS s{i}, t.q{i} - COALESCE(o.q{i}, 0) AS q{i}")}
         FROM (SELECT DISTINCT piece_id FROM own) p CROSS JOIN tot t LEFT JOIN own o ON o.piece_id = p.piece_id AND o.hand = t.hand),
par AS (SELECT piece_id, hand, LN(n) AS prior, {each(lambda i: f"s{i} / n AS m{i}, GREATEST(q{i} / n - (s{i} / n) * (s{i} / n), 1e-9) AS v{i}")} FROM fold WHERE n > 0),
scored AS (SELECT x.piece_id, x.hand, p.hand AS guess, ROW_NUMBER() OVER (PARTITION BY x.event_id ORDER BY
             prior - {each(lambda i: f"0.5 * (LN(v{i}) + (x{i} - m{i}) * (x{i} - m{i}) / v{i})", " - ")} DESC, p.hand) AS k
           FROM x JOIN par p ON p.piece_id = x.piece_id),
per AS (SELECT piece_id, AVG((guess = hand)::INT) AS accuracy FROM scored WHERE k = 1 GROUP BY piece_id)"""


register("leave_one_piece_out", lambda s, d: ln.leave_one_piece_out(cut_lineage(labelled(s, d).select("piece_id", "hand", *ln.FEATURES)), ln.FEATURES, "hand").select(
    "fold", rounded("accuracy").alias("accuracy")), with_sql(COUNTS, ITEMS, FEATURE_SQL, OUT_SQL, HAND_SQL, f"""
told AS ({FEATURE_BODY}),
x AS (SELECT l.piece_id, event_id, hand, {", ".join(f"COALESCE(told.{c}::DOUBLE, 0.0) AS x{i}" for i, c in enumerate(ln.FEATURES))}
      FROM labelled l JOIN told USING (event_id))""", _bayes_sql(len(ln.FEATURES)), """
SELECT piece_id::VARCHAR AS fold, ROUND(accuracy, 6) AS accuracy FROM per
UNION ALL SELECT 'average', ROUND(AVG(accuracy), 6) FROM per"""))

# --- ordering -------------------------------------------------------------

_ORDER = ["ps", "dur_ql", "offset_ql"]


def keep_labelled(s, d):
    """Contracted groups with their greatest features, kept if any of their notes is."""
    rows = al.align_pitch_class_onset(notes(s, d, indexed=True).where(~F.col("is_rest")), out_notes(s, d))
    return gr.contracted_rows(rows, mapping(s, d), [*_ORDER, "align"])


register("ordering_pairs", lambda s, d: ln.ordering_pairs(keep_labelled(s, d), _ORDER, "align"), contract_sql(
    OUT_SQL, ALIGN_SQL, """
lab AS (SELECT piece_id, group_idx, ARG_MIN(measure_idx, note_idx) AS measure_idx, ARG_MIN(onset_tick, note_idx) AS onset_tick,
    MAX(ps) AS ps, MAX(dur_ql) AS dur_ql, MAX(offset_ql) AS offset_ql, BOOL_OR(align) AS align
  FROM heard JOIN mapping USING (piece_id, note_idx) JOIN (SELECT event_id, align FROM aligned) USING (event_id) GROUP BY ALL),
pr AS (SELECT k.piece_id, k.group_idx AS k, x.group_idx AS d, k.ps - x.ps AS ps, k.dur_ql - x.dur_ql AS dur_ql, k.offset_ql - x.offset_ql AS offset_ql
       FROM lab k JOIN lab x ON k.piece_id = x.piece_id AND k.measure_idx = x.measure_idx AND k.onset_tick = x.onset_tick WHERE k.align AND NOT x.align)""", """
SELECT piece_id, k, d, ps::DOUBLE AS ps, dur_ql, offset_ql, 1 AS label FROM pr
UNION ALL SELECT piece_id, k, d, -ps::DOUBLE, 0 - dur_ql, 0 - offset_ql, 0 FROM pr"""))


def _ordering(s, d):
    rows = cut_lineage(keep_labelled(s, d).select(*ONSET, "note_idx", "align", *_ORDER))
    fitted = ln.train_ordering(ln.ordering_pairs(rows, _ORDER, "align"), _ORDER)
    return ln.decode_ordering(rows, fitted, _ORDER, ft.output_count_by_onset(notes(s, d))).select("piece_id", "note_idx", "keep")


register("onset_ordering", _ordering)
register("keep_highest", lambda s, d: ln.keep_highest(
    gr.contracted_rows(notes(s, d, indexed=True), mapping(s, d), ["ps", "dur_ql"]), F.col("ps") * 0.5 + F.col("dur_ql"),
    F.lit(2)).select("piece_id", "note_idx", "keep"), contract_sql("""
grp AS (SELECT piece_id, group_idx, ARG_MIN(measure_idx, note_idx) AS measure_idx, ARG_MIN(onset_tick, note_idx) AS onset_tick,
    MAX(ps) AS ps, MAX(dur_ql) AS dur_ql FROM heard JOIN mapping USING (piece_id, note_idx) GROUP BY ALL)""", """
SELECT piece_id, group_idx AS note_idx, ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx, onset_tick
  ORDER BY ps * 0.5 + dur_ql DESC, group_idx) <= 2 AS keep FROM grp"""))

# --- onset chain ----------------------------------------------------------


def chain(s, d):
    n = notes(s, d, indexed=True)
    m = mapping(s, d)
    members = ln.onset_members(n, m)
    return members, ln.voice_links(members, gr.map_structure(gr.adjacent_notes(n), m, ["one"]))


CHAIN_SQL = ADJ_SQL.replace("items AS (SELECT DISTINCT piece_id, part_idx, voice, onset_tick, is_rest FROM notes),\n", "") + """,
medges AS (SELECT DISTINCT a.piece_id, LEAST(x.group_idx, y.group_idx) AS u, GREATEST(x.group_idx, y.group_idx) AS v
  FROM adj a JOIN mapping x ON x.piece_id = a.piece_id AND x.note_idx = a.u JOIN mapping y ON y.piece_id = a.piece_id AND y.note_idx = a.v
  WHERE x.group_idx <> y.group_idx),
ons AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id ORDER BY measure_idx, onset_tick) - 1 AS onset_no
        FROM (SELECT DISTINCT piece_id, measure_idx, onset_tick FROM heard)),
mem AS (SELECT h.*, m.group_idx, onset_no, ROW_NUMBER() OVER (PARTITION BY h.piece_id, h.measure_idx, h.onset_tick ORDER BY h.note_idx) - 1 AS place
        FROM heard h JOIN mapping m USING (piece_id, note_idx) JOIN ons USING (piece_id, measure_idx, onset_tick) WHERE NOT is_contracted),
linked AS (SELECT e.piece_id, GREATEST(a.onset_no, b.onset_no) AS onset_no,
             CASE WHEN a.onset_no < b.onset_no THEN a.place ELSE b.place END AS before, CASE WHEN a.onset_no < b.onset_no THEN b.place ELSE a.place END AS now
           FROM medges e JOIN mem a ON a.piece_id = e.piece_id AND a.group_idx = e.u JOIN mem b ON b.piece_id = e.piece_id AND b.group_idx = e.v
           WHERE ABS(a.onset_no - b.onset_no) = 1)"""


def _onset_table(s, d):
    t = ln.onset_table(*chain(s, d))
    return t.select("piece_id", "onset_no",
                    F.array_join(F.transform("notes", lambda n: n["group_idx"].cast("string")), ",").alias("groups"),
                    F.coalesce(F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["before"], e["now"])), ","), F.lit("")).alias("edges"))


register("onset_table", _onset_table, contract_sql(CHAIN_SQL, """
SELECT m.piece_id, m.onset_no, array_to_string(list(group_idx ORDER BY place), ',') AS groups, COALESCE(ANY_VALUE(edges), '') AS edges
FROM mem m LEFT JOIN (SELECT piece_id, onset_no, array_to_string(list(before || '-' || now ORDER BY before, now), ',') AS edges FROM linked GROUP BY ALL) e
  ON e.piece_id = m.piece_id AND e.onset_no = m.onset_no GROUP BY m.piece_id, m.onset_no"""))


def _potentials(s, d):
    members, links = chain(s, d)
    return ln.chain_potentials(members, links, F.col("ps") % 3 != 0, F.col("ps") * 0.125 - 7.5 + F.col("dur_ql"), -1.0, 0.5, -0.25).select(
        "piece_id", rounded("vertical", 5).alias("vertical"), rounded("horizontal", 5).alias("horizontal"))


register("chain_potentials", _potentials, contract_sql(CHAIN_SQL, """
lab AS (SELECT *, ps % 3 <> 0 AS keep, ps * 0.125 - 7.5 + dur_ql AS u FROM mem),
per AS (SELECT piece_id, onset_no, ANY_VALUE(onset_ql) AS onset_ql, MAX(keep::INT) AS any_kept, COALESCE(BIT_OR(CASE WHEN keep THEN 1 << pc END), 0) AS pcs,
          SUM(CASE WHEN keep THEN u ELSE 0 END) AS vertical FROM lab GROUP BY ALL),
crowd AS (SELECT l.piece_id, l.onset_no, COUNT(*) FILTER (a.keep AND b.keep) AS n FROM linked l
  JOIN lab a ON a.piece_id = l.piece_id AND a.onset_no = l.onset_no - 1 AND a.place = l.before
  JOIN lab b ON b.piece_id = l.piece_id AND b.onset_no = l.onset_no AND b.place = l.now GROUP BY ALL),
hor AS (SELECT x.piece_id, x.vertical, CASE WHEN p.piece_id IS NULL THEN 0 ELSE
    (-1.0 * x.any_kept * p.any_kept + 0.5 * COALESCE(c.n, 0) - 0.25 * bit_count(xor(x.pcs, p.pcs))) / (x.onset_ql - p.onset_ql) END AS h
  FROM per x LEFT JOIN per p ON p.piece_id = x.piece_id AND p.onset_no = x.onset_no - 1 LEFT JOIN crowd c ON c.piece_id = x.piece_id AND c.onset_no = x.onset_no)""", """
SELECT piece_id, ROUND(SUM(vertical)::DOUBLE, 5) AS vertical, ROUND(SUM(h)::DOUBLE, 5) AS horizontal FROM hor GROUP BY piece_id"""))

# --- regressions ----------------------------------------------------------

_R = lambda df, names: df.select("piece_id", *[rounded(c).alias(c) for c in names])
register("rate_regression", lambda s, d: _R(ln.rate_regression(notes(s, d), out_notes(s, d)),
                                            ["intercept", "coef_log_base", "coef_log_detail", "r2"]))
COUNT_SQL = """
ins AS (SELECT piece_id, measure_idx, onset_tick, COUNT(*) AS in_count, MIN(dur_ql) AS min_dur FROM heard GROUP BY ALL),
outs AS (SELECT piece_id, measure_idx, onset_tick, COUNT(*) AS out_count FROM out_notes GROUP BY ALL),
pairs AS (SELECT ins.*, COALESCE(out_count, 0) AS out_count FROM ins LEFT JOIN outs USING (piece_id, measure_idx, onset_tick) WHERE in_count >= COALESCE(out_count, 0))"""
register("count_tally", lambda s, d: ln.count_tally(ln.count_pairs(notes(s, d), out_notes(s, d))), with_sql(OUT_SQL, COUNT_SQL, """
SELECT piece_id, in_count, out_count, COUNT(*) AS n FROM pairs GROUP BY ALL"""))
register("count_regression", lambda s, d: _R(ln.count_regression(ln.count_pairs(notes(s, d), out_notes(s, d))),
                                             ["intercept", "coef_inverse", "coef_log_dur", "r2"]), with_sql(OUT_SQL, COUNT_SQL, """
xy AS (SELECT piece_id, out_count::DOUBLE AS y, 1.0::DOUBLE / in_count AS a, LOG2(min_dur) AS b FROM pairs),
sums AS (SELECT piece_id, AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab,
                COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS yb FROM xy GROUP BY 1),
fit AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ka, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM sums)""", """
SELECT piece_id, ROUND(ANY_VALUE(my - ka * ma - kb * mb), 6) + 0.0 AS intercept, ROUND(ANY_VALUE(ka), 6) + 0.0 AS coef_inverse,
       ROUND(ANY_VALUE(kb), 6) + 0.0 AS coef_log_dur, ROUND(1 - SUM((y - (my + ka * (a - ma) + kb * (b - mb))) ** 2) / (VAR_POP(y) * COUNT(*)), 6) + 0.0 AS r2
FROM xy JOIN fit USING (piece_id) GROUP BY piece_id"""))
register("median_filter", lambda s, d: ln.median_filter(ft.onset_rates(notes(s, d)), 8.0).withColumn("median_rate", rounded("median_rate")))
register("flow_weight_training", lambda s, d: both_modes(lambda m: ln.flow_weight_training(training(s, d).where(F.col("mode") == m))))
