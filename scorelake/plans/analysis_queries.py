"""Queries of the order-dependent chord analysis."""

from __future__ import annotations


from scorelake.operators import analysis as an
from scorelake.operators import routes as rt
from scorelake.operators import tonal as tn
from scorelake.plans.registry import joined, register, rounded, with_sql
from scorelake.plans.tonal_queries import DICT_SQL, FLOW_SQL, MATCHED_SQL, SLICE_SQL, SMEAR_SQL, matched
from scorelake.session import cut_lineage
from scorelake.sources.views import notes

#: Backwards from event to event, in a recursive table; the keys of a chord as bits.
PRUNE_SQL = """
keyed AS (SELECT chord, bit_or(1::BIGINT << (k - 1)::INT) AS m FROM (SELECT chord, DENSE_RANK() OVER (ORDER BY tonic, mode) AS k FROM dict) GROUP BY 1),
lists AS (SELECT piece_id, measure_idx, event_tick, list({c: chord, m: COALESCE(m, 0)} ORDER BY chord) AS cl
          FROM mat LEFT JOIN keyed USING (chord) GROUP BY ALL),
asked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id ORDER BY measure_idx DESC, event_tick DESC) AS r
          FROM lists JOIN (SELECT piece_id, measure_idx, event_tick FROM (SELECT *, MAX(global_idx) OVER (PARTITION BY piece_id) AS top FROM son)
                           WHERE global_idx <> top - 1) USING (piece_id, measure_idx, event_tick)),
walk AS (SELECT piece_id, r, cl, cl AS live, TRUE AS turned FROM asked WHERE r = 1
         UNION ALL
         SELECT a.piece_id, a.r, a.cl, CASE WHEN a.cl = w.cl THEN w.live ELSE
             list_filter(a.cl, lambda x: (x.m & COALESCE(list_aggregate(list_transform(w.live, lambda y: y.m), 'bit_or'), 0)) <> 0) END, a.cl <> w.cl
         FROM walk w JOIN asked a ON a.piece_id = w.piece_id AND a.r = w.r + 1),
pruned AS (SELECT a.piece_id, a.measure_idx, a.event_tick,
                  CASE WHEN turned AND a.r = MAX(a.r) FILTER (turned) OVER (PARTITION BY a.piece_id) THEN a.cl ELSE live END AS live
           FROM walk JOIN asked a USING (piece_id, r))"""
register("prune_dead_ends", lambda s, d: rt.prune_dead_ends(cut_lineage(matched(s, d))).select(
    *tn.EVENT, joined("matched", ";").alias("matched")), with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL, MATCHED_SQL, FLOW_SQL, PRUNE_SQL, """
SELECT piece_id, measure_idx, event_tick, array_to_string(list_transform(COALESCE(live, cl, []), lambda x: x.c), ';') AS matched
FROM son LEFT JOIN lists USING (piece_id, measure_idx, event_tick) LEFT JOIN pruned USING (piece_id, measure_idx, event_tick)""").replace(
    "WITH ", "WITH RECURSIVE ", 1))


def _steps(s, d):
    return rt.modulations(*rt.flow_entries(cut_lineage(matched(s, d)), tn.chord_flow(s)))


register("modulations", lambda s, d: _steps(s, d).withColumn("weight", rounded("weight")))
register("analyse", lambda s, d: an.analyse(notes(s, d), tn.chord_flow(s)).select(
    *tn.EVENT, "key", joined("chord").alias("chord"), joined("dissonance").alias("dissonance")))
register("harmony_flags", lambda s, d: an.harmony_flags(notes(s, d), an.analyse(notes(s, d), tn.chord_flow(s))).select(
    "event_id", "is_base", "is_3rd", "is_5th", "is_dissonant"))
register("chosen_modulations", lambda s, d: an.chosen_modulations(cut_lineage(an.analyse(notes(s, d), tn.chord_flow(s))), tn.chord_flow(s)).withColumn(
    "weight", rounded("weight")))
