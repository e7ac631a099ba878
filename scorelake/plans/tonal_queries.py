"""Tonal analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.operators import features as ft
from scorelake.operators import tonal as tn
from scorelake.plans.registry import OUT_SQL, joined, register, rounded, with_sql
from scorelake.session import cut_lineage
from scorelake.sources.views import notes, out_notes, sounding


def events(s, d):
    return tn.sonority_events(notes(s, d))


SLICE_SQL = """
tones AS (SELECT DISTINCT piece_id, measure_idx, (offset_ql * 1024)::BIGINT AS s, (offset_ql * 1024)::BIGINT + dur_tick AS e, octave, name, pc,
            CASE name[1] WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END AS letter
          FROM heard),
ticks AS (SELECT piece_id, measure_idx, s AS event_tick FROM tones UNION SELECT piece_id, measure_idx, s + 1024 FROM tones WHERE e - s = 2048),
sliced AS (SELECT DISTINCT t.piece_id, t.measure_idx, event_tick, octave, letter, name, pc FROM ticks t JOIN tones n
           ON n.piece_id = t.piece_id AND n.measure_idx = t.measure_idx AND n.s <= event_tick AND event_tick < n.e),
named AS (SELECT piece_id, measure_idx, event_tick, name, MIN((octave, letter, name)) AS low FROM sliced GROUP BY ALL),
ev AS (SELECT piece_id, measure_idx, event_tick, list(name ORDER BY low) AS pitches FROM named GROUP BY ALL),
bass AS (SELECT piece_id, measure_idx, event_tick, FIRST(name ORDER BY octave, pc, name) AS bass FROM sliced GROUP BY ALL),
son AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx ORDER BY event_tick) - 1 AS event_idx,
               ROW_NUMBER() OVER (PARTITION BY piece_id ORDER BY measure_idx, event_tick) - 1 AS global_idx
        FROM ev JOIN bass USING (piece_id, measure_idx, event_tick))"""
SMEAR_SQL = """
near AS (SELECT a.piece_id, a.measure_idx, a.event_tick, s.name, MIN((s.octave, s.letter, s.name)) AS low
         FROM son a JOIN son b ON b.piece_id = a.piece_id AND b.measure_idx = a.measure_idx AND ABS(b.event_idx - a.event_idx) <= 1
         JOIN sliced s ON s.piece_id = b.piece_id AND s.measure_idx = b.measure_idx AND s.event_tick = b.event_tick GROUP BY ALL),
smear AS (SELECT piece_id, measure_idx, event_tick, list(name ORDER BY low) AS smeared, array_to_string(list(name ORDER BY name), ',') AS smeared_key
          FROM near GROUP BY ALL),
full_ev AS (SELECT *, array_to_string(list_sort(pitches), ',') AS own_key FROM son JOIN smear USING (piece_id, measure_idx, event_tick))"""


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


DICT_SQL = f"""
chord_set AS (SELECT * FROM (VALUES {_values(hm.chord_sets())}) v(chord, size)),
base AS (SELECT * FROM (VALUES {_values(hm.seventh_bases())}) v(chord, base)),
hits AS (SELECT DISTINCT piece_id, measure_idx, event_tick, chord, size FROM (
    SELECT piece_id, measure_idx, event_tick, own_key AS chord FROM full_ev
    UNION SELECT piece_id, measure_idx, event_tick, smeared_key FROM full_ev) JOIN chord_set USING (chord)),
exact AS (SELECT piece_id, measure_idx, event_tick, chord, size = 3 AS matched FROM hits
          UNION SELECT piece_id, measure_idx, event_tick, base, TRUE FROM hits JOIN base USING (chord) WHERE size = 4)"""
# The note views already use the name "base".
DICT_SQL = DICT_SQL.replace("\nbase AS", "\nseven AS").replace("v(chord, base)", "v(chord, bottom)").replace(
    "event_tick, base, TRUE FROM hits JOIN base", "event_tick, bottom, TRUE FROM hits JOIN seven")

register("sonority_events", lambda s, d: events(s, d).select(
    *tn.EVENT, "event_idx", "global_idx", "bass", joined("pitches").alias("pitches")), with_sql(SLICE_SQL, """
SELECT piece_id, measure_idx, event_tick, event_idx, global_idx, bass, array_to_string(pitches, ',') AS pitches FROM son"""))
register("smear_events", lambda s, d: tn.smear_events(events(s, d)).select(*tn.EVENT, joined("smeared").alias("smeared")),
         with_sql(SLICE_SQL, SMEAR_SQL, """
SELECT piece_id, measure_idx, event_tick, array_to_string(smeared, ',') AS smeared FROM full_ev"""))
register("events_between", lambda s, d: tn.events_between(events(s, d), (3, 1.5), (9, 2.0)).select(*tn.EVENT, "event_idx"),
         with_sql(SLICE_SQL, """
SELECT piece_id, measure_idx, event_tick, event_idx FROM son
WHERE (measure_idx > 3 OR (measure_idx = 3 AND event_tick / 1024 >= 1.5))
  AND (measure_idx < 9 OR (measure_idx = 9 AND event_tick / 1024 < 2.0))"""))
register("chordify", lambda s, d: tn.chordify(notes(s, d)).withColumn("pcs", joined("pcs")), with_sql(SLICE_SQL, """
SELECT t.piece_id, t.measure_idx, t.event_tick, array_to_string(list_sort(list(DISTINCT pc)), ',') AS pcs
FROM (SELECT DISTINCT piece_id, measure_idx, s AS event_tick FROM tones) t JOIN tones n
  ON n.piece_id = t.piece_id AND n.measure_idx = t.measure_idx AND n.s <= t.event_tick AND t.event_tick < n.e
GROUP BY ALL"""))


def exact(s, d):
    return tn.match_exact(tn.smear_events(events(s, d)))


register("match_exact", exact, with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL,
                                        "SELECT piece_id, measure_idx, event_tick, chord, matched FROM exact"))


def _candidates(s, d):
    sm = tn.smear_events(events(s, d))
    return tn.match_candidates(sm, tn.bar_candidates(tn.match_exact(sm))).select(
        *tn.EVENT, F.explode("fitting").alias("chord"), "smeared").select(
        *tn.EVENT, "chord", joined(tn.bass_first(F.col("chord"), F.col("smeared"))).alias("ordered"))


register("match_candidates", _candidates, with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL, """
SELECT e.piece_id, e.measure_idx, e.event_tick, c.chord,
  array_to_string(list_concat(list_filter(smeared, lambda x: list_contains(string_split(c.chord, ','), x)),
    list_filter(string_split(c.chord, ','), lambda x: NOT list_contains(smeared, x))), ',') AS ordered
FROM full_ev e JOIN (SELECT DISTINCT piece_id, measure_idx, chord FROM exact WHERE len(string_split(chord, ',')) <> 4) c
  ON c.piece_id = e.piece_id AND c.measure_idx = e.measure_idx
WHERE len(list_filter(string_split(c.chord, ','), lambda x: NOT list_contains(smeared, x))) <= 1"""))
register("match_partial", lambda s, d: tn.smear_events(events(s, d)).select(
    *tn.EVENT, F.explode(tn.match_partial(F.col("smeared"))).alias("chord")), with_sql(SLICE_SQL, SMEAR_SQL, f"""
triad AS (SELECT * FROM (VALUES {_values([(t,) for t in hm.triads()])}) v(chord)),
tone AS (SELECT chord, UNNEST(string_split(chord, ',')) AS name FROM triad)""", """
SELECT n.piece_id, n.measure_idx, n.event_tick, t.chord FROM near n JOIN tone t USING (name) GROUP BY ALL HAVING COUNT(*) >= 2"""))


def matched(s, d):
    return tn.matched_events(events(s, d))


MATCHED_SQL = f"""
cand AS (SELECT DISTINCT piece_id, measure_idx, chord FROM exact WHERE len(string_split(chord, ',')) <> 4),
triad AS (SELECT * FROM (VALUES {_values([(t,) for t in hm.triads()])}) v(chord)),
tone AS (SELECT chord, UNNEST(string_split(chord, ',')) AS name FROM triad),
fit AS (SELECT e.piece_id, e.measure_idx, e.event_tick, c.chord FROM full_ev e JOIN cand c USING (piece_id, measure_idx)
        WHERE len(list_filter(string_split(c.chord, ','), lambda x: NOT list_contains(e.smeared, x))) <= 1),
part AS (SELECT piece_id, measure_idx, event_tick, chord
         FROM (SELECT * FROM near ANTI JOIN fit USING (piece_id, measure_idx, event_tick)) JOIN tone USING (name)
         JOIN (SELECT piece_id, measure_idx, event_tick FROM full_ev WHERE len(pitches) <> 1) USING (piece_id, measure_idx, event_tick)
         GROUP BY ALL HAVING COUNT(*) >= 2),
cand2 AS (SELECT * FROM cand UNION SELECT piece_id, measure_idx, chord FROM part),
fit2 AS (SELECT e.piece_id, e.measure_idx, e.event_tick, c.chord FROM full_ev e JOIN cand2 c USING (piece_id, measure_idx)
         WHERE len(list_filter(string_split(c.chord, ','), lambda x: NOT list_contains(e.smeared, x))) <= 1),
mat AS (SELECT * FROM fit2 UNION SELECT piece_id, measure_idx, event_tick, chord FROM exact ANTI JOIN fit2 USING (piece_id, measure_idx, event_tick) WHERE matched)"""

register("matched_events", lambda s, d: matched(s, d).select(*tn.EVENT, joined("matched", ";").alias("matched")), with_sql(
    SLICE_SQL, SMEAR_SQL, DICT_SQL, MATCHED_SQL, """
SELECT piece_id, measure_idx, event_tick, COALESCE(string_agg(chord, ';' ORDER BY chord), '') AS matched
FROM full_ev LEFT JOIN mat USING (piece_id, measure_idx, event_tick) GROUP BY ALL"""))

FLOW_SQL = f"""
dict AS (SELECT * FROM (VALUES {_values([(t, m, n, hm.set_key(c)) for t, m, n, r, c in hm.chord_dictionary() if r])}) v(tonic, mode, numeral, chord)),
weight AS (SELECT * FROM (VALUES {_values([(*k, w) for k, w in hm.rule_weights().items()])}) v(mode, a, b, w)),
flow AS (SELECT x.tonic, x.mode, x.chord AS from_chord, y.chord AS to_chord, x.numeral AS from_numeral, y.numeral AS to_numeral,
                CASE WHEN x.numeral = y.numeral THEN 0 ELSE w END::DOUBLE AS weight
         FROM dict x JOIN dict y USING (tonic, mode) JOIN weight ON weight.mode = x.mode AND a = x.numeral AND b = y.numeral)"""


def triad_events(s, d):
    """Exact triads per event, a simple stand-in for full matching."""
    e = exact(s, d).where("matched").groupBy(*tn.EVENT).agg(F.array_sort(F.collect_set("chord")).alias("matched"))
    return events(s, d).join(e, tn.EVENT, "left").withColumn(
        "matched", F.coalesce("matched", F.array().cast("array<string>")))


# Chord flow over the chords the corpus really contains.
register("chord_flow", lambda s, d: tn.chord_flow(s).join(
    exact(s, d).where("matched").select(F.col("chord").alias("from_chord")).distinct(), "from_chord", "left_semi").select(
    "from_chord", "to_chord", "tonic", "mode", "from_numeral", "to_numeral", "weight"),
    with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL, FLOW_SQL, """
SELECT from_chord, to_chord, tonic, mode, from_numeral, to_numeral, weight FROM flow
WHERE from_chord IN (SELECT chord FROM exact WHERE matched)"""))
register("best_flow", lambda s, d: tn.best_flow(cut_lineage(matched(s, d)), tn.chord_flow(s)), with_sql(
    SLICE_SQL, SMEAR_SQL, DICT_SQL, MATCHED_SQL, FLOW_SQL, """
linked AS (SELECT *, LEAD(event_tick) OVER w AS n_tick, LEAD(measure_idx) OVER w AS n_bar FROM son
           WINDOW w AS (PARTITION BY piece_id ORDER BY measure_idx, event_tick)),
scored AS (SELECT l.piece_id, l.measure_idx, l.event_tick, f.* FROM linked l
  JOIN mat a ON a.piece_id = l.piece_id AND a.measure_idx = l.measure_idx AND a.event_tick = l.event_tick
  JOIN mat b ON b.piece_id = l.piece_id AND b.measure_idx = l.n_bar AND b.event_tick = l.n_tick
  JOIN flow f ON f.from_chord = a.chord AND f.to_chord = b.chord)""", """
SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx, event_tick, from_chord, tonic, mode
  ORDER BY weight DESC, to_chord) AS k FROM scored) WHERE k = 1"""))


def _sevenths(s, d):
    chords = matched(s, d).select(*tn.EVENT, "pitches", F.explode("matched").alias("chord"))
    return tn.sevenths_in_key(chords, tn.chord_flow(s)).select(*tn.EVENT, "chord", "seventh", "tonic", "mode")


register("resolve_seventh", _sevenths, with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL, MATCHED_SQL, FLOW_SQL, """
SELECT e.piece_id, e.measure_idx, e.event_tick, x.chord, s.chord AS seventh, f.tonic, f.mode
FROM full_ev e JOIN mat x USING (piece_id, measure_idx, event_tick) JOIN seven s ON s.bottom = x.chord
JOIN flow f ON f.from_chord = x.chord AND f.to_chord = s.chord
WHERE list_contains(pitches, list_filter(string_split(s.chord, ','), lambda t: NOT list_contains(string_split(x.chord, ','), t))[1])"""))


def _missing(s, d):
    found = events(s, d).select(tn.chord_key(F.col("pitches")).alias("chord")).groupBy("chord").agg(F.count(F.lit(1)).alias("n_events"))
    return tn.missing_chords(s, tn.chord_flow(s)).join(found, "chord", "left").na.fill(0, ["n_events"])


register("missing_chords", _missing, with_sql(SLICE_SQL, SMEAR_SQL, FLOW_SQL, f"""
basic AS (SELECT * FROM (VALUES {_values(hm.basic_chords())}) v(root, type, chord))""", """
SELECT root, type, chord, (SELECT COUNT(*) FROM full_ev WHERE own_key = chord) AS n_events FROM basic
WHERE chord NOT IN (SELECT from_chord FROM flow)"""))

# One chord per event: the first exact triad.
FIRST_SQL = """
first_chord AS (SELECT s.*, x.chord FROM full_ev s LEFT JOIN (
  SELECT piece_id, measure_idx, event_tick, MIN(chord) AS chord FROM exact WHERE matched GROUP BY ALL) x
  USING (piece_id, measure_idx, event_tick))"""


def chord_events(s, d):
    return triad_events(s, d).withColumn("chord", F.get("matched", 0))


register("mark_repeated_chords", lambda s, d: tn.mark_repeated_chords(chord_events(s, d)).select(*tn.EVENT, "duplicated"),
         with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL, FIRST_SQL, """
SELECT piece_id, measure_idx, event_tick,
  COALESCE(chord, '') = LAG(COALESCE(chord, ''), 1, '') OVER (PARTITION BY piece_id, measure_idx ORDER BY event_tick) AS duplicated
FROM first_chord"""))
register("analysis_result", lambda s, d: tn.analysis_result(chord_events(s, d)), with_sql(
    SLICE_SQL, SMEAR_SQL, DICT_SQL, FIRST_SQL, """
SELECT piece_id, global_idx, array_to_string(pitches, ',') AS pitches, CASE WHEN chord IS NULL THEN 'n/a' ELSE
  array_to_string(list_concat(list_filter(pitches, lambda x: list_contains(string_split(chord, ','), x)),
    list_filter(string_split(chord, ','), lambda x: NOT list_contains(pitches, x))), ',') END AS chord FROM first_chord"""))
register("resolve_dissonance", lambda s, d: chord_events(s, d).where(F.col("chord").isNotNull()).select(
    *tn.EVENT, joined(tn.outside_tones(F.col("pitches"), tn.key_tones(F.col("chord")))).alias("dissonance")), with_sql(
    SLICE_SQL, SMEAR_SQL, DICT_SQL, FIRST_SQL, """
SELECT piece_id, measure_idx, event_tick,
  array_to_string(list_filter(pitches, lambda x: NOT list_contains(string_split(chord, ','), x)), ',') AS dissonance
FROM first_chord WHERE chord IS NOT NULL"""))


def _inversions(s, d):
    c = chord_events(s, d).where(F.col("chord").isNotNull())
    tones = tn.key_tones(F.col("chord"))
    return c.select(*tn.EVENT, tn.chord_inversion(tones, F.col("bass")).alias("inversion"),
                    joined(tn.in_inversion(tones, F.col("bass"))).alias("spelled"))


register("chord_inversion", _inversions, with_sql(SLICE_SQL, SMEAR_SQL, DICT_SQL, FIRST_SQL, """
c AS (SELECT *, string_split(chord, ',') AS t, COALESCE(list_position(string_split(chord, ','), bass), 0) AS p
      FROM first_chord WHERE chord IS NOT NULL)""", """
SELECT piece_id, measure_idx, event_tick, CASE p WHEN 1 THEN 'root' WHEN 2 THEN 'first' WHEN 3 THEN 'second' WHEN 4 THEN 'third' ELSE 'undecided' END AS inversion,
  array_to_string(CASE WHEN p >= 1 THEN list_concat(t[p:], t[:p - 1]) ELSE t END, ',') AS spelled FROM c"""))
#: The profiles again, as values of their own: (mode, step above the tonic, weight).
KEY_SQL = """
profile AS (SELECT mode, UNNEST(range(12)) AS step, UNNEST(w) AS w FROM (VALUES
  ('major', [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]),
  ('minor', [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])) v(mode, w)),
counted AS (SELECT piece_id, measure_idx, k.pc, COUNT(h.pc) AS n
            FROM (SELECT DISTINCT piece_id, measure_idx, UNNEST(range(12)) AS pc FROM heard) k
            LEFT JOIN heard h USING (piece_id, measure_idx, pc) GROUP BY ALL),
fits AS (SELECT piece_id, measure_idx, t.tonic_pc, mode, CASE WHEN VAR_POP(n) = 0 THEN 0.0 ELSE CORR(n, w::DOUBLE) END AS r
         FROM counted JOIN (SELECT UNNEST(range(12)) AS tonic_pc) t ON TRUE JOIN profile ON step = (pc - t.tonic_pc + 12) % 12 GROUP BY ALL)"""
register("key_estimate", lambda s, d: tn.key_estimate(ft.bar_histogram(notes(s, d))).withColumn(
    "correlation", rounded("correlation")), with_sql(KEY_SQL, """
SELECT piece_id, measure_idx, tonic_pc::INT AS tonic_pc, mode, ROUND(r, 6) + 0.0 AS correlation
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx ORDER BY ROUND(r, 9) DESC, tonic_pc, mode DESC) AS best FROM fits) WHERE best = 1"""))

# --- numerals -------------------------------------------------------------


def corpus(s, d):
    """A harmony corpus read off the notes: each part of a piece is a section,
    its key follows from the part, and each note names a chord."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    n = sounding(notes(s, d))
    root = F.when(F.col("event_id") % 17 == 0, "X").otherwise(F.col("name"))
    quality = F.when(F.col("event_id") % 17 == 0, pick(["Ger6", "Fr6", "It6"], F.col("event_id"))).otherwise(
        pick(["maj", "min", "dim", "dom7", "min7", "hdim", "fdim"], F.col("event_id")))
    mode = F.when((F.col("piece_id") + F.col("part_idx")) % 2 == 0, "Major").otherwise("Minor")
    return n.select("piece_id", "part_idx", "measure_idx", "onset_tick", "event_id",
                    pick(["C", "G", "D", "A"], F.col("part_idx")).alias("tonic"), mode.alias("mode"),
                    root.alias("root"), quality.alias("quality"), (F.col("event_id") % 4).cast("int").alias("inversion"))


def numerals(s, d):
    c = corpus(s, d)
    return c.withColumn("roman", tn.roman_name(*[F.col(x) for x in ("root", "quality", "inversion", "tonic", "mode")]))


CORPUS_SQL = """
corp AS (
  SELECT piece_id, part_idx, measure_idx, onset_tick, event_id, ['C','G','D','A'][part_idx % 4 + 1] AS tonic,
    CASE WHEN (piece_id + part_idx) % 2 = 0 THEN 'Major' ELSE 'Minor' END AS mode,
    CASE WHEN event_id % 17 = 0 THEN 'X' ELSE name END AS root,
    CASE WHEN event_id % 17 = 0 THEN ['Ger6','Fr6','It6'][event_id % 3 + 1]
         ELSE ['maj','min','dim','dom7','min7','hdim','fdim'][event_id % 7 + 1] END AS quality,
    (event_id % 4)::INT AS inversion, pc FROM heard),
placed AS (
  SELECT *, (ascii(root) - ascii(tonic) + 14) % 7 AS st, (pc - CASE tonic WHEN 'C' THEN 0 WHEN 'G' THEN 7 WHEN 'D' THEN 2 ELSE 9 END + 12) % 12 AS se FROM corp),
rooted AS (
  SELECT *, CASE mode || st || ',' || se """ + " ".join(
    f"WHEN '{m}{hm.INTERVALS[i][0]},{hm.INTERVALS[i][1]}' THEN '{n}'" for m, row in hm.ROOT_NUMERALS.items() for i, n in row.items()) + """ END AS num,
    CASE WHEN quality IN ('maj','min','dim') THEN ['', '6', '64', ''][inversion + 1]
         WHEN quality IN ('min7','hdim','fdim','dom7') THEN ['7', '65', '43', '42'][inversion + 1] ELSE '' END AS fig FROM placed),
romans AS (
  SELECT *, CASE WHEN root = 'X' THEN CASE quality WHEN 'Ger6' THEN 'gerVI' WHEN 'Fr6' THEN 'freVI' ELSE 'itaVI' END
    WHEN num IS NULL THEN NULL
    ELSE CASE WHEN num = 'VII' AND quality IN ('hdim', 'fdim') THEN 'dim' ELSE '' END
      || CASE WHEN num = 'I' AND fig = '64' THEN 'V' ELSE num END
      || CASE WHEN mode = 'Minor' AND ((num IN ('I', 'IV') AND quality = 'maj') OR (num = 'V' AND quality IN ('maj', 'dom7'))) THEN '+' ELSE '' END
      || fig END AS roman FROM rooted)"""
_KNOWN = "CASE " + " ".join(f"WHEN mode = '{m}' AND roman IN ({', '.join(repr(x) for x in hm.numeral_names(m))}) THEN roman"
                            for m in hm.NUMERALS) + " ELSE 'N/A' END"
GRAM_SQL = f"""
indexed AS (SELECT *, {_KNOWN} AS numeral FROM romans),
grams AS (SELECT * FROM (SELECT piece_id, part_idx, event_id, mode, LAG(numeral) OVER w AS from_numeral, numeral AS to_numeral FROM indexed
          WINDOW w AS (PARTITION BY piece_id, part_idx ORDER BY measure_idx, onset_tick, event_id)) WHERE from_numeral IS NOT NULL)"""

register("roman_name", lambda s, d: numerals(s, d).select("event_id", "roman"), with_sql(CORPUS_SQL, "SELECT event_id, roman FROM romans"))


def grams(s, d):
    n = numerals(s, d).withColumn("numeral", tn.known_numeral(F.col("roman"), F.col("mode")))
    return tn.transition_ngrams(n, ["piece_id", "part_idx"], ["measure_idx"], ["onset_tick", "event_id"])


register("transition_ngrams", lambda s, d: grams(s, d).select("event_id", "mode", "from_numeral", "to_numeral"),
         with_sql(CORPUS_SQL, GRAM_SQL, "SELECT event_id, mode, from_numeral, to_numeral FROM grams"))


def training(s, d):
    return tn.transition_training_set(grams(s, d))


TRAIN_SQL = f"""
reread AS (SELECT * FROM (VALUES {_values([(m, a, t, om, b) for m in hm.NUMERALS for a, t, om, b in hm.rereadings(m)])}) v(mode, a, tonic, other_mode, b)),
train AS (
  SELECT from_numeral, to_numeral, 'Yes' AS match, mode FROM grams
  UNION ALL
  SELECT x.b, y.b, 'No', x.other_mode FROM grams g JOIN reread x ON x.mode = g.mode AND x.a = g.from_numeral
  JOIN reread y ON y.mode = g.mode AND y.a = g.to_numeral AND y.tonic = x.tonic AND y.other_mode = x.other_mode)"""
register("transition_training_set", lambda s, d: training(s, d).groupBy("from_numeral", "to_numeral", "trans", "match", "mode").agg(
    F.count(F.lit(1)).alias("n")), with_sql(CORPUS_SQL, GRAM_SQL, TRAIN_SQL, """
SELECT from_numeral, to_numeral, from_numeral || '-' || to_numeral AS trans, match, mode, COUNT(*) AS n FROM train
WHERE from_numeral <> 'N/A' AND to_numeral <> 'N/A' GROUP BY ALL"""))

# --- evaluation: chords of the arrangement judged against the score ---------


def judged(s, d):
    gold = events(s, d).where(F.size("pitches") >= 3).select(*tn.EVENT, F.col("pitches").alias("gold"))
    out = out_notes(s, d).withColumn("is_rest", F.lit(False))
    said = tn.sonority_events(out).select(*tn.EVENT, F.when(F.size("pitches").isin(3, 4), F.col("pitches")).alias("recognised"),
                                          F.col("pitches").alias("heard"))
    return gold.join(said, tn.EVENT).withColumn(
        "verdict", tn.chord_verdict(F.col("recognised"), F.col("gold"), F.col("heard")))


def _slice_sql(source, p):
    """The slice CTEs over another note table, with prefixed names."""
    out = SLICE_SQL.replace("FROM heard", f"FROM {source}")
    for name in ("tones", "ticks", "sliced", "named", "ev", "bass", "son"):
        out = out.replace(f"\n{name} AS", f"\n{p}{name} AS").replace(f"FROM {name} ", f"FROM {p}{name} ").replace(
            f"FROM {name})", f"FROM {p}{name})").replace(f"JOIN {name} ", f"JOIN {p}{name} ")
    return out


JUDGE_SQL = """
pairs AS (SELECT g.piece_id, g.pitches AS gold, CASE WHEN len(o.pitches) IN (3, 4) THEN o.pitches END AS rec, o.pitches AS hrd
          FROM son g JOIN o_son o USING (piece_id, measure_idx, event_tick) WHERE len(g.pitches) >= 3),
judge AS (SELECT *, CASE WHEN rec IS NULL THEN NULL
    WHEN len(list_intersect(rec, gold)) = len(rec) AND rec[1] = gold[1] THEN 'exact'
    WHEN len(list_intersect(rec, gold)) = len(rec) THEN 'wrong_bass'
    WHEN len(rec) = 4 AND len(rec) - len(list_intersect(rec, gold)) = 1 THEN 'overly'
    WHEN list_sort(list_filter(hrd, lambda x: NOT list_contains(rec, x))) = list_sort(list_filter(hrd, lambda x: NOT list_contains(gold, x))) THEN 'same_function'
    ELSE 'wrong' END AS verdict FROM pairs),
counts AS (SELECT piece_id, COUNT(*) AS events, COUNT(verdict) AS recognised, """ + ", ".join(
    f"COUNT(*) FILTER (verdict = '{v}') AS {v}" for v in tn.VERDICTS) + " FROM judge GROUP BY ROLLUP (piece_id))"
_RATES = [f"{n}_of_{d}" for n in ("hard", "medium", "soft") for d in ("recognised", "events")]
register("chord_eval", lambda s, d: tn.chord_eval(judged(s, d), "piece_id").select(
    "piece_id", "events", "recognised", *tn.VERDICTS, *[rounded(r).alias(r) for r in _RATES]), with_sql(
    OUT_SQL, SLICE_SQL, _slice_sql("out_notes", "o_"), JUDGE_SQL, "SELECT *, " + ", ".join(
        f"ROUND(CASE WHEN {dn} > 0 THEN ({h}) / {dn} END, 6) AS {n}_of_{dn}"
        for n, h in (("hard", "exact"), ("medium", "exact + overly + same_function"), ("soft", "exact + overly + same_function + wrong_bass"))
        for dn in ("recognised", "events")) + " FROM counts"))
register("chord_eval_total", lambda s, d: tn.chord_eval_total(judged(s, d), "piece_id"), with_sql(
    OUT_SQL, SLICE_SQL, _slice_sql("out_notes", "o_"), JUDGE_SQL, "SELECT events, recognised, " + ", ".join(tn.VERDICTS)
    + ", ROUND(recognised / events * 100, 2) AS recognised_percent, "
    + ", ".join(f"ROUND({v} / recognised * 100, 2) AS {v}_percent" for v in tn.VERDICTS) + " FROM counts WHERE piece_id IS NULL"))
