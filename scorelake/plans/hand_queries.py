"""Two-hand reduction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import hands as hd
from scorelake.operators import staves as st
from scorelake.plans.align_queries import mapping
from scorelake.plans.registry import joined, register, rounded, with_sql
from scorelake.sources.views import notes, sounding


def groups(s, d):
    return hd.onset_groups(notes(s, d))


GROUP_SQL = """
marked AS (
  SELECT *, CASE WHEN COALESCE(tie IN ('continue', 'stop') AND LAG(tie) OVER w IN ('start', 'continue')
                   AND LAG(onset_tick + dur_tick) OVER w = onset_tick, FALSE) THEN 0 ELSE 1 END AS fresh
  FROM heard WINDOW w AS (PARTITION BY piece_id, part_idx, voice, measure_idx, ps ORDER BY onset_tick, event_id)),
islands AS (SELECT *, SUM(fresh) OVER (PARTITION BY piece_id, part_idx, voice, measure_idx, ps ORDER BY onset_tick, event_id) AS island FROM marked),
grp AS (
  SELECT piece_id, part_idx, voice, measure_idx, ps, ps % 12 AS pc, MIN(onset_tick) AS onset_tick, MIN(onset_ql) AS onset_ql,
         FIRST(event_id ORDER BY onset_tick, event_id) AS event_id, SUM(dur_tick)::BIGINT AS dur_tick, SUM(dur_ql) AS dur_ql
  FROM islands GROUP BY piece_id, part_idx, voice, measure_idx, ps, island),
frame AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, onset_tick, dur_tick, ps ORDER BY event_id) AS k FROM grp) WHERE k = 1)"""
HANDS_SQL = """
split AS (
  SELECT *, CASE WHEN hi - lo <= 7 THEN CASE WHEN lo < 60 THEN 'L' ELSE 'R' END
                 WHEN ps - lo <= 7 THEN 'L' ELSE 'R' END AS hand0
  FROM (SELECT *, MIN(ps) OVER f AS lo, MAX(ps) OVER f AS hi FROM frame WINDOW f AS (PARTITION BY piece_id, onset_tick))),
finger0 AS (
  SELECT *, CASE WHEN hand0 = 'L' AND lowr <= 5 THEN LEAST(size, 5) - lowr + 1
                 WHEN hand0 = 'R' AND highr <= 5 THEN LEAST(size, 5) - highr + 1 END::INT AS finger
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, onset_tick, hand0 ORDER BY ps, event_id) AS lowr,
               ROW_NUMBER() OVER (PARTITION BY piece_id, onset_tick, hand0 ORDER BY ps DESC, event_id DESC) AS highr,
               COUNT(*) OVER (PARTITION BY piece_id, onset_tick, hand0) AS size FROM split)),
fingered AS (SELECT *, CASE WHEN finger IS NOT NULL THEN hand0 END AS hand FROM finger0)"""

register("onset_groups", lambda s, d: groups(s, d).select("event_id", "onset_tick", "dur_tick", "ps"),
         with_sql(GROUP_SQL, "SELECT event_id, onset_tick, dur_tick, ps FROM grp"))
register("drop_repeated", lambda s, d: hd.drop_repeated(groups(s, d)).select("event_id", "deleted"), with_sql(GROUP_SQL, """
SELECT event_id, event_id <> MIN(event_id) OVER (PARTITION BY piece_id, onset_tick, dur_tick, ps) AS deleted FROM grp"""))
register("hand_clusters", lambda s, d: hd.hand_clusters(groups(s, d)), with_sql(GROUP_SQL, """
tones AS (SELECT DISTINCT piece_id, onset_tick, ps FROM grp WHERE ps BETWEEN 12 AND 96),
walk AS (
  SELECT piece_id, onset_tick, MIN(ps) AS low, 1 AS n FROM tones GROUP BY ALL
  UNION ALL
  SELECT * FROM (SELECT w.piece_id, w.onset_tick, MIN(t.ps) AS low, w.n + 1 AS n
   FROM walk w JOIN tones t ON t.piece_id = w.piece_id AND t.onset_tick = w.onset_tick AND t.ps - w.low > 13
   GROUP BY w.piece_id, w.onset_tick, w.n))""", """
SELECT piece_id, onset_tick, MAX(n)::INT AS clusters FROM walk GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1))

THIN_SQL = """
placed AS (SELECT *, ROW_NUMBER() OVER w - 1 AS pos, LEAD(ps) OVER w AS above, FIRST(ps) OVER w AS lowest FROM frame
           WINDOW w AS (PARTITION BY piece_id, onset_tick ORDER BY ps, event_id, dur_tick)),
nth AS (SELECT *, CASE WHEN above % 12 = lowest % 12 THEN COUNT(*) FILTER (above % 12 = lowest % 12) OVER (
                       PARTITION BY piece_id, onset_tick ORDER BY pos) END AS nth FROM placed),
tries AS (SELECT piece_id, onset_tick, UNNEST(range(0, n + 1)) AS k FROM (SELECT piece_id, onset_tick, COUNT(nth) AS n FROM nth GROUP BY ALL)),
heard_k AS (SELECT n.piece_id, n.onset_tick, k, ps FROM nth n JOIN tries USING (piece_id, onset_tick) WHERE nth IS NULL OR nth > k),
walk AS (
  SELECT piece_id, onset_tick, k, MIN(ps) AS low, 1 AS n FROM heard_k GROUP BY ALL
  UNION ALL
  SELECT * FROM (SELECT w.piece_id, w.onset_tick, w.k, MIN(t.ps) AS low, w.n + 1 AS n
   FROM walk w JOIN heard_k t ON t.piece_id = w.piece_id AND t.onset_tick = w.onset_tick AND t.k = w.k AND t.ps - w.low > 13
   GROUP BY w.piece_id, w.onset_tick, w.k, w.n)),
counts AS (SELECT piece_id, onset_tick, k, MAX(n) AS n FROM walk GROUP BY ALL),
chosen AS (SELECT piece_id, onset_tick, COALESCE(MIN(k) FILTER (n <= 2), MAX(k)) AS k, MIN(n) > 2 AS wide FROM counts GROUP BY ALL),
flagged AS (SELECT n.*, wide, COALESCE(nth <= k, FALSE) AS deleted FROM nth n JOIN chosen USING (piece_id, onset_tick)),
gaps AS (SELECT *, LEAD(ps) OVER (PARTITION BY piece_id, onset_tick, deleted ORDER BY pos) - ps AS gap FROM flagged),
risen AS (SELECT *, SUM(COALESCE(gap - gap % 12, 0)) OVER (PARTITION BY piece_id, onset_tick, deleted ORDER BY pos
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rise FROM gaps)"""
register("thin_frames", lambda s, d: hd.thin_frames(hd.frame_notes(groups(s, d))).select("event_id", "old_ps", "ps", "deleted"),
         with_sql(GROUP_SQL, THIN_SQL, """
SELECT event_id, ps::INT AS old_ps, (ps + CASE WHEN wide AND NOT deleted THEN rise ELSE 0 END)::INT AS ps, deleted FROM risen""")
         .replace("WITH ", "WITH RECURSIVE ", 1))


def frame(s, d):
    return hd.frame_notes(groups(s, d))


def fingered(s, d):
    return hd.initial_fingering(hd.split_hands(frame(s, d)))


register("split_hands", lambda s, d: hd.split_hands(frame(s, d)).select("event_id", "hand"),
         with_sql(GROUP_SQL, HANDS_SQL, "SELECT event_id, hand0 AS hand FROM split"))
register("initial_fingering", lambda s, d: fingered(s, d).select("event_id", "hand", "finger"),
         with_sql(GROUP_SQL, HANDS_SQL, "SELECT event_id, hand, finger FROM fingered"))

COST_SQL = """
fr AS (SELECT *, LAG(onset_tick) OVER w AS prev_tick, LEAD(onset_tick) OVER w AS next_tick, LEAD(onset_ql) OVER w - onset_ql AS len
       FROM (SELECT DISTINCT piece_id, onset_tick, onset_ql FROM grp) WINDOW w AS (PARTITION BY piece_id ORDER BY onset_tick)),
placed AS (SELECT piece_id, onset_tick, hand, finger, ps FROM fingered WHERE finger IS NOT NULL),
size AS (SELECT piece_id, onset_tick, COUNT(*) AS n FROM placed GROUP BY ALL),
middle AS (SELECT piece_id, onset_tick, hand, MEDIAN(ps) AS m FROM placed GROUP BY ALL),
moved AS (
  SELECT f.piece_id, f.onset_tick, SUM(COALESCE(ABS(p.ps - COALESCE(q.ps, m.m)) / 2, 0)) AS movement
  FROM fr f JOIN placed p USING (piece_id, onset_tick)
  LEFT JOIN placed q ON q.piece_id = f.piece_id AND q.onset_tick = f.prev_tick AND q.hand = p.hand AND q.finger = p.finger
  LEFT JOIN middle m ON m.piece_id = f.piece_id AND m.onset_tick = f.prev_tick AND m.hand = p.hand GROUP BY ALL),
cost AS (
  SELECT f.piece_id, f.onset_tick, f.prev_tick,
         (5 * COALESCE(a.n, 0) + COALESCE(b.n, 0) + COALESCE(c.n, 0) + COALESCE(movement, 0)) / len AS cost
  FROM fr f LEFT JOIN moved USING (piece_id, onset_tick) LEFT JOIN size a USING (piece_id, onset_tick)
  LEFT JOIN size b ON b.piece_id = f.piece_id AND b.onset_tick = f.prev_tick
  LEFT JOIN size c ON c.piece_id = f.piece_id AND c.onset_tick = f.next_tick
  WHERE f.prev_tick IS NOT NULL AND f.next_tick IS NOT NULL)"""


def costs(s, d):
    return hd.frame_cost(hd.finger_frames(fingered(s, d)))


register("frame_cost", lambda s, d: costs(s, d).where(F.col("cost").isNotNull()).select("piece_id", "onset_tick", rounded("cost").alias("cost")),
         with_sql(GROUP_SQL, HANDS_SQL, COST_SQL, "SELECT piece_id, onset_tick, ROUND(cost, 6) AS cost FROM cost"))
register("total_cost", lambda s, d: hd.total_cost(costs(s, d)).select("piece_id", rounded("total_cost", 4).alias("total_cost")),
         with_sql(GROUP_SQL, HANDS_SQL, COST_SQL, "SELECT piece_id, ROUND(SUM(cost), 4) AS total_cost FROM cost GROUP BY piece_id"))
register("windowed_cost", lambda s, d: hd.windowed_cost(costs(s, d)).withColumn(
    "windowed_cost", rounded("windowed_cost")), with_sql(GROUP_SQL, HANDS_SQL, COST_SQL, """
SELECT f.piece_id, f.onset_tick, ROUND(COALESCE(a.cost, 0) + COALESCE(b.cost, 0), 6) AS windowed_cost
FROM fr f LEFT JOIN cost a USING (piece_id, onset_tick)
LEFT JOIN cost b ON b.piece_id = f.piece_id AND b.onset_tick = f.prev_tick"""))
register("costly_frames", lambda s, d: hd.costly_frames(costs(s, d)).select(
    "piece_id", "onset_tick", rounded("z_score").alias("z_score")), with_sql(GROUP_SQL, HANDS_SQL, COST_SQL, """
SELECT piece_id, onset_tick, ROUND(z, 6) AS z_score FROM (
  SELECT *, (cost - AVG(cost) OVER p) / STDDEV_POP(cost) OVER p AS z FROM cost WINDOW p AS (PARTITION BY piece_id)) WHERE z >= 0"""))

ROLL_SQL = """
frames AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id ORDER BY onset_tick) - 1 AS frame_idx
           FROM (SELECT DISTINCT piece_id, onset_tick FROM grp)),
roll AS (SELECT DISTINCT piece_id, frame_idx, ps FROM grp JOIN frames USING (piece_id, onset_tick))"""


def roll(s, d):
    return hd.frame_roll(groups(s, d))


register("triad_patterns", lambda s, d: hd.triad_patterns(roll(s, d)), with_sql(GROUP_SQL, ROLL_SQL, """
SELECT a.piece_id, a.frame_idx, a.ps AS root, b.ps AS third, c.ps AS fifth
FROM roll a JOIN roll b ON b.piece_id = a.piece_id AND b.frame_idx = a.frame_idx AND b.ps - a.ps IN (3, 4)
JOIN roll c ON c.piece_id = a.piece_id AND c.frame_idx = a.frame_idx AND c.ps - a.ps IN (6, 7, 8)"""))
register("repeat_runs", lambda s, d: hd.repeat_runs(roll(s, d), 2), with_sql(GROUP_SQL, ROLL_SQL, """
SELECT piece_id, ps, MIN(frame_idx) AS first_frame, COUNT(*) AS length FROM (
  SELECT *, frame_idx - ROW_NUMBER() OVER (PARTITION BY piece_id, ps ORDER BY frame_idx) AS island FROM roll)
GROUP BY piece_id, ps, island HAVING COUNT(*) >= 2"""))
for _name, _dir in (("diagonals_right", 1), ("diagonals_left", -1)):
    register(_name, lambda s, d, k=_dir: hd.diagonals(roll(s, d), k), with_sql(GROUP_SQL, ROLL_SQL, f"""
steps AS (SELECT a.piece_id, a.frame_idx, a.ps, b.frame_idx AS to_frame, b.ps AS to_ps FROM roll a JOIN roll b
  ON a.piece_id = b.piece_id AND b.frame_idx - a.frame_idx IN (1, 2) AND {_dir} * (b.ps - a.ps) IN (1, 2, 3)),
ahead AS (SELECT s.piece_id, s.frame_idx, s.ps, MAX(CASE WHEN t.ps IS NULL THEN 2 ELSE 3 END) AS n FROM steps s
  LEFT JOIN steps t ON t.piece_id = s.piece_id AND t.frame_idx = s.to_frame AND t.ps = s.to_ps GROUP BY ALL),
back AS (SELECT s.piece_id, s.to_frame, s.to_ps, MAX(CASE WHEN t.ps IS NULL THEN 2 ELSE 3 END) AS n FROM steps s
  LEFT JOIN steps t ON t.piece_id = s.piece_id AND t.to_frame = s.frame_idx AND t.to_ps = s.ps GROUP BY ALL)""", """
SELECT s.*, COALESCE(b.n, 1)::INT AS reach_back, COALESCE(a.n, 1)::INT AS reach_ahead FROM steps s
LEFT JOIN ahead a ON a.piece_id = s.piece_id AND a.frame_idx = s.to_frame AND a.ps = s.to_ps
LEFT JOIN back b ON b.piece_id = s.piece_id AND b.to_frame = s.frame_idx AND b.to_ps = s.ps
WHERE COALESCE(a.n, 1) + COALESCE(b.n, 1) >= 4"""))

# --- staves ---------------------------------------------------------------


def chords(s, d):
    return st.merge_to_chords(sounding(notes(s, d)))


CHORD_SQL = """
members AS (SELECT piece_id, measure_idx, CASE WHEN ps < 60 THEN 'L' ELSE 'R' END AS hand, offset_ql, dur_ql, ps, MAX(tie) AS tie
            FROM heard GROUP BY ALL),
chords AS (SELECT piece_id, measure_idx, hand, offset_ql, dur_ql, array_to_string(list(ps ORDER BY ps), ',') AS pitches,
                  CASE WHEN COUNT(tie) = COUNT(*) AND MIN(tie) = MAX(tie) THEN MIN(tie) END AS tie, COUNT(tie) > 0 AS any_tie,
                  offset_ql + dur_ql AS end_ql
           FROM members GROUP BY piece_id, measure_idx, hand, offset_ql, dur_ql),
clipped AS (
  SELECT * REPLACE (CASE WHEN covers THEN NULL ELSE tie END AS tie, CASE WHEN covers THEN LEAST(end_ql, 4.0) ELSE end_ql END AS end_ql) FROM (
    SELECT *, any_tie AND EXISTS (SELECT 1 FROM chords o WHERE o.piece_id = c.piece_id AND o.measure_idx = c.measure_idx AND o.hand = c.hand
      AND o.offset_ql < c.end_ql AND c.offset_ql < o.end_ql AND (o.offset_ql <> c.offset_ql OR o.end_ql <> c.end_ql)) AS covers
    FROM chords c))"""
register("merge_to_chords", lambda s, d: chords(s, d).withColumn("pitches", joined("pitches")), with_sql(CHORD_SQL, """
SELECT piece_id, measure_idx, hand, offset_ql, dur_ql, pitches, tie, any_tie FROM chords"""))


def clipped(s, d):
    return st.clip_covering_ties(chords(s, d))


register("clip_covering_ties", lambda s, d: clipped(s, d).withColumn("pitches", joined("pitches")), with_sql(CHORD_SQL, """
SELECT piece_id, measure_idx, hand, offset_ql, dur_ql, end_ql, pitches, tie FROM clipped"""))


def voiced(s, d):
    return st.voice_partition(clipped(s, d))


VOICE_SQL = """
seqd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY piece_id, measure_idx, hand ORDER BY offset_ql, end_ql, pitches) AS n FROM clipped),
fit AS (
  SELECT piece_id, measure_idx, hand, n, 0::BIGINT AS v, [end_ql] AS ends FROM seqd WHERE n = 1
  UNION ALL
  SELECT piece_id, measure_idx, hand, n, v, [CASE WHEN i = v THEN end_ql ELSE ends[i + 1] END for i in range(0, greatest(len(ends), v + 1))]
  FROM (SELECT c.*, ends, COALESCE(list_min([i for i in range(0, len(ends)) if ends[i + 1] <= c.offset_ql]), len(ends)) AS v
        FROM fit f JOIN seqd c ON c.piece_id = f.piece_id AND c.measure_idx = f.measure_idx AND c.hand = f.hand AND c.n = f.n + 1)),
voiced AS (SELECT piece_id, measure_idx, hand, v::INT AS voice_no, offset_ql, end_ql, pitches FROM seqd JOIN fit USING (piece_id, measure_idx, hand, n)),
gaps AS (SELECT *, COALESCE(LAG(end_ql) OVER w, 0) AS before, LEAD(offset_ql) OVER w AS next_start FROM voiced
         WINDOW w AS (PARTITION BY piece_id, measure_idx, hand, voice_no ORDER BY offset_ql, end_ql)),
rests AS (
  SELECT piece_id, measure_idx, hand, voice_no, before AS offset_ql, offset_ql AS end_ql FROM gaps WHERE offset_ql - before >= 1e-4
  UNION ALL SELECT piece_id, measure_idx, hand, voice_no, end_ql, 4.0::DOUBLE FROM gaps WHERE next_start IS NULL AND 4.0 - end_ql >= 1e-4),
entries AS (SELECT *, FALSE AS is_rest FROM voiced UNION ALL SELECT *, '', TRUE FROM rests)"""
LIMIT_SQL = """
loud AS (SELECT piece_id, measure_idx, hand, voice_no, SUM(CASE WHEN is_rest THEN end_ql - offset_ql ELSE 0 END) AS silent FROM entries GROUP BY ALL),
judged AS (SELECT *, COUNT(*) OVER b AS voices, ROW_NUMBER() OVER (b ORDER BY silent DESC, voice_no DESC) AS r FROM loud
           WINDOW b AS (PARTITION BY piece_id, measure_idx, hand)),
rows AS (SELECT e.*, (voices > 2 AND r <= voices - 2) OR (voices = 2 AND silent >= 2) AS excess
         FROM entries e JOIN judged USING (piece_id, measure_idx, hand, voice_no)),
near AS (
  SELECT x.*, h.voice_no AS h_voice, h.end_ql AS h_end, ROW_NUMBER() OVER (PARTITION BY x.piece_id, x.measure_idx, x.hand, x.voice_no, x.offset_ql, x.end_ql
           ORDER BY ABS((h.end_ql - h.offset_ql) - (x.end_ql - x.offset_ql)), h.voice_no, h.end_ql) AS choice
  FROM rows x LEFT JOIN rows h ON NOT h.excess AND h.piece_id = x.piece_id AND h.measure_idx = x.measure_idx AND h.hand = x.hand AND h.offset_ql = x.offset_ql
  WHERE x.excess AND NOT x.is_rest),
settled AS (
  SELECT piece_id, measure_idx, hand, voice_no, offset_ql, end_ql, pitches, is_rest FROM rows WHERE NOT excess
  UNION ALL SELECT piece_id, measure_idx, hand, COALESCE(h_voice, voice_no), offset_ql, COALESCE(h_end, end_ql), pitches, FALSE FROM near WHERE choice = 1),
tones AS (SELECT * EXCLUDE (pitches), UNNEST(CASE WHEN pitches = '' THEN [NULL] ELSE string_split(pitches, ',') END)::INT AS ps FROM settled)"""
register("voice_partition", lambda s, d: voiced(s, d).withColumn("pitches", joined("pitches")),
         with_sql(CHORD_SQL, VOICE_SQL, "SELECT * FROM entries").replace("WITH ", "WITH RECURSIVE ", 1))
register("fill_rests", lambda s, d: st.fill_rests(voiced(s, d).where("not is_rest")),
         with_sql(CHORD_SQL, VOICE_SQL, "SELECT * FROM rests").replace("WITH ", "WITH RECURSIVE ", 1))
register("limit_voices", lambda s, d: st.limit_voices(clipped(s, d)).withColumn("pitches", joined("pitches")),
         with_sql(CHORD_SQL, VOICE_SQL, LIMIT_SQL, """
SELECT piece_id, measure_idx, hand, voice_no, offset_ql, end_ql, BOOL_AND(is_rest) AS is_rest,
       COALESCE(array_to_string(list_sort(list(DISTINCT ps) FILTER (ps IS NOT NULL)), ','), '') AS pitches
FROM tones GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1))
register("merge_nested_voices", lambda s, d: st.merge_nested_voices(clipped(s, d)).withColumn("pitches", joined("pitches")))
register("contracted_score", lambda s, d: st.contracted_score(sounding(notes(s, d, True)), mapping(s, d)).withColumn(
    "pitches", joined("pitches")))

MEDIAN_SQL = """
handed AS (SELECT *, CASE WHEN MEDIAN(ps) OVER (PARTITION BY piece_id, measure_idx, part_idx) >= 60 THEN 1 ELSE 2 END AS hand FROM heard)"""
register("median_hand", lambda s, d: st.median_hand(sounding(notes(s, d))).select("event_id", "hand"),
         with_sql(MEDIAN_SQL, "SELECT event_id, hand FROM handed"))

LEGATO_SQL = """
parts AS (SELECT piece_id, COUNT(DISTINCT part_idx) AS n_parts FROM notes GROUP BY piece_id),
steps AS (SELECT piece_id, measure_idx, t, SUM(d) AS d FROM (
    SELECT piece_id, measure_idx, offset_ql AS t, 1 AS d FROM notes WHERE is_rest
    UNION ALL SELECT piece_id, measure_idx, offset_ql + dur_ql, -1 FROM notes WHERE is_rest) GROUP BY ALL),
levels AS (SELECT piece_id, measure_idx, t, SUM(d) OVER (PARTITION BY piece_id, measure_idx ORDER BY t) AS lv FROM steps),
quiet AS (SELECT piece_id, measure_idx, t FROM (
    SELECT l.*, n_parts, LAG(lv) OVER (PARTITION BY piece_id, measure_idx ORDER BY t) AS before FROM levels l JOIN parts USING (piece_id))
  WHERE lv = n_parts AND COALESCE(before <> n_parts, TRUE)),
onsets AS (SELECT piece_id, measure_idx, hand, offset_ql,
    COALESCE(array_to_string(list_sort(list(DISTINCT ps) FILTER (tie IS NULL OR tie = 'start')), ','), '') AS pitches, FALSE AS silent
  FROM handed GROUP BY piece_id, measure_idx, hand, offset_ql),
marks AS (SELECT * FROM onsets UNION ALL
  SELECT o.piece_id, o.measure_idx, hand, t, '', TRUE FROM quiet q JOIN (SELECT DISTINCT piece_id, measure_idx, hand FROM onsets) o
    ON o.piece_id = q.piece_id AND o.measure_idx = q.measure_idx),
timed AS (SELECT *, COALESCE(LEAD(offset_ql) OVER w, 4.0) AS end_ql, ROW_NUMBER() OVER w = 1 AS is_first FROM marks
  WINDOW w AS (PARTITION BY piece_id, measure_idx, hand ORDER BY offset_ql, silent DESC))"""
register("legato_durations", lambda s, d: st.legato_durations(
    st.median_hand(sounding(notes(s, d))), notes(s, d)).withColumn("pitches", joined("pitches")), with_sql(MEDIAN_SQL, LEGATO_SQL, """
SELECT * FROM (
  SELECT piece_id, measure_idx, hand, CASE WHEN is_first AND silent THEN 0.0::DOUBLE ELSE offset_ql END AS offset_ql,
         end_ql - CASE WHEN is_first AND silent THEN 0.0::DOUBLE ELSE offset_ql END AS dur_ql, pitches FROM timed
  UNION ALL SELECT piece_id, measure_idx, hand, 0.0::DOUBLE, offset_ql, '' FROM timed WHERE is_first AND NOT silent AND ABS(offset_ql) > 1e-4)
WHERE dur_ql > 1e-2"""))
PLAYABLE_SQL = """
body AS (SELECT * FROM (
  SELECT piece_id, measure_idx, hand, CASE WHEN is_first AND silent THEN 0.0::DOUBLE ELSE offset_ql END AS offset_ql,
         end_ql - CASE WHEN is_first AND silent THEN 0.0::DOUBLE ELSE offset_ql END AS dur_ql, pitches FROM timed
  UNION ALL SELECT piece_id, measure_idx, hand, 0.0::DOUBLE, offset_ql, '' FROM timed WHERE is_first AND NOT silent AND ABS(offset_ql) > 1e-4)
  WHERE dur_ql > 1e-2),
tones AS (SELECT *, UNNEST(CASE WHEN pitches = '' THEN [NULL] ELSE string_split(pitches, ',') END)::INT AS ps FROM body),
up AS (SELECT piece_id, measure_idx, hand, MEDIAN(ps) > 60 AS up FROM (SELECT DISTINCT piece_id, measure_idx, hand, ps FROM tones WHERE ps IS NOT NULL) GROUP BY ALL),
outer_tones AS (SELECT t.*, COALESCE(up, FALSE) AS up, MIN(ps) OVER c AS low, MAX(ps) OVER c AS high
  FROM tones t LEFT JOIN up USING (piece_id, measure_idx, hand) WINDOW c AS (PARTITION BY piece_id, measure_idx, hand, offset_ql, dur_ql)),
folds AS (SELECT *, UNNEST(range(0, 12)) AS k FROM outer_tones),
moved AS (SELECT piece_id, measure_idx, hand, offset_ql, dur_ql, ps, CASE WHEN up THEN MIN(ps + 12 * k) FILTER (ps + 12 * k >= high - 12)
                 ELSE MAX(ps - 12 * k) FILTER (ps - 12 * k <= low + 12) END AS now FROM folds GROUP BY piece_id, measure_idx, hand, offset_ql, dur_ql, ps, up)"""
register("playable_chords", lambda s, d: st.playable_chords(st.legato_durations(
    st.median_hand(sounding(notes(s, d))), notes(s, d))).withColumn("pitches", joined("pitches")),
    with_sql(MEDIAN_SQL, LEGATO_SQL, PLAYABLE_SQL, """
SELECT piece_id, measure_idx, hand, offset_ql, dur_ql, COALESCE(array_to_string(list_sort(list(DISTINCT now) FILTER (now IS NOT NULL)), ','), '') AS pitches
FROM moved GROUP BY ALL"""))
