"""Small helpers against brute force and known values."""

import random
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.operators import hands as hd
from scorelake.operators import motif as mo
from scorelake.operators import staves as st
from scorelake.operators.align import match_octaves
from scorelake.sources.scores import parse_score


def test_match_octaves_is_cheapest():
    rnd = random.Random(1)
    for _ in range(200):
        a = sorted(rnd.sample(range(11), rnd.randint(1, 4)))
        b = sorted(rnd.sample(range(11), rnd.randint(1, 4)))
        pairs = match_octaves(a, b)
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        best = min(sum((x - y) ** 2 for x, y in zip(small, p)) for p in permutations(large, len(small)))
        assert len(pairs) == len(small)
        assert len({i for i, _ in pairs}) == len({o for _, o in pairs}) == len(pairs)
        assert sum((i - o) ** 2 for i, o in pairs) == best


def test_thin_frame(spark):
    frames = {  # No doubling above two clusters; one that goes; gaps closed, also once two clusters are left.
        (60, 64, 67): [(60, False), (64, False), (67, False)], (36, 60, 84): [(36, True), (60, False), (84, False)],
        (24, 37, 62, 87): [(84, False), (85, False), (86, False), (87, False)], (36, 61, 80): [(72, False), (73, False), (80, False)],
        (36, 36, 61, 85): [(36, True), (84, False), (85, False), (85, False)]}
    rows = [(1, k, p, i, i) for k, f in enumerate(frames) for i, p in enumerate(f)]
    df = spark.createDataFrame(rows, "piece_id int, onset_tick long, ps int, event_id long, dur_tick long")
    got = hd.thin_frames(df).orderBy("onset_tick", "event_id").collect()
    for k, (_, want) in enumerate(frames.items()):
        assert [(r.ps, r.deleted) for r in got if r.onset_tick == k] == want


def test_close_chord_against_single_folds(spark):
    def fold(pitches, up):
        left = set(pitches)
        while left and max(left) - min(left) > 12:
            p = min(left) if up else max(left)
            left = (left - {p}) | {p + 12 if up else p - 12}
        return sorted(left)
    rnd = random.Random(3)
    rows = [([], True), ([60], False)] + [(sorted(rnd.sample(range(20, 100), rnd.randint(1, 6))), rnd.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "p array<int>, up boolean")
    for r in df.select("p", "up", st.close_chord(F.col("p"), F.col("up")).alias("c")).collect():
        assert r.c == fold(r.p, r.up)


def test_voices(spark):
    """One bar each: a nested voice, a chord without a place in the other voice, three voices."""
    bars = {1: [(0.0, 1.0, [60]), (0.0, 4.0, [61]), (1.0, 2.0, [62]), (3.0, 4.0, [63])],
            2: [(0.0, 4.0, [50]), (0.0, 1.0, [60]), (2.0, 3.0, [62])],
            3: [(0.0, 2.0, [50]), (0.0, 3.0, [55]), (0.0, 4.0, [57]), (2.0, 4.0, [52])]}
    df = spark.createDataFrame([(1, b, "R", s, e, p) for b, c in bars.items() for s, e, p in c],
                               "piece_id int, measure_idx int, hand string, offset_ql double, end_ql double, pitches array<int>")

    def rows(entries, bar):
        return sorted((r.voice_no, r.offset_ql, r.end_ql, tuple(r.pitches)) for r in entries.where(F.col("measure_idx") == bar).collect())
    parts, limited, merged = st.voice_partition(df), st.limit_voices(df), st.merge_nested_voices(df)
    assert rows(parts, 1) == [(0, 0.0, 1.0, (60,)), (0, 1.0, 2.0, (62,)), (0, 2.0, 3.0, ()), (0, 3.0, 4.0, (63,)), (1, 0.0, 4.0, (61,))]
    assert rows(limited, 1) == rows(parts, 1)
    assert rows(merged, 1) == [(0, 0.0, 1.0, (60, 61)), (0, 1.0, 2.0, (62,)), (0, 2.0, 3.0, ()), (0, 3.0, 4.0, (63,))]
    # The first voice is silent for half the bar; its second chord starts where the other voice has no entry.
    assert rows(limited, 2) == rows(merged, 2) == [(0, 2.0, 3.0, (62,)), (1, 0.0, 4.0, (50, 60))]
    # The voice silent for a beat joins the chord of nearest length, in the first voice of equal ones.
    assert rows(limited, 3) == [(0, 0.0, 2.0, (50, 55)), (0, 2.0, 4.0, (52,)), (2, 0.0, 4.0, (57,))]
    assert rows(merged, 3) == [(0, 0.0, 2.0, (50, 55, 57)), (0, 2.0, 4.0, (52,))]


def test_align_distance():
    """Against all ways to match symbols in order."""
    rnd = random.Random(2)
    left = [[rnd.choice("xyz") for _ in range(rnd.randint(0, 4))] for _ in range(30)]
    right = [[rnd.choice("xyz") for _ in range(rnd.randint(0, 5))] for _ in range(30)]
    a, b = mo._numbered(pd.Series(left), pd.Series(right))
    got = mo.align_distance(a[:, None, :], b[None, :, :])
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            values = []  # (matches, length) of the alignments; unmatched symbols may also stand in pairs.
            for n in range(min(len(x), len(y)) + 1):
                for p in combinations(range(len(x)), n):
                    for q in combinations(range(len(y)), n):
                        values.append((sum(x[s] == y[t] for s, t in zip(p, q)), len(x) + len(y) - n))
            score, length = max(values)
            assert got[i, j] == ((length - score) / length if length else 0.0)


def test_merges_follow_the_lowest_pair():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        n = 12
        d = rnd.integers(1, 6, (n, n)).astype(float)
        d = np.triu(d, 1) + np.triu(d, 1).T
        clusters = {i: {i} for i in range(n)}
        for k in range(n, 3, -1):
            _, a, b = min((max(d[x, y] for x in clusters[a] for y in clusters[b]), a, b)
                          for a, b in combinations(sorted(clusters), 2))
            clusters[a] |= clusters.pop(b)
        want = [next(c for c, m in clusters.items() if i in m) for i in range(n)]
        assert mo.cut_tree(n, mo._merges(d), 3) == want


def test_dictionary():
    rows = {(t, m, n): c for t, m, n, _, c in hm.chord_dictionary()}
    assert len(hm.numeral_names("Major")) == 34 and len(hm.numeral_names("Minor")) == 41
    assert rows["C", "Major", "I"] == ("C", "E", "G")
    assert rows["C", "Major", "V65"] == ("B", "D", "F", "G")
    assert rows["C", "Major", "gerVI"] == ("A-", "C", "E-", "F#")
    assert rows["A", "Minor", "dimVII7"] == ("G#", "B", "D", "F")
    assert rows["G", "Minor", "bII6"] == ("C", "E-", "A-")


XML = """<score-partwise><part id="A">
<measure number="1"><attributes><divisions>2</divisions><time><beats>3</beats><beat-type>4</beat-type></time>
<transpose><diatonic>-1</diatonic><chromatic>-2</chromatic></transpose></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><grace/><pitch><step>D</step><octave>4</octave></pitch></note>
<note><rest/><duration>4</duration><voice>1</voice></note>
<backup><duration>6</duration></backup><forward><duration>1</duration></forward>
<note><pitch><step>F</step><alter>1</alter><octave>3</octave></pitch><duration>1</duration><voice>2</voice>
<tie type="start"/><tie type="stop"/></note></measure>
<measure number="2"><note><pitch><step>C</step><octave>4</octave></pitch><duration>6</duration></note></measure>
</part></score-partwise>"""


def test_parse_rejects_other_files():
    assert parse_score("x", "<opus/>") == [] and parse_score("x", "not xml") == []
    assert len(parse_score("x", XML)) == 8


def test_parse_scores(spark):
    from scorelake.sources.scores import parse_scores
    rows = parse_scores(spark.createDataFrame([("a", XML), ("b", "<opus/>")], "path string, text string")).orderBy("note_idx").collect()
    got = [(r.voice, r.measure_idx, r.onset_ql, r.dur_ql, r.is_rest, r.name, r.ps, r.tie) for r in rows]
    assert got == [
        ("1", 0, 0.0, 1.0, False, "B-", 58, None), ("1", 0, 0.0, 1.0, False, "D", 62, None), ("1", 0, 1.0, 2.0, True, None, None, None),
        ("2", 0, 0.5, 0.5, False, "E", 52, "continue"), ("1", 1, 3.0, 3.0, False, "B-", 58, None)]
