"""Distributed operators against sequential or brute-force versions."""

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_lookahead, with_neighbours, with_row_number, with_running_max
from scorelake.operators import features as ft
from scorelake.operators import graph as gr
from scorelake.operators import learn as ln
from scorelake.operators import motif as mo
from scorelake.operators import tonal as tn
from scorelake.sources import runs, scores, texts
from scorelake.sources.views import motif_notes, notes, sounding


def test_ordered_helpers(spark):
    rnd = random.Random(0)
    rows = [("k", i // 7, i, rnd.random() if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, c int, i int, v double")
    got = with_row_number(df, ["k"], ["c"], ["i"], "n")
    got = with_neighbours(got, ["k"], ["c"], ["i"], ["i"], prev="p", next="x")
    got = with_running_max(got, ["k"], ["c"], ["i"], {"m": F.col("v")})
    got = with_lookahead(got, ["k"], "n", ["i"], 4, "ahead").orderBy("i").collect()
    top = None
    for i, r in enumerate(got):
        v = rows[i][3]
        top = v if top is None else (top if v is None else max(top, v))
        assert r.n == i and r.m == top
        assert (r.p.i if r.p else None) == (i - 1 if i else None)
        assert (r.x.i if r.x else None) == (i + 1 if i < 59 else None)
        assert [a.i for a in r.ahead] == list(range(i, min(i + 4, 60)))


def test_lookahead_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("scorelake.functions.ordered.BLOCK", 8)
    df = spark.range(50).selectExpr("'k' AS k", "id AS n")
    got = with_lookahead(df, ["k"], "n", ["n"], 4, "a").orderBy("n").collect()
    assert [[x.n for x in r.a] for r in got] == [list(range(i, min(i + 4, 50))) for i in range(50)]


def test_components_of_a_long_chain(spark):
    edges = [(1, i, i + 1) for i in range(200)] + [(2, 5, 9), (2, 9, 7)]
    random.Random(1).shuffle(edges)
    got = {(r.piece_id, r.note_idx): r.parent_idx for r in gr.flatten_contractions(
        spark.createDataFrame(edges, "piece_id int, u long, v long")).collect()}
    assert got == {**{(1, i): 0 for i in range(201)}, (2, 5): 5, (2, 7): 5, (2, 9): 5}


def test_density_against_loops(spark, sf):
    got = ft.output_count_by_onset(notes(spark, sf)).orderBy("onset_tick").toPandas()
    rates = ft.onset_rates(notes(spark, sf)).orderBy("onset_tick").toPandas()
    start, span, rate = (rates[c].to_numpy() for c in ("onset_ql", "span", "rate"))
    cdf = lambda x: 0.5 * (1 + math.erf(x / 4 / math.sqrt(2)))
    for i in range(0, len(rates), 17):
        blur = 0.0
        for j in range(len(rates)):
            l, r = start[j] - start[i], start[j] + span[j] - start[i]
            if r > -20 and l < 20:
                blur += rate[j] * (cdf(min(r, 20) if j >= i else r) - cdf(max(l, -20)))
        base = blur + 0.01
        want = 1.61 * base ** 0.545 * (rate[i] / base) ** 0.759 * span[i]
        assert got["output_count"][i] == pytest.approx(want)


def test_median_filter_against_loops(spark, sf):
    rates = ft.onset_rates(notes(spark, sf))
    got = ln.median_filter(rates, 8.0).orderBy("onset_tick").toPandas()["median_rate"]
    t = rates.orderBy("onset_tick").toPandas()
    start, span, rate = (t[c].to_numpy() for c in ("onset_ql", "span", "rate"))
    for i in range(0, len(t), 13):
        total, value = 0.0, None
        for j in range(len(t)):
            l, r = start[j] - start[i], start[j] + span[j] - start[i]
            if r <= -8 or l >= 8:
                continue
            value = rate[j]
            total += (min(r, 8) if j >= i else r) - max(l, -8)
            if total >= 8:
                break
        assert got[i] == value


def test_clusters_in_blocks_equal_clusters_in_one_task(spark, sf):
    groups = mo.group_grams(mo.motif_grams(motif_notes(spark, sf))).orderBy("gram_key").limit(120).cache()
    whole = {r.gram_key: r.cluster for r in mo.cluster_grams(groups).collect()}
    parts = {r.gram_key: r.cluster for r in mo.cluster_grams(groups, task_groups=50).collect()}
    assert len(set(whole.values())) == 12
    assert whole == parts


def test_chordal_cascade(spark):
    # C E G C is a triad; the groups after it fall with it until three notes
    # without a group lie between.
    names = {"C": (0, 60), "E": (4, 64), "G": (7, 67), "D": (2, 62)}
    line = "DDCEGCDDDD"
    rows = [(1, 0, "1", i // 4, i * 1024, float(i), False, n, names[n][0], names[n][1], 1.0, None, i) for i, n in enumerate(line)]
    df = spark.createDataFrame(rows, "piece_id int, part_idx int, voice string, measure_idx int, onset_tick long, onset_ql double, "
                               "is_rest boolean, name string, pc int, ps int, dur_ql double, tie string, event_id long")
    grams = mo.notegrams(mo.motif_items(df))
    assert sorted(r.pos for r in grams.collect()) == list(range(7))
    chordal = sorted(r.pos for r in grams.where(mo.is_chordal(F.col("raw"))).collect())
    assert chordal == [2]
    assert sorted(r.pos for r in mo.drop_chordal_grams(grams).collect()) == [0, 1]


def test_ties_extend_groups(spark):
    ties = [None, "start", "stop", None, None, None]
    rows = [(1, 0, "1", 0, i * 1024, float(i), False, "C", 0, 60 if i in (1, 2) else 60 + i, 0.5, t, i) for i, t in enumerate(ties)]
    df = spark.createDataFrame(rows, "piece_id int, part_idx int, voice string, measure_idx int, onset_tick long, onset_ql double, "
                               "is_rest boolean, name string, pc int, ps int, dur_ql double, tie string, event_id long")
    items = mo.motif_items(df)
    got = {r.pos: (r.n_raw, [n.dur_ql for n in r.notes]) for r in mo.extend_ties(mo.notegrams(items), items).collect()}
    # No group starts at the end of the tie.
    assert got == {0: (5, [0.5, 1.0, 0.5, 0.5]), 1: (5, [1.0, 0.5, 0.5, 0.5])}


def test_encoders_on_known_groups(spark):
    rows = [([("C", 60, 1.0, False), ("D", 62, 0.25, False), (None, None, 1.0, True), ("C", 60, 1.0, False)],)]
    df = spark.createDataFrame(rows, "n array<struct<name:string,ps:int,dur_ql:double,is_rest:boolean>>")
    r = df.select(*[f(F.col("n")).alias(k) for k, f in mo.ENCODERS.items()], mo.gram_key(F.col("n")).alias("key")).first()
    assert r.note_names == ["C", "D", "R", "C"] and r.rhythms == ["1.0", "0.2", "1.0", "1.0"]
    assert r.interval_vector == ["*", "2.0", "R", "*"] and r.contour == ["<", "NR", "RN"]
    assert r.rhythm_transitions == ["0.2", "4.0", "1.0"] and r.letter_transitions == ["1", "NR", "RN"]
    assert r.key == "C,1.0;D,0.2;R,1.0;C,1.0"


def test_hot_piece_keeps_all_rows(spark, sf):
    """A third of all rows in one piece, in one voice."""
    base = notes(spark, sf).drop("note_idx")
    extra = base.where("measure_idx < 15").withColumns({"piece_id": F.lit(99), "part_idx": F.lit(0), "voice": F.lit("1"),
                                                         "event_id": F.col("event_id") + 1_000_000})
    both = base.unionByName(extra)
    n = both.where("NOT is_rest").count()
    assert ft.rhythm_variety(both).count() == ft.entrance_effect(both).count() == ft.bar_flags(both).count() == n
    assert ln.note_features(both).count() == n


def test_sinks_round_trip(spark, sf, tmp_path):
    n = notes(spark, sf)
    heard = sounding(n)
    runs.write_run(heard, str(tmp_path / "run"), {"timestamp": 5, "title": "t"}, {"ps": 60.0}, ["part_idx"],
                   spark.createDataFrame([(0, 1, 2, 1.0)], "piece_id int, u long, v long, f double"))
    assert spark.read.json(str(tmp_path / "run" / "notes")).count() == heard.count()
    index = spark.read.json(str(tmp_path / "run" / "index")).first()
    assert index.title == "t" and index.features[0].range == [36.0, 84.0]
    for name, text in (("a", json.dumps({"timestamp": 1, "title": "old"})), ("b", "{broken"), ("c", json.dumps({"timestamp": 9, "title": "new"}))):
        (tmp_path / "log" / name).mkdir(parents=True)
        (tmp_path / "log" / name / "index.json").write_text(text)
    assert [(r.name, r.title) for r in runs.read_run_index(spark, str(tmp_path / "log")).collect()] == [("c", "new"), ("a", "old")]
    training = spark.createDataFrame([("I", "V", "I-V", "Yes", "Major"), ("I", "IV", "I-IV", "No", "Minor")],
                                     "from_numeral string, to_numeral string, trans string, match string, mode string")
    runs.write_transitions(training, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted((r["1"], r["Trans"], r["mode"]) for r in back.collect()) == [("I", "I-IV", "Minor"), ("I", "I-V", "Major")]
    entries = spark.createDataFrame([(1, 0, "L", 0, 0.0, 1.0, [48, 52], False)],
                                    "piece_id int, measure_idx int, hand string, voice_no int, offset_ql double, end_ql double, pitches array<int>, is_rest boolean")
    runs.write_reduced(entries, str(tmp_path / "reduced"))
    assert runs.read_reduced(spark, str(tmp_path / "reduced")).first().pitches == [48, 52]


def test_text_sources(spark, tmp_path):
    corpus = "file\ttitle\tcomposer\nE\tMinor\t2\nA_min_0\nBb_maj_1\nG\tMajor\t1\nD_dom7_2\n"
    rows = texts.read_harmony_corpus(spark.createDataFrame([("x", corpus)], "path string, text string")).collect()
    assert sorted((r.section, r.pos, r.tonic, r.mode, r.root, r.quality, r.inversion) for r in rows) == [
        (0, 0, "E", "Minor", "A", "min", 0), (0, 1, "E", "Minor", "B-", "maj", 1), (1, 0, "G", "Major", "D", "dom7", 2)]
    lines = spark.createDataFrame([(" +       0.5 (normalized) 1=I",), (" +      -0.25   (normalized) 2=V",),
                                   (" +  0.125 (normalized) Trans=I-V",), (" +       0.56 ",)], "value string")
    weights = {(r.from_numeral, r.to_numeral): r.weight for r in texts.flow_weights(texts.read_flow_weights(lines), "Major").collect()}
    assert len(weights) == 34 * 34
    assert weights["I", "V"] == 0.375 and weights["I", "I"] == 0.5 and weights["II", "V"] == -0.25 and weights["II", "I"] == 0.0
    gold = texts.read_gold_chords(spark.createDataFrame([("g", "name,2\n0,D,F#,A\n1,A,C#,E,G\n2,A\n")], "path string, text string"))
    assert sorted((r["index"], tuple(r.chord)) for r in gold.collect()) == [(0, ("D", "F#", "A")), (1, ("A", "C#", "E", "G"))]
    pairs = scores.read_pairs(spark.createDataFrame([("a.xml:b.xml",), ("c.xml",)], "value string")).collect()
    assert sorted((r.in_path, r.out_path) for r in pairs) == [("a.xml", "b.xml"), ("c.xml", None)]


def test_models_save_and_load(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(float(i), float(i % 2), float(i > 10)) for i in range(20)], "a double, b double, label double")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), ln.model("logistic")]).fit(df)
    ln.save_pipeline(fitted, str(tmp_path / "m"))
    back = ln.load_pipeline(str(tmp_path / "m"))
    assert [r.prediction for r in back.transform(df).collect()] == [r.prediction for r in fitted.transform(df).collect()]


def test_user_features(spark, sf):
    from pyspark.sql import types as T
    out = ft.apply_features(notes(spark, sf), [(ft.pitch_distance, [T.StructField("pitch_distance", T.IntegerType())]),
                                               (ft.offset_value, [T.StructField("offset_value", T.DoubleType())])])
    assert {"0_pitch_distance", "1_offset_value"} <= set(out.columns)
