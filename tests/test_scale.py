"""Steps that were mended for size: same results, and no work that outgrows the input."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.operators import motif as mo
from scorelake.operators import routes as rt
from scorelake.operators import tonal as tn
from scorelake.sources import scores

EVENTS = "piece_id int, measure_idx int, event_tick long, matched array<string>"


def test_best_flow_sorts_no_pairs(spark):
    """The best steps are those of all pairs, and the pairs are neither sorted nor grouped."""
    chords = sorted({hm.set_key(c) for t, m, _, root, c in hm.chord_dictionary() if root and t in ("C", "G")})
    rows = [(0, k // 3, 256 * (k % 3), chords[k:k + 9] if k % 5 else ["X,Y,Z"]) for k in range(14)]
    flow = tn.chord_flow(spark)
    got = tn.best_flow(spark.createDataFrame(rows, EVENTS), flow)
    want = {}
    for f in flow.collect():
        for a, b in zip(rows, rows[1:]):
            if f.from_chord in a[3] and f.to_chord in b[3]:
                at = (*a[:3], f.from_chord, f.tonic, f.mode)
                want[at] = min(want.get(at, (99,)), (-f.weight, f.to_chord, f.from_numeral, f.to_numeral))
    told = {(*r[:6],): (-r.weight, r.to_chord, r.from_numeral, r.to_numeral) for r in got.collect()}
    assert want and told == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan.split("Generate")[0] and "HashAggregate" not in plan.split("Generate")[0]


def test_chords_are_met_as_bits(spark):
    """Partial matches and fitting candidates by their definition, with names the dictionary lacks."""
    heard = [["C", "E"], ["C", "E", "G", "B-"], ["F###", "C"], [], ["A", "C#", "E-", "Q"]]
    given = ["C,E,G", "A,C,E", "Q,R,S"]
    rows = [(0, 0, 256 * k, x) for k, x in enumerate(heard)]
    events = spark.createDataFrame(rows, EVENTS.replace("matched", "smeared"))
    bars = spark.createDataFrame([(0, 0, given)], "piece_id int, measure_idx int, candidates array<string>")
    got = tn.match_candidates(events, bars).withColumn("partial", tn.match_partial(F.col("smeared"))).collect()
    for r in got:
        assert r.fitting == [c for c in given if len(set(c.split(",")) - set(r.smeared)) <= 1]
        assert r.partial == [c for c in hm.triads() if len(set(c.split(",")) & set(r.smeared)) >= 2]
    plan = events.select(tn.match_partial(F.col("smeared")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan


def test_scores_are_parsed_file_by_file(spark):
    """No Arrow batch, which would hold the texts and rows of thousands of files."""
    note = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration><voice>1</voice></note>"
    good = f"<score-partwise><part><measure>{note * 3}</measure></part></score-partwise>"
    texts = spark.createDataFrame([("a", good), ("b", "<broken"), ("c", "<other/>"), ("d", good)], "path string, text string")
    got = scores.parse_scores(texts)
    assert Counter(r.piece for r in got.collect()) == {"a": 3, "d": 3}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "MapInPandas" not in plan and "BatchEvalPython" in plan


def test_jumps_only_from_bar_to_bar(spark, monkeypatch):
    """Of the nodes of a piece only those at the first entry of a bar are joined along jumps."""
    rows = [(0, k // 8, 128 * (k % 8), ["C,E,G", "A,C,E", "C,F,A"][k % 3:] + ["B,D,G"]) for k in range(64)]
    entries, nodes = rt.flow_entries(spark.createDataFrame(rows, EVENTS), tn.chord_flow(spark))
    seen, jumps = [], rt._jumps
    monkeypatch.setattr(rt, "_jumps", lambda given: seen.extend(jumps(given)) or seen)
    assert rt.modulations(entries, nodes).count() == entries.count()
    assert seen and sum(j.count() for j in seen) < nodes.count() / 2


def test_grid_aligns_different_sequences_once(monkeypatch):
    """The same matrix as from all pairs, bit by bit, and work that goes by the different sequences."""
    r = np.random.default_rng(5)
    frame = pd.DataFrame({n: [[str(x) for x in r.integers(0, 2, 3 + k % 2)] for k in range(60)] for n in mo.WEIGHTS})
    cells, align = [], mo.align_distance
    monkeypatch.setattr(mo, "align_distance", lambda a, b: cells.append(np.broadcast_shapes(a.shape[:-1], b.shape[:-1])) or align(a, b))
    grid = mo.dissimilarity(frame, frame[:40], grid=True)
    assert all(x <= 24 and y <= 24 for x, y in cells)
    left, right = frame.loc[np.repeat(np.arange(60), 40)].reset_index(drop=True), pd.concat([frame[:40]] * 60, ignore_index=True)
    assert np.array_equal(grid.ravel(), mo.dissimilarity(left, right, grid=False))
    assert mo.dissimilarity(frame[:0], frame[:0], grid=True).shape == (0, 0)


def test_nodes_are_held_by_bar(spark):
    """A row for each bar that is sent on, in four bytes a node; each node is the best flow of its entry, with chords the dictionary lacks."""
    chords = sorted({hm.set_key(c) for t, m, _, root, c in hm.chord_dictionary() if root and t in ("C", "G")})
    rows = [(p, k // 3, 256 * (k % 3), [*chords[k:k + 9], "X,Y,Z"] if k % 5 else ["X,Y,Z"]) for p in range(2) for k in range(14)]
    rows += [(0, 9, 0, ["X,Y,Q"]), (0, 9, 256, ["X,Y,Z"]), (0, 9, 512, ["X,Y,Z"]), (0, 9, 768, ["C,E,G"])]
    matched, flow = spark.createDataFrame(rows, EVENTS), tn.chord_flow(spark)
    entries, nodes = rt.flow_entries(matched, flow)
    held = nodes.bars.collect()
    assert len(held) == len({r[:2] for r in rows}) and nodes.bars.schema["nodes"].dataType.simpleString() == "array<array<int>>"
    got = Counter((r.piece_id, r.measure_idx, r.event_tick, r.from_chord, r.key, r.to_chord, r.weight, r.from_numeral, r.to_numeral) for r in nodes.collect())
    asked = {(r.piece_id, r.measure_idx, r.event_tick): r.i for r in entries.collect()}
    want = Counter((r.piece_id, r.measure_idx, r.event_tick, r.from_chord, f"{r.tonic},{r.mode}", r.to_chord, r.weight, r.from_numeral, r.to_numeral)
                   for r in tn.best_flow(matched, flow).collect() if (r.piece_id, r.measure_idx, r.event_tick) in asked)
    assert want and got == want and sum(len(x) for r in held for x in r.nodes) == len(list(want.elements()))
    assert sorted(asked.values()) == sorted([*range(16), *range(13)]) and (0, 9, 256) not in asked and (0, 9, 0) in asked
