"""Pruning, modulations and chord choice against definitions that go from event to event."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import analysis as an
from scorelake.operators import routes as rt
from scorelake.operators import tonal as tn
from scorelake.sources.views import notes

EVENTS = "piece_id int, measure_idx int, event_tick long, global_idx long, matched array<string>"


def corpus(seed, events=60, per_bar=5, most=6):
    """Pieces with gaps between bars, events without chords, and repeated sets."""
    r, rows = random.Random(seed), []
    few = sum(1 << rt.key_list().index(k) for k in ("C,Major", "G,Major", "A,Minor"))
    near = [c for c, keys in rt.key_sets().items() if keys & few]
    for piece in range(3):
        bar, before = 0, []
        for k in range(events if piece else 1 + seed % 3):
            if k % per_bar == 0:
                bar += r.choice([1, 1, 1, 2, 6])
            x = r.random()
            if x > 0.3 or not before:
                before = sorted(r.sample(near if r.random() < 0.93 else rt.chord_list(), r.choice([1, 1, 2, 3, most])))
            rows.append((piece, bar, 256 * (k % per_bar), k, [] if x < 0.1 else before))
    return rows


def survivors(piece):
    """The chords from which the last event is reached, found backwards."""
    told = [(k, row[4]) for k, row in enumerate(piece) if row[4] and row[3] != piece[-1][3] - 1]
    out, turned, keys = {k: row[4] for k, row in enumerate(piece)}, [], rt.key_sets()
    for (k, chords), later in zip(reversed(told), [None, *reversed(told)], strict=False):
        if later and later[1] == chords:
            out[k] = out[later[0]]
            continue
        turned.append(k)
        if later:
            out[k] = [c for c in chords if any(keys[c] & keys[n] for n in out[later[0]])]
    if turned:
        out[turned[-1]] = piece[turned[-1]][4]
    return out


@pytest.mark.parametrize("seed,bars", [(1, 4), (2, 1), (3, 100)])
def test_dead_ends(spark, monkeypatch, seed, bars):
    monkeypatch.setattr(rt, "BLOCK_BARS", bars)
    rows = corpus(seed)
    got = {(r.piece_id, r.global_idx): r.matched for r in rt.prune_dead_ends(spark.createDataFrame(rows, EVENTS)).collect()}
    want = {}
    for piece in range(3):
        own = [r for r in rows if r[0] == piece]
        want |= {(piece, own[k][3]): chords for k, chords in survivors(own).items()}
    assert got == want


def route(entries, nodes, reach, tolerance):
    """The steps of one piece. ``entries``: measures; ``nodes``: (entry, key, chord) -> (next chord, weight)."""
    def worth(i, key, chord):
        """(measures that the path lasts, its weight over these), or None."""
        best, weight, at = None, 0.0, i
        for far in range(reach):
            while at < len(entries) and entries[at] <= entries[i] + far:
                if (at, key, chord) not in nodes:
                    return best
                chord, w = nodes[at, key, chord]
                at, weight = at + 1, weight + w
            best = (far, weight)
        return best

    def search(i, only=None):
        rated = [(worth(*n), n) for n in sorted(nodes, key=lambda n: (n[0], n[2], n[1])) if n[0] == i and only in (None, n[2])]
        rated = [x for x in rated if x[0]]
        return max(rated, key=lambda x: x[0])[1] if rated else None
    out, node, weight, i = [], search(0), 0.0, 0
    while node:
        chord, w = nodes[node]
        weight += w
        out.append((*node, chord, weight))
        i, key = node[0] + 1, node[1] if weight >= tolerance else None
        node = (i, key, chord)
        if node not in nodes:
            node, weight = search(i, chord), 0.0
            while not node and i < len(entries):
                i += 1
                node = search(i)
    return out


@pytest.mark.parametrize("seed,reach,tolerance", [(1, 4, -0.5), (3, 2, 0.3)])
def test_modulations(spark, seed, reach, tolerance):
    pruned = spark.createDataFrame(corpus(seed, 50, 2, 12), EVENTS)
    entries, nodes = rt.flow_entries(pruned, tn.chord_flow(spark))
    got = rt.modulations(entries, nodes, reach, tolerance).collect()
    want, all_entries, all_nodes = [], entries.collect(), nodes.collect()
    for piece in range(3):
        own = sorted((r for r in all_entries if r.piece_id == piece), key=lambda r: r.i)
        table = {(r.i, r.key, r.from_chord): (r.to_chord, r.weight) for r in all_nodes if r.piece_id == piece}
        want += [(piece, own[s[0]].measure_idx, own[s[0]].event_tick, *s[1:]) for s in route([r.measure_idx for r in own], table, reach, tolerance)]
    assert want
    assert sorted((r.piece_id, r.measure_idx, r.event_tick, r.key, r.from_chord, r.to_chord, r.weight) for r in got) == sorted(want)


def test_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    assert rt.prune_dead_ends(none).count() == 0
    assert rt.modulations(*rt.flow_entries(none, tn.chord_flow(spark))).count() == 0


def test_chord_repair(spark):
    """The second event's dissonance, shared with the first, is repaired there from the pool and then borrowed."""
    kind = "array<struct<event_tick:bigint,pitches:array<string>,key_no:int,chord:string>>"
    bar = [(0, ["C", "F", "A"], 63, "C,E,G"), (256, ["C", "F"], 63, "C,E,G"), (512, ["D"], 63, None)]
    df = spark.createDataFrame([(bar, ["A,C,F", "C,E,G"])], f"bar {kind}, pool array<string>")
    first, second, third = df.select(an._repaired("bar", F.col("pool")).alias("x")).first().x
    assert (first.chord, first.out, second.chord, second.out) == ("A,C,F", [], "A,C,F", []) and third.chord is None


def test_chords_pass_from_bar_to_bar(spark):
    """A chord that is no worse goes on over any number of bars."""
    now = "struct<measure_idx:int,event_tick:bigint,key:string,from_chord:string,to_chord:string,then:struct<from_chord:string,to_chord:string>>"
    step = (0, 0, "C,Major", "C,E,G", "C,E,G", None)
    rows = [(0, m, 0, ["G"], ["G"], ["B,D,G"] if m else ["C,E,G"], [], step) for m in range(9)]
    events = spark.createDataFrame(rows, f"piece_id int, measure_idx int, event_tick long, pitches array<string>, smeared array<string>, "
                                         f"matched array<string>, pool array<string>, now {now}")
    assert {tuple(r.chord) for r in an.choose_chords(events).collect()} == {("G", "C", "E")}


def test_analysis_of_a_piece(spark, sf):
    flow = tn.chord_flow(spark)
    told = an.analyse(notes(spark, sf), flow).cache()
    rows = told.collect()
    assert all(set(r.dissonance) == set(r.pitches) - set(r.chord or []) for r in rows if r.chord)
    steps = an.chosen_modulations(told, flow).collect()
    chosen = {(r.measure_idx, r.event_tick): ",".join(sorted(r.chord)) for r in rows if r.chord}
    assert all(chosen[s.measure_idx, s.event_tick] == s.from_chord for s in steps)


def test_bars_are_folded_again_only_if_their_choice_changes(spark, monkeypatch):
    """A chord before that is never chosen folds no bar again, and names that no chord has are outside of all."""
    now = "struct<measure_idx:int,event_tick:bigint,key:string,from_chord:string,to_chord:string,then:struct<from_chord:string,to_chord:string>>"
    step = (0, 0, "C,Major", "C,E,G", "C,E,G", None)
    rows = [(0, m, 0, ["C", "E", "G"] if m % 2 else ["B", "D", "Q#"], ["C"], ["C,E,G"] if m % 2 else ["B,D,G"], [], (*step[:3], c, c, None))
            for m in range(9) for c in ["C,E,G" if m % 2 else "B,D,G"]]
    events = spark.createDataFrame(rows, f"piece_id int, measure_idx int, event_tick long, pitches array<string>, smeared array<string>, "
                                         f"matched array<string>, pool array<string>, now {now}")
    folded, fold = [], an._folded
    monkeypatch.setattr(an, "_folded", lambda bars: folded.append(bars.count()) or fold(bars))
    told = {r.measure_idx: (set(r.chord), r.dissonance) for r in an.choose_chords(events).collect()}
    assert folded == [9]
    assert all(told[m] == ((set("CEG"), []) if m % 2 else (set("BDG"), ["Q#"])) for m in range(9))
