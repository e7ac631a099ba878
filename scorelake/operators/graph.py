"""Edges between notes and the contraction of notes.

Edge operators pair notes of one onset or one bar. For a contracted score run
them on ``pitch_cells``, one row per bar, onset and pitch, so that an onset holds
at most as many rows as there are pitches, and rename the edges to groups with
``map_structure``. A cell carries the longest and the shortest length of its
notes, so that its edges and their greatest features are those of all notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_neighbours, with_row_number
from scorelake.operators.features import ITEM_ORDER, voice_items
from scorelake.session import cut_lineage
from scorelake.sources.views import BAR, ONSET, VOICE

# --- contraction ----------------------------------------------------------


def _members(notes: DataFrame) -> DataFrame:
    return notes.where(~F.col("is_rest"))


def contract_ties(notes: DataFrame) -> DataFrame:
    """Edges ``(u, v)``: v continues the tied note u. v is the first note of
    equal pitch in the item that follows u in its voice."""
    items = with_neighbours(voice_items(notes).withColumn("sounding", ~F.col("is_rest")), VOICE,
                            ["measure_idx"], ITEM_ORDER, ["onset_tick", "is_rest"], next="__n")
    follow = (items.where(~F.col("is_rest") & ~F.col("__n.is_rest"))
              .select(*VOICE, "onset_tick", F.col("__n.onset_tick").alias("__next")))
    tied = _members(notes).where(F.col("tie").isin("start", "continue"))
    tied = tied.join(follow, [*VOICE, "onset_tick"]).select(
        *VOICE, F.col("__next").alias("onset_tick"), "ps", F.col("note_idx").alias("u"))
    targets = _members(notes).groupBy(*VOICE, "onset_tick", "ps").agg(F.min("note_idx").alias("v"))
    return tied.join(targets, [*VOICE, "onset_tick", "ps"]).select("piece_id", "u", "v")


def contract_by_pitch_onset(notes: DataFrame) -> DataFrame:
    """Edges from the first note of a bar, onset and pitch to the others."""
    heard = _members(notes)
    firsts = heard.groupBy(*ONSET, "ps").agg(F.min("note_idx").alias("u"))
    return (heard.join(firsts, [*ONSET, "ps"]).where(F.col("note_idx") != F.col("u"))
            .select("piece_id", "u", F.col("note_idx").alias("v")))


def flatten_contractions(edges: DataFrame) -> DataFrame:
    """Connected components as ``(piece_id, note_idx, parent_idx)`` with the
    smallest member as parent, for all notes that have an edge.

    Alternating star contraction: each round hangs every node under the smallest
    neighbour it sees, so even long chains end after logarithmically many
    rounds. Neighbourhoods are reduced by a combined ``min`` and never
    collected; lineage is cut after each round."""
    key = ["piece_id"]
    flat = edges.where(F.col("u") != F.col("v")).select(*key, "u", "v")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return (both.where(F.col("v") > F.col("u")).join(least, [*key, "u"])
                .select(*key, F.col("v").alias("u"), F.col("m").alias("v")))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(*key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy(*key, "u").agg(F.min("v").alias("m"))
        hung = down.join(least, [*key, "u"])
        return (hung.where(F.col("v") != F.col("m")).select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select(*key, "u", F.col("m").alias("v"))).distinct())

    def settled(e: DataFrame) -> bool:
        """All stars: no node hangs twice, no root hangs anywhere."""
        roles = (e.select(*key, F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root"))
                 .unionByName(e.select(*key, F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
                 .groupBy(*key, "n").agg(F.sum("child").alias("child"), F.max("root").alias("root")))
        return roles.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0))).isEmpty()

    flat = cut_lineage(small_star(large_star(flat.distinct())))
    while not settled(flat):
        flat = cut_lineage(small_star(large_star(flat)))
    roots = flat.select(*key, F.col("v").alias("note_idx"), F.col("v").alias("parent_idx"))
    return (flat.select(*key, F.col("u").alias("note_idx"), F.col("v").alias("parent_idx"))
            .unionByName(roots).distinct())


def contraction_parents(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every sounding note with its parent; itself when it has no edge."""
    comps = flatten_contractions(edges)
    return (_members(notes).select("piece_id", "note_idx").join(comps, ["piece_id", "note_idx"], "left")
            .withColumn("parent_idx", F.coalesce("parent_idx", "note_idx")))


def contraction_index(parents: DataFrame) -> DataFrame:
    """Adds ``group_idx``, a dense number in order of first appearance, which is
    the order of the parents, and the ``is_contracted`` flag."""
    roots = parents.select("piece_id", "parent_idx").distinct().withColumn("__chunk", F.floor(F.col("parent_idx") / 4096))
    dense = with_row_number(roots, ["piece_id"], ["__chunk"], ["parent_idx"], "group_idx").drop("__chunk")
    return parents.join(dense, ["piece_id", "parent_idx"]).withColumn("is_contracted", is_contracted())


def is_contracted() -> Column:
    return F.col("note_idx") != F.col("parent_idx")


def map_features(features: DataFrame, mapping: DataFrame, columns: list[str],
                 aggregator: Callable[[Column], Column] = F.max) -> DataFrame:
    """Feature rows of the groups; ``aggregator`` may be any aggregate function
    of a column."""
    keyed = features.join(mapping.select("piece_id", "note_idx", "group_idx"), ["piece_id", "note_idx"])
    return keyed.groupBy("piece_id", "group_idx").agg(*[aggregator(F.col(c)).alias(c) for c in columns])


def map_structure(edges: DataFrame, mapping: DataFrame, columns: list[str],
                  aggregator: Callable[[Column], Column] = F.max) -> DataFrame:
    """Edges between groups: renamed, sorted, without self-loops."""
    ends = mapping.select("piece_id", "note_idx", "group_idx")
    renamed = (edges.join(ends.withColumnsRenamed({"note_idx": "u", "group_idx": "__gu"}), ["piece_id", "u"])
               .join(ends.withColumnsRenamed({"note_idx": "v", "group_idx": "__gv"}), ["piece_id", "v"])
               .where(F.col("__gu") != F.col("__gv")))
    return renamed.groupBy("piece_id", F.least("__gu", "__gv").alias("u"), F.greatest("__gu", "__gv").alias("v")).agg(
        *[aggregator(F.col(c)).alias(c) for c in columns])


def contracted_rows(notes: DataFrame, mapping: DataFrame, columns: list[str],
                    aggregator: Callable[[Column], Column] = F.max) -> DataFrame:
    """One row per group, under its ``group_idx`` as ``note_idx`` and at the onset of
    its first note, with the aggregated columns of all its notes."""
    keyed = _members(notes).join(mapping.select("piece_id", "note_idx", "group_idx"), ["piece_id", "note_idx"])
    return (keyed.groupBy("piece_id", "group_idx")
            .agg(F.min_by(F.struct("measure_idx", "onset_tick"), "note_idx").alias("__at"),
                 *[aggregator(F.col(c)).alias(c) for c in columns])
            .select("piece_id", "__at.*", F.col("group_idx").alias("note_idx"), *columns))


def pitch_cells(notes: DataFrame) -> DataFrame:
    """One row per bar, onset and pitch, under the index of its first note, with
    the greatest length of its notes (``dur_tick``, ``dur_ql``) and the least one
    above zero (``low_ql``)."""
    return _members(notes).groupBy(*ONSET, "ps").agg(
        F.min("note_idx").alias("note_idx"), F.max("dur_tick").alias("dur_tick"), F.max("dur_ql").alias("dur_ql"),
        F.min(F.when(F.col("dur_ql") > 0, F.col("dur_ql"))).alias("low_ql"), F.lit(False).alias("is_rest"))


# --- edges ----------------------------------------------------------------


def simultaneous_notes(notes: DataFrame, slot_ticks: int = 256) -> DataFrame:
    """Pairs of one bar that sound together. The earlier note is spread over
    the time slots it covers, the later one stands in the slot of its start, so
    every pair meets once and only near notes are compared."""
    heard = _members(notes)
    start, end = F.col("onset_tick"), F.col("onset_tick") + F.col("dur_tick")
    base = heard.where(F.col("dur_tick") > 0).select(
        *BAR, F.col("note_idx").alias("i"), start.alias("s"), end.alias("e"),
        F.floor(start / slot_ticks).alias("slot"))
    early = base.select(*BAR, F.col("i").alias("a"), F.col("s").alias("a_s"), F.col("e").alias("a_e"),
                        F.explode(F.sequence(F.col("slot"), F.floor((F.col("e") - 1) / slot_ticks))).alias("slot"))
    late = base.select(*BAR, "slot", F.col("i").alias("b"), F.col("s").alias("b_s"))
    meets = (F.col("a_s") < F.col("b_s")) | ((F.col("a_s") == F.col("b_s")) & (F.col("a") < F.col("b")))
    return (early.join(late, [*BAR, "slot"]).where(meets & (F.col("b_s") < F.col("a_e")))
            .select("piece_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def onset_notes(notes: DataFrame) -> DataFrame:
    """Pairs with equal onset, with pitches and lengths (of cells, the greatest and the least) of both."""
    heard = _members(notes)
    low = F.col("low_ql" if "low_ql" in notes.columns else "dur_ql")

    def side(x: str) -> DataFrame:
        return heard.select(*ONSET, F.col("note_idx").alias(x), F.col("ps").alias(f"ps_{x}"),
                            F.col("dur_ql").alias(f"dur_{x}"), low.alias(f"low_{x}"))
    a, b = side("u"), side("v")
    return a.join(b, ONSET).where(F.col("u") < F.col("v")).drop("measure_idx", "onset_tick")


# Intervals, in semitones modulo an octave, that clash.
BAD_INTERVALS = (1, 2, 6, 10, 11)


def onset_bad_interval_notes(notes: DataFrame) -> DataFrame:
    """Onset pairs with a clashing interval in either direction."""
    up = F.pmod(F.col("ps_u") - F.col("ps_v"), F.lit(12))
    return onset_notes(notes).where(up.isin(*BAD_INTERVALS)).select("piece_id", "u", "v")


def onset_duration_varying_notes(notes: DataFrame) -> DataFrame:
    """Onset pairs of different lengths with log2 of their ratio (of cells, the greatest between their notes)."""
    ratio = F.greatest(F.col("dur_u") / F.col("low_v"), F.col("dur_v") / F.col("low_u"))
    return (onset_notes(notes).where((F.col("low_u") > 0) & (F.col("low_v") > 0) & (ratio > 1))
            .select("piece_id", "u", "v", F.log2(ratio).alias("log_ratio")))


def adjacent_notes(notes: DataFrame) -> DataFrame:
    """Successive chords of a part with no rest between, paired from the top
    note down; the last chord of a voice leads on to the next voice. ``u`` is
    the later note; features follow the earlier note's length."""
    items = with_neighbours(voice_items(notes).withColumn("sounding", ~F.col("is_rest")),
                            ["piece_id", "part_idx"], ["voice", "measure_idx"], ITEM_ORDER,
                            ["voice", "onset_tick", "is_rest"], prev="__p")
    links = (items.where(~F.col("is_rest") & ~F.col("__p.is_rest"))
             .select(*VOICE, "onset_tick", F.col("__p.voice").alias("p_voice"), F.col("__p.onset_tick").alias("p_onset")))
    ranked = _ranked(notes)
    later = ranked.join(links, [*VOICE, "onset_tick"]).select(
        "piece_id", "part_idx", F.col("p_voice").alias("voice"), F.col("p_onset").alias("onset_tick"), "rank",
        F.col("note_idx").alias("u"))
    earlier = ranked.where(F.col("dur_tick") > 0).select(
        *VOICE, "onset_tick", "rank", F.col("note_idx").alias("v"), F.log2("dur_ql").alias("log_d"))
    return (later.join(earlier, [*VOICE, "onset_tick", "rank"])
            .select("piece_id", "u", "v", F.lit(1.0).alias("one"), "log_d",
                    (F.col("log_d") * F.col("log_d")).alias("log_d_sq")))


def _ranked(notes: DataFrame) -> DataFrame:
    """Notes with their rank from the top inside their chord."""
    w = Window.partitionBy(*VOICE, "onset_tick").orderBy(F.desc("ps"), "note_idx")
    return _members(notes).withColumn("rank", F.row_number().over(w))


def edge_features(structures: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """One vector per undirected edge: the structures' features side by side, 0
    where a structure lacks the edge. Any ``DataFrame -> edges`` function can
    supply a structure."""
    parts, columns = [], []
    for k, (edges, features) in enumerate(structures):
        renamed = {f: f"s{k}_{f}" for f in features}
        parts.append(edges.select("piece_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"),
                                  *[F.col(f).cast("double").alias(n) for f, n in renamed.items()]))
        columns += renamed.values()
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return union.groupBy("piece_id", "u", "v").agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns])
