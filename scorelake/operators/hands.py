"""Thinning of sonorities to two hands, fingering, its cost, and patterns.

A *frame* is one sounding onset of a piece. After ``drop_repeated`` a frame
holds at most one note per length and pitch, so frame-local work is bounded;
everything across frames uses the chunked helpers or joins on the neighbouring
frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_neighbours, with_row_number, with_running_max
from scorelake.functions.pitch import MIDDLE_C
from scorelake.session import cut_lineage
from scorelake.sources.views import ONSET, VOICE

SPAN = 7
FRAME = ["piece_id", "onset_tick"]


def onset_groups(notes: DataFrame) -> DataFrame:
    """Sounding notes keyed by onset, ties inside a measure merged into one
    longer note."""
    heard = notes.where(~F.col("is_rest"))
    w = Window.partitionBy(*VOICE, "measure_idx", "ps").orderBy("onset_tick", "event_id")
    goes_on = (F.col("tie").isin("continue", "stop") & F.lag("tie").over(w).isin("start", "continue")
               & (F.lag(F.col("onset_tick") + F.col("dur_tick")).over(w) == F.col("onset_tick")))
    islands = (heard.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
               .withColumn("__island", F.sum("__new").over(w)))
    first = F.struct("onset_tick", "event_id")
    return islands.groupBy(*VOICE, "measure_idx", "ps", "__island").agg(
        F.min("onset_tick").alias("onset_tick"), F.min("onset_ql").alias("onset_ql"),
        F.min_by("event_id", first).alias("event_id"), F.min_by("pc", first).alias("pc"),
        F.min_by("name", first).alias("name"),
        F.sum("dur_tick").alias("dur_tick"), F.sum("dur_ql").alias("dur_ql")).drop("__island")


def drop_repeated(groups: DataFrame) -> DataFrame:
    """Flag later notes of equal onset, length and pitch as deleted."""
    keys = [*FRAME, "dur_tick", "ps"]
    first = groups.groupBy(*keys).agg(F.min("event_id").alias("__first"))
    return (groups.join(first, keys, "left")
            .withColumn("deleted", F.col("event_id") != F.col("__first")).drop("__first"))


def kept(df: DataFrame) -> DataFrame:
    return df.where(~F.col("deleted")).drop("deleted")


def frame_notes(groups: DataFrame) -> DataFrame:
    """Notes of each frame without repeats: one per length and pitch."""
    keys = [*FRAME, "dur_tick", "ps"]
    others = [c for c in groups.columns if c not in (*keys, "event_id")]
    return groups.groupBy(*keys).agg(
        F.min("event_id").alias("event_id"), F.min_by(F.struct(*others), "event_id").alias("__n")
    ).select(*keys, "event_id", "__n.*")


def cluster_count(pitches: Column, span: int = SPAN) -> Column:
    """Clusters of width at most ``2 * span - 1`` that cover sorted distinct
    pitches, taken greedily from the lowest."""
    width = 2 * span - 1
    start = F.struct(F.lit(0).alias("n"), F.lit(-1000).alias("low"))
    step = lambda acc, p: F.when(
        p - acc["low"] > width, F.struct((acc["n"] + 1).alias("n"), p.cast("int").alias("low"))).otherwise(acc)
    return F.aggregate(pitches, start, step, lambda acc: acc["n"])


def hand_clusters(groups: DataFrame, span: int = SPAN) -> DataFrame:
    """Number of clusters per frame."""
    frames = groups.where(F.col("ps").between(12, 96)).groupBy(*FRAME).agg(
        F.array_sort(F.collect_set(F.col("ps").cast("int"))).alias("pitches"))
    return frames.select(*FRAME, cluster_count(F.col("pitches"), span).alias("clusters"))


# --- thinning of frames that need more than two hands ----------------------


def thinned(pitches: Column, span: int = SPAN) -> Column:
    """New pitch and deleted flag for the sorted pitches of a frame, as an array of ``ps`` and ``deleted``.

    A note goes if the one above it is of the lowest note's pitch class; from the lowest such note up, as
    many go as it takes to come down to two clusters. If all of them are not enough, every gap of an octave
    or more among those that stay is closed by whole octaves: a note rises by the octaves of all gaps above it."""
    n = F.size(pitches)
    # Positions that may go. The lowest note's position is 0.
    repeats = F.filter(F.transform(pitches, lambda p, i: F.when(
        F.pmod(F.get(pitches, i + 1), F.lit(12)) == F.pmod(F.get(pitches, F.lit(0)), F.lit(12)), i)), lambda i: i.isNotNull())

    def left(k: Column) -> Column:
        return F.filter(pitches, lambda p, i: ~F.array_contains(F.slice(repeats, 1, k), i))
    enough = F.filter(F.sequence(F.lit(0), F.size(repeats)), lambda k: cluster_count(left(k), span) <= 2)
    gone = F.slice(repeats, 1, F.coalesce(F.get(enough, F.lit(0)), F.size(repeats)))
    live = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(gone, i))
    wide = F.size(enough) == 0

    def rise(i: Column) -> Column:
        above = F.filter(live, lambda x: x >= i)
        gaps = F.zip_with(above, F.slice(above, 2, n), lambda a, b: F.get(pitches, b) - F.get(pitches, a))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + F.coalesce(g - g % 12, F.lit(0)))
    return F.transform(pitches, lambda p, i: F.struct(
        F.when(wide & ~F.array_contains(gone, i), p + rise(i)).otherwise(p).cast("int").alias("ps"),
        F.array_contains(gone, i).alias("deleted")))


def thin_frames(frame_rows: DataFrame) -> DataFrame:
    """``thinned`` on every frame; frames of at most two clusters stay as they are."""
    members = F.array_sort(F.collect_list(F.struct(F.col("ps").cast("int").alias("ps"), "event_id", "dur_tick")))
    frames = frame_rows.groupBy(*FRAME).agg(members.alias("m")).withColumn("p", F.col("m.ps"))
    same = F.transform("p", lambda p: F.struct(p.alias("ps"), F.lit(False).alias("deleted")))
    done = frames.withColumn("t", F.when(cluster_count(F.col("p")) > 2, thinned(F.col("p"))).otherwise(same))
    return (done.select(*FRAME, F.explode(F.arrays_zip("m", "t")).alias("z"))
            .select(*FRAME, "z.m.event_id", F.col("z.m.dur_tick").alias("dur_tick"),
                    F.col("z.m.ps").alias("old_ps"), "z.t.ps", "z.t.deleted"))


# --- hands and fingers ----------------------------------------------------


def split_hands(frame_rows: DataFrame, span: int = SPAN) -> DataFrame:
    """One hand if the frame spans at most ``span``; else the notes within
    ``span`` of the lowest go left, the others right."""
    # A frame without repeats is small, so it may be one window; the fingering
    # and the frame rows that follow use the same partitioning.
    w = Window.partitionBy(*FRAME)
    low, high = F.min("ps").over(w), F.max("ps").over(w)
    left = F.when(high - low <= span, low < MIDDLE_C).otherwise(F.col("ps") - low <= span)
    return frame_rows.withColumn("hand", F.when(left, "L").otherwise("R"))


FINGERS = 5


def initial_fingering(handed: DataFrame) -> DataFrame:
    """At most five notes per hand get a finger: the left keeps its lowest,
    counted from the top; the right keeps its highest, counted from below.
    Others have no hand and no finger."""
    by = Window.partitionBy(*FRAME, "hand")
    low = F.row_number().over(by.orderBy("ps", "event_id"))
    high = F.row_number().over(by.orderBy(F.desc("ps"), F.desc("event_id")))
    size = F.count(F.lit(1)).over(by)
    ranked = handed.withColumns({"__low": low, "__high": high, "__size": size})
    used = F.least("__size", F.lit(FINGERS))
    finger = (F.when((F.col("hand") == "L") & (F.col("__low") <= FINGERS), used - F.col("__low") + 1)
              .when((F.col("hand") == "R") & (F.col("__high") <= FINGERS), used - F.col("__high") + 1))
    return (ranked.withColumn("finger", finger.cast("int"))
            .withColumn("hand", F.when(F.col("finger").isNotNull(), F.col("hand")))
            .drop("__low", "__high", "__size"))


# --- cost -----------------------------------------------------------------


def finger_frames(fingered: DataFrame) -> DataFrame:
    """One row per frame with its placed notes, at most five per hand."""
    return fingered.groupBy("piece_id", "measure_idx", "onset_tick").agg(
        F.first("onset_ql").alias("onset_ql"),
        F.array_sort(F.collect_list(F.when(F.col("finger").isNotNull(), F.struct("hand", "finger", "ps")))).alias("placed"))


def _half_steps(ps: Column, other: Column) -> Column:
    return F.abs(ps - other) / 2


def _movement(placed: Column, before: Column) -> Column:
    """Movement of fingers placed in both frames plus, for a new finger, the way
    from the middle of its hand before."""
    def of(x: Column) -> Column:
        hand = F.filter(before, lambda y: y["hand"] == x["hand"])
        same = F.filter(hand, lambda y: y["finger"] == x["finger"])
        tones = F.array_sort(F.transform(hand, lambda y: y["ps"].cast("double")))
        n = F.size(tones)
        middle = (F.get(tones, F.floor((n - 1) / 2).cast("int")) + F.get(tones, F.floor(n / 2).cast("int"))) / 2
        return (F.when(F.size(same) > 0, _half_steps(x["ps"], F.get(same, 0)["ps"]))
                .when(n > 0, _half_steps(x["ps"], middle)).otherwise(F.lit(0.0)))
    return F.aggregate(F.transform(placed, of), F.lit(0.0), lambda a, m: a + m)


def frame_cost(frames: DataFrame) -> DataFrame:
    """Cost per frame, null where a neighbour is missing: five per note, busy
    neighbours, finger movement and new placements, per quarter length.
    Distances are half semitones."""
    linked = with_neighbours(frames, ["piece_id"], ["measure_idx"], ["onset_tick"],
                             ["onset_ql", "placed"], prev="__p", next="__n")
    length = F.col("__n.onset_ql") - F.col("onset_ql")
    total = (5 * F.size("placed") + F.size("__p.placed") + F.size("__n.placed")
             + _movement(F.col("placed"), F.col("__p.placed")))
    both = F.col("__p").isNotNull() & F.col("__n").isNotNull()
    return linked.withColumn("cost", F.when(both, total / length)).select(
        "piece_id", "measure_idx", "onset_tick", "cost")


def total_cost(costs: DataFrame) -> DataFrame:
    return costs.groupBy("piece_id").agg(F.sum("cost").alias("total_cost"))


def windowed_cost(costs: DataFrame) -> DataFrame:
    """Per frame, the costs whose three frames lie in ``[i - 2, i + 2)``: that of
    the frame and of the one before."""
    linked = with_neighbours(costs, ["piece_id"], ["measure_idx"], ["onset_tick"], ["cost"], prev="__p")
    return linked.select(*FRAME, (F.coalesce("cost", F.lit(0.0)) + F.coalesce(F.col("__p.cost"), F.lit(0.0)))
                         .alias("windowed_cost"))


def costly_frames(costs: DataFrame) -> DataFrame:
    """Frames at or above the piece's mean cost, by z-score."""
    costs = costs.where(F.col("cost").isNotNull())
    stats = costs.groupBy("piece_id").agg(F.avg("cost").alias("__m"), F.stddev_pop("cost").alias("__s"))
    z = (F.col("cost") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    return (costs.join(stats, "piece_id").withColumn("z_score", z).where(F.col("z_score") >= 0)
            .drop("__m", "__s").orderBy("piece_id", F.desc("z_score"), "onset_tick"))


# --- patterns on the piano roll -------------------------------------------


def frame_roll(groups: DataFrame) -> DataFrame:
    """Distinct pitches per frame with the frame's number in the piece."""
    cells = groups.where(F.col("ps").between(12, 96)).select(*ONSET, F.col("ps").cast("int").alias("ps")).distinct()
    frames = with_row_number(groups.select(*ONSET).distinct(), ["piece_id"], ["measure_idx"], ["onset_tick"], "frame_idx")
    return cells.join(frames, ONSET).select("piece_id", F.col("frame_idx").cast("long").alias("frame_idx"), "ps")


def triad_patterns(roll: DataFrame) -> DataFrame:
    """Frame triples of a third (3, 4 semitones) and a fifth (6, 7, 8)."""
    def above(name: str, steps: tuple[int, ...]) -> DataFrame:
        return roll.select("piece_id", "frame_idx", F.col("ps").alias(name),
                           F.explode(F.array(*[F.col("ps") - s for s in steps])).alias("ps"))
    return (roll.join(above("third", (3, 4)), ["piece_id", "frame_idx", "ps"])
            .join(above("fifth", (6, 7, 8)), ["piece_id", "frame_idx", "ps"])
            .select("piece_id", "frame_idx", F.col("ps").alias("root"), "third", "fifth"))


def repeat_runs(roll: DataFrame, min_len: int = 3) -> DataFrame:
    """Runs of one pitch over at least ``min_len`` successive frames."""
    chunked = roll.withColumn("__chunk", F.floor(F.col("frame_idx") / 1024))
    linked = with_neighbours(chunked, ["piece_id", "ps"], ["__chunk"], ["frame_idx"], ["frame_idx"], prev="__p")
    fresh = F.col("__p").isNull() | (F.col("__p.frame_idx") < F.col("frame_idx") - 1)
    runs = with_running_max(linked.withColumn("__start", F.when(fresh, F.col("frame_idx"))), ["piece_id", "ps"],
                            ["__chunk"], ["frame_idx"], {"first_frame": F.col("__start")})
    return (runs.groupBy("piece_id", "ps", "first_frame").agg(F.count(F.lit(1)).alias("length"))
            .where(F.col("length") >= min_len))


def diagonals(roll: DataFrame, direction: int = 1, min_len: int = 4, max_dist: int = 3, max_skip: int = 2) -> DataFrame:
    """Steps that lie on a diagonal of at least ``min_len`` notes.

    A diagonal moves 1 to ``max_skip`` frames and 1 to ``max_dist`` semitones at
    a time. The number of whole paths grows exponentially in dense scores, so
    they are given as the graph they form: each step with the longest reach
    behind its first and ahead of its second note, counted in notes up to
    ``min_len``. Every path through the listed steps from a note nothing leads
    to, to a note that leads nowhere, is a diagonal."""
    if direction not in (-1, 1):
        raise ValueError("direction must be 1 or -1")
    hops = [(x, direction * y) for x in range(1, max_skip + 1) for y in range(1, max_dist + 1)]
    hop = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in hops])
    cell = ["piece_id", "frame_idx", "ps"]
    steps = (roll.select(*cell, F.explode(hop).alias("h"))
             .select(*cell, (F.col("frame_idx") + F.col("h.x")).alias("to_frame"), (F.col("ps") + F.col("h.y")).alias("to_ps"))
             .join(roll.select("piece_id", F.col("frame_idx").alias("to_frame"), F.col("ps").alias("to_ps")),
                   ["piece_id", "to_frame", "to_ps"], "left_semi"))
    steps = cut_lineage(steps)
    to = ["piece_id", "to_frame", "to_ps"]

    def reach(start: list[str], end: list[str], name: str) -> DataFrame:
        """Longest chain of notes from a note along the steps, up to min_len."""
        depth = steps.select(*start).distinct().withColumn(name, F.lit(2))
        for n in range(3, min_len):
            ahead = depth.where(F.col(name) == n - 1).select(*[F.col(s).alias(e) for s, e in zip(start, end)])
            more = steps.join(ahead, end, "left_semi").select(*start).distinct().withColumn("__d", F.lit(n))
            depth = depth.join(more, start, "left").withColumn(name, F.coalesce("__d", name)).drop("__d")
        return depth
    ahead = reach(cell, to, "reach_ahead").select(*[F.col(c).alias(t) for c, t in zip(cell, to)], "reach_ahead")
    back = reach(to, cell, "reach_back").select(*[F.col(t).alias(c) for c, t in zip(cell, to)], "reach_back")
    return (steps.join(ahead, to, "left").join(back, cell, "left").na.fill(1, ["reach_ahead", "reach_back"])
            .where(F.col("reach_ahead") + F.col("reach_back") >= min_len)
            .select(*cell, "to_frame", "to_ps", "reach_back", "reach_ahead"))
