"""Building the two staves of the reduced score: chords, ties, voices, rests.

All steps are local to one bar and hand, where merged chords are distinct by
start and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.pitch import MIDDLE_C
from scorelake.sources.views import BAR

STAFF = [*BAR, "hand"]
TINY = 1e-4


def staff_hand(ps: Column) -> Column:
    return F.when(ps < MIDDLE_C, "L").otherwise("R")


def merge_to_chords(notes: DataFrame, hand: Column | None = None) -> DataFrame:
    """Notes of one hand, offset and length become one chord of distinct
    pitches; a tie stays if all members agree on it. The hand follows the pitch
    unless a column is given."""
    handed = notes.withColumn("hand", staff_hand(F.col("ps")) if hand is None else hand)
    keys = [*STAFF, "offset_ql", "dur_ql"]
    members = handed.groupBy(*keys, "ps").agg(F.max("tie").alias("tie"))
    agree = (F.count("tie") == F.count(F.lit(1))) & (F.min("tie") == F.max("tie"))
    return members.groupBy(*keys).agg(
        F.array_sort(F.collect_list("ps")).alias("pitches"), F.when(agree, F.min("tie")).alias("tie"),
        (F.count("tie") > 0).alias("any_tie"))


def clip_covering_ties(chords: DataFrame, bar_ql: float = 4.0, slot_ql: float = 0.25) -> DataFrame:
    """A tied chord that covers other chords of its staff loses the tie and is
    cut at the end of the measure. Adds ``end_ql``."""
    start, end = F.col("offset_ql"), F.col("offset_ql") + F.col("dur_ql")
    timed = chords.withColumn("end_ql", end)
    slots = F.sequence(F.floor(start / slot_ql), F.greatest(F.ceil(end / slot_ql) - 1, F.floor(start / slot_ql)))
    live = timed.where(F.col("dur_ql") > 0)
    tied = live.where("any_tie").select(*STAFF, "offset_ql", "dur_ql", "end_ql", F.explode(slots).alias("slot"))
    other = live.select(*STAFF, F.col("offset_ql").alias("o_start"), F.col("end_ql").alias("o_end"),
                        F.explode(slots).alias("slot"))
    meets = ((F.col("o_start") < F.col("end_ql")) & (F.col("offset_ql") < F.col("o_end"))
             & ((F.col("o_start") != F.col("offset_ql")) | (F.col("o_end") != F.col("end_ql"))))
    covering = (tied.join(other, [*STAFF, "slot"]).where(meets)
                .select(*STAFF, "offset_ql", "dur_ql").distinct().withColumn("__covers", F.lit(True)))
    covers = F.coalesce(F.col("__covers"), F.lit(False))
    return (timed.join(covering, [*STAFF, "offset_ql", "dur_ql"], "left")
            .withColumn("tie", F.when(~covers, F.col("tie")))
            .withColumn("end_ql", F.when(covers, F.least("end_ql", F.lit(bar_ql))).otherwise(F.col("end_ql")))
            .drop("__covers", "any_tie"))


ENTRY = ["voice_no", "offset_ql", "end_ql", "pitches", "is_rest"]


def first_fit(spans: Column) -> Column:
    """Voices (from 0) of spans ``s``, ``e`` sorted by both: the first voice whose last span has ended."""
    state = F.struct(F.array().cast("array<double>").alias("ends"), F.array().cast("array<int>").alias("voices"))

    def place(acc: Column, x: Column) -> Column:
        free = F.filter(F.transform(acc["ends"], lambda e, k: F.when(e <= x["s"], k)), lambda k: k.isNotNull())
        v = F.coalesce(F.get(free, F.lit(0)), F.size(acc["ends"]))
        longer = F.concat(acc["ends"], F.array_repeat(x["e"], F.when(F.size(free) == 0, 1).otherwise(0)))
        return F.struct(F.transform(longer, lambda e, k: F.when(k == v, x["e"]).otherwise(e)).alias("ends"),
                        F.concat(acc["voices"], F.array(v)).alias("voices"))
    return F.aggregate(spans, state, place, lambda acc: acc["voices"])


def voice_partition(chords: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """Voices of non-overlapping chords per bar and hand, rests included. Chords are gathered per staff
    bar, where they are distinct by start and end."""
    item = F.struct(F.col("offset_ql").alias("s"), F.col("end_ql").alias("e"), F.col("pitches").cast("array<int>").alias("p"))
    bars = chords.groupBy(*STAFF).agg(F.array_sort(F.collect_list(item)).alias("c"))
    rows = bars.select(*STAFF, F.explode(F.arrays_zip("c", first_fit(F.col("c")).alias("v"))).alias("z"))
    voiced = rows.select(*STAFF, F.col("z.v").alias("voice_no"), F.col("z.c.s").alias("offset_ql"),
                         F.col("z.c.e").alias("end_ql"), F.col("z.c.p").alias("pitches"), F.lit(False).alias("is_rest"))
    entry = lambda a, b, p, r: F.struct(a.alias("offset_ql"), b.alias("end_ql"), p.alias("pitches"), F.lit(r).alias("is_rest"))
    none = F.array().cast("array<int>")
    gap = lambda g: F.when(g["e"] - g["s"] >= TINY, entry(g["s"], g["e"], none, True))
    before, after = _gaps(bar_ql)
    voiced = voiced.withColumn("before", before).withColumn("after", after)
    before, after = F.col("before"), F.col("after")
    return voiced.select(*STAFF, "voice_no", F.explode(F.array_compact(F.array(
        entry(F.col("offset_ql"), F.col("end_ql"), F.col("pitches"), False), gap(before), gap(after)))).alias("n")).select(*STAFF, "voice_no", "n.*")


def _settled(rows: DataFrame) -> DataFrame:
    """Entries that share voice, start and end as one: their pitches; a rest only if all are rests."""
    return rows.groupBy(*STAFF, "voice_no", "offset_ql", "end_ql").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pitches")))).alias("pitches"),
        F.bool_and("is_rest").alias("is_rest")).select(*STAFF, *ENTRY)


def limit_voices(chords: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """At most two voices where chords find a place: of more, the most silent are given up (of equal ones the
    later); of two, those silent for half the bar. A given-up chord joins the entry of equal start and nearest length
    in a voice that stays (of equal ones the first); without one it stays in its voice."""
    bar = Window.partitionBy(*STAFF)
    silence = F.sum(F.when(F.col("is_rest"), F.col("end_ql") - F.col("offset_ql")).otherwise(0.0))
    rows = voice_partition(chords, bar_ql).withColumn("silent", silence.over(Window.partitionBy(*STAFF, "voice_no")))
    rows = rows.withColumn("rank", F.dense_rank().over(bar.orderBy(F.desc("silent"), F.desc("voice_no")))).withColumn("n", F.max("rank").over(bar))
    rows = rows.withColumn("excess", F.when(F.col("n") > 2, F.col("rank") <= F.col("n") - 2).otherwise(
        (F.col("n") == 2) & (F.col("silent") >= bar_ql / 2)))
    place = F.when(~F.col("excess"), F.struct("voice_no", "end_ql"))
    rows = rows.withColumn("places", F.collect_list(place).over(Window.partitionBy(*STAFF, "offset_ql"))).where("not (excess and is_rest)")
    length = F.col("end_ql") - F.col("offset_ql")
    host = F.array_min(F.transform("places", lambda h: F.struct(
        F.abs((h["end_ql"] - F.col("offset_ql")) - length).alias("far"), h["voice_no"].alias("voice_no"), h["end_ql"].alias("end_ql"))))
    rows = rows.withColumn("host", F.when(F.col("excess"), host))
    return _settled(rows.select(*STAFF, F.coalesce("host.voice_no", "voice_no").alias("voice_no"), "offset_ql",
                                F.coalesce("host.end_ql", "end_ql").alias("end_ql"), "pitches", "is_rest"))


def nested_targets(voices: Column) -> Column:
    """For the voices of a bar (``v``, ``on``: starts of chords, ``at``: all starts; in order), the voice each
    ends up in. Pairs are tried in order; of two, the one with fewer chords joins the other if all its
    chords start where that one has an entry."""
    numbers = F.sequence(F.lit(0), F.size(voices) - 1)
    pairs = F.flatten(F.transform(numbers, lambda i: F.transform(
        F.filter(numbers, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    start = F.transform(voices, lambda x: F.struct(x["v"].alias("to"), x["v"].alias("v"), x["on"].alias("on"), x["at"].alias("at")))

    def meet(acc: Column, p: Column) -> Column:
        x, y = F.get(acc, p["i"]), F.get(acc, p["j"])
        turn = F.size(x["on"]) > F.size(y["on"])
        one, other = F.when(turn, y).otherwise(x), F.when(turn, x).otherwise(y)
        fits = ((x["to"] == x["v"]) & (y["to"] == y["v"]) & (F.size(F.array_except(one["on"], other["at"])) == 0))
        joined = F.transform(acc, lambda z: F.struct(
            F.when(z["to"] == one["v"], other["v"]).otherwise(z["to"]).alias("to"), z["v"].alias("v"),
            F.when(z["v"] == other["v"], F.array_union(z["on"], one["on"])).otherwise(z["on"]).alias("on"), z["at"].alias("at")))
        return F.when(fits, joined).otherwise(acc)
    return F.aggregate(pairs, start, meet, lambda acc: F.transform(acc, lambda z: F.struct(z["v"].alias("v"), z["to"].alias("to"))))


def merge_nested_voices(chords: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """``limit_voices``, then voices folded into others by ``nested_targets``. The rests of a folded voice go."""
    bars = limit_voices(chords, bar_ql).groupBy(*STAFF).agg(F.collect_list(F.struct(*ENTRY)).alias("e"))
    starts = lambda found: F.array_distinct(F.transform(found, lambda x: x["offset_ql"]))
    voices = F.transform(F.array_sort(F.array_distinct("e.voice_no")), lambda v: F.struct(
        v.alias("v"), starts(F.filter("e", lambda x: (x["voice_no"] == v) & ~x["is_rest"])).alias("on"),
        starts(F.filter("e", lambda x: x["voice_no"] == v)).alias("at")))
    rows = bars.withColumn("voices", voices).withColumn("targets", nested_targets(F.col("voices"))).select(
        *STAFF, "targets", F.explode("e").alias("x")).select(*STAFF, "x.*", F.get(F.filter(
            "targets", lambda t: t["v"] == F.col("x.voice_no")), F.lit(0))["to"].alias("to"))
    own = F.col("to") == F.col("voice_no")
    end = F.max(F.when(own, F.col("end_ql"))).over(Window.partitionBy(*STAFF, "to", "offset_ql"))
    rows = rows.withColumn("host_end", end).where(own | ~F.col("is_rest"))
    return _settled(rows.select(*STAFF, F.col("to").alias("voice_no"), "offset_ql",
                                F.when(own, F.col("end_ql")).otherwise(F.col("host_end")).alias("end_ql"), "pitches", "is_rest"))


def _gaps(bar_ql: float) -> tuple[Column, Column]:
    """Spans of silence before an entry of a voice and, for the last one, after it."""
    w = Window.partitionBy(*STAFF, "voice_no").orderBy("offset_ql", "end_ql")
    before = F.coalesce(F.lag("end_ql").over(w), F.lit(0.0))
    last = F.lead("offset_ql").over(w).isNull()
    return (F.struct(before.alias("s"), F.col("offset_ql").alias("e")),
            F.struct(F.when(last, F.col("end_ql")).alias("s"), F.lit(float(bar_ql)).alias("e")))


def fill_rests(voiced: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """Gaps of each voice in its measure as rest rows."""
    gaps = voiced.withColumn("g", F.array(*_gaps(bar_ql)))
    return (gaps.select(*STAFF, "voice_no", F.explode("g").alias("g"))
            .where(F.col("g.e") - F.col("g.s") >= TINY)
            .select(*STAFF, "voice_no", F.col("g.s").alias("offset_ql"), F.col("g.e").alias("end_ql")))


def reduced_staves(notes: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """The whole way from kept notes to the entries of two staves."""
    return merge_nested_voices(clip_covering_ties(merge_to_chords(notes), bar_ql), bar_ql)


# --- the simpler two-hand layout ------------------------------------------


def median_hand(notes: DataFrame) -> DataFrame:
    """Per measure and part, right (1) when the median pitch is at least 60,
    else left (2)."""
    keys = [*BAR, "part_idx"]
    mid = notes.groupBy(*keys).agg(F.percentile("ps", F.lit(0.5)).alias("__m"))
    return (notes.join(mid, keys, "left")
            .withColumn("hand", F.when(F.col("__m") >= MIDDLE_C, 1).otherwise(2)).drop("__m"))


def silences(notes: DataFrame) -> DataFrame:
    """Starts of the stretches of a bar in which every part of the piece rests."""
    parts = notes.select("piece_id", "part_idx").distinct().groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_parts"))
    rests = notes.where("is_rest").select(*BAR, F.explode(F.array(
        F.struct(F.col("offset_ql").alias("t"), F.lit(1).alias("d")),
        F.struct((F.col("offset_ql") + F.col("dur_ql")).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = rests.groupBy(*BAR, F.col("x.t").alias("offset_ql")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*BAR).orderBy("offset_ql")
    level = steps.withColumn("level", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(parts, "piece_id")
    quiet = (F.col("level") == F.col("n_parts")) & F.coalesce(F.lag("level").over(w) != F.col("n_parts"), F.lit(True))
    return level.withColumn("__q", quiet).where("__q").select(*BAR, "offset_ql")


def legato_durations(handed: DataFrame, notes: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """Per hand and bar, onsets that each last to the next one or the end of the
    bar; rests where all parts are silent, and before a late first onset."""
    keys = STAFF
    onsets = handed.groupBy(*keys, "offset_ql").agg(
        F.array_sort(F.collect_set(F.when(F.col("tie").isNull() | (F.col("tie") == "start"), F.col("ps")))).alias("pitches"))
    hands = onsets.select(*keys).distinct()
    quiet = silences(notes).join(hands, BAR)
    none = F.array().cast(onsets.schema["pitches"].dataType)
    marks = (onsets.withColumn("silent", F.lit(False))
             .unionByName(quiet.select(*keys, "offset_ql", none.alias("pitches"), F.lit(True).alias("silent"))))
    w = Window.partitionBy(*keys).orderBy("offset_ql", F.desc("silent"))
    timed = marks.withColumn("end_ql", F.coalesce(F.lead("offset_ql").over(w), F.lit(float(bar_ql)))).withColumn(
        "first", F.row_number().over(w) == 1)
    late = timed.where(F.col("first") & ~F.col("silent") & (F.abs("offset_ql") > TINY))
    lead_in = late.select(*keys, F.lit(0.0).alias("offset_ql"), F.col("offset_ql").alias("end_ql"), none.alias("pitches"))
    start = F.when(F.col("first") & F.col("silent"), 0.0).otherwise(F.col("offset_ql"))
    body = timed.select(*keys, start.alias("offset_ql"), "end_ql", "pitches")
    return (body.unionByName(lead_in).withColumn("dur_ql", F.col("end_ql") - F.col("offset_ql"))
            .where(F.col("dur_ql") > 1e-2).select(*keys, "offset_ql", "dur_ql", "pitches"))


def close_chord(pitches: Column, fold_up: Column, reach: int = 12) -> Column:
    """Notes farther than the reach from the outer note that stays (the highest, if folding up) move
    towards it by as many octaves as they need. The outer note never moves, so each note is settled alone."""
    low, high = F.array_min(pitches), F.array_max(pitches)
    octaves = lambda far: F.greatest(F.ceil(far / 12), F.lit(0)).cast("int") * 12
    moved = F.transform(pitches, lambda p: F.when(fold_up, p + octaves(high - reach - p)).otherwise(p - octaves(p - low - reach)))
    return F.array_sort(F.array_distinct(moved))


def playable_chords(chords: DataFrame) -> DataFrame:
    """Chords wider than an octave folded together: upwards where the median of
    the bar's distinct pitches lies above 60, else downwards."""
    tones = chords.select(*STAFF, F.explode("pitches").alias("ps")).distinct()
    mid = tones.groupBy(*STAFF).agg((F.percentile("ps", F.lit(0.5)) > 60).alias("__up"))
    joined = chords.join(mid, STAFF, "left").withColumn("__up", F.coalesce("__up", F.lit(False)))
    return joined.withColumn("pitches", close_chord(F.col("pitches"), F.col("__up"))).drop("__up")


def contracted_score(notes: DataFrame, mapping: DataFrame, bar_ql: float = 4.0) -> DataFrame:
    """Staves of the notes that are not contracted into another one."""
    live = notes.join(mapping.where(~F.col("is_contracted")).select("piece_id", "note_idx"),
                      ["piece_id", "note_idx"], "left_semi")
    return reduced_staves(live, bar_ql)
