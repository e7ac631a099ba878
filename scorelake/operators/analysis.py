"""One chord for each event: chosen, extended, repaired; and what it says of the notes.

A bar is a row that holds its events as an array, and is folded by column functions: the state is the chord before, or the
event before as far as the next may still repair it. What a bar takes from the bar before is one chord. All bars are
folded at once from no chord; then those whose first choice becomes another by the chord before are folded again, until none does.
Tones are met as bits; what is asked for more than once is bound, as column functions work out anew what they name twice.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.functions.ordered import with_neighbours, with_running_max
from scorelake.operators import routes as rt
from scorelake.operators import tonal as tn
from scorelake.session import cut_lineage
from scorelake.sources.views import BAR

KEYS = ["piece_id"]


def with_modulation(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds ``now``, the latest step at or before each event (the piece's first
    one if there is none), and ``then``, the step before it."""
    told = ["measure_idx", "event_tick", "key", "from_chord", "to_chord"]
    linked = with_neighbours(steps.select("piece_id", *told), KEYS, ["measure_idx"], ["event_tick"],
                             ["from_chord", "to_chord"], prev="then")
    at = linked.select("piece_id", "measure_idx", "event_tick", F.struct(*told, "then").alias("mark"))
    merged = events.join(at, ["piece_id", "measure_idx", "event_tick"], "left")
    run = with_running_max(merged, KEYS, ["measure_idx"], ["event_tick"], {"now": F.col("mark")}).drop("mark")
    first = at.groupBy("piece_id").agg(F.min("mark").alias("__f"))
    return run.join(first, "piece_id", "left").withColumn("now", F.coalesce("now", "__f")).drop("__f")


# --- choosing one chord per event ------------------------------------------


@lru_cache
def _sevenths() -> dict[str, list[tuple[str, str, int]]]:
    """Triad -> (seventh chord on it, added tone, keys that have both as bits)."""
    out: dict = {}
    for seventh, low in hm.seventh_bases():
        added = sorted(set(seventh.split(",")) - set(low.split(",")))
        if len(added) == 1:
            out.setdefault(low, []).append((seventh, added[0], rt.key_sets()[seventh] & rt.key_sets().get(low, 0)))
    return out


def _literal(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("seventh"), F.lit(a).alias("added"), F.lit(k).cast("long").alias("keys")) for s, a, k in rows])


def _options(matched: Column, now: Column, here: Column) -> tuple[Column, Column]:
    """The chords an event chooses from, and whether the chord before is one of them."""
    named = F.array(now["to_chord"], now["from_chord"])
    both = F.concat(F.array(now["then"]["to_chord"], now["then"]["from_chord"]), named)
    named = F.when(here & now["then"].isNotNull(), both).otherwise(named)
    own = F.size(matched) > 0
    options = F.when(now.isNull(), F.slice(matched, 1, 1)).when(own, F.array_intersect(matched, named)).otherwise(named)
    return options, now.isNotNull() & own


def _outside(pitches: Column, chord: Column) -> Column:
    return F.array_except(pitches, tn.key_tones(chord))


def _masked(chord: Column) -> Column:
    """A chord of the dictionary (or no chord, as text or null) with its tones as bits."""
    return F.struct(chord.alias("chord"), F.coalesce(tn.tone_mask(tn.key_tones(chord)), F.lit(0).cast("long")).alias("mask"))


def _within(heard: Column, mask: Column) -> Column:
    """How many of the tones heard a chord has; the others are outside, names that no chord has among them."""
    return F.bit_count(heard.bitwiseAND(mask))


def _choose(e: Column, before: Column) -> Column:
    """The option with fewest tones outside, the last on a tie, as chord and mask; ``before`` is such a pair."""
    options = F.when(e["follows"], F.concat(e["options"], F.array(before))).otherwise(e["options"])
    none = F.struct(F.lit(None).cast("string").alias("chord"), F.lit(0).cast("long").alias("mask"))
    fewest = F.aggregate(options, F.struct(none.alias("c"), F.lit(-1).alias("n")), lambda s, c: F.when(
        _within(e["heard"], c["mask"]) >= s["n"], F.struct(c.alias("c"), _within(e["heard"], c["mask"]).alias("n"))).otherwise(s))
    return fewest["c"]


def _extended(chord: Column, pitches: Column, key_no: Column, table: Column) -> Column:
    """The first seventh chord on ``chord`` whose seventh sounds and whose key has both, or null."""
    able = F.filter(F.element_at(table, chord), lambda x: F.array_contains(pitches, x.added) & (F.getbit(x["keys"], key_no) == 1))
    return F.get(able, 0)["seventh"]


def _repaired(bar: str, pool: Column) -> Column:
    """Chord and dissonance of each event of the array: a dissonance shared with the event before is repaired there
    from the pool, then the chord before is borrowed if that is no worse. The event before stays open until then."""
    names = F.array(*[F.lit(t) for t in hm.tone_bits()])
    events = F.transform(bar, lambda e: F.struct(_masked(e["chord"]).alias("c"), tn.tone_mask(e["pitches"]).alias("heard"),
                                                 F.array_except(e["pitches"], names).alias("odd")))

    def fixed(last: Column, e: Column, meets: Column, masked: Column) -> Column:
        # A name that no chord has can't be repaired.
        shared = F.when(F.size(F.array_intersect(last["odd"], e["odd"])) > 0, F.lit(0).cast("long")).otherwise(
            e["heard"].bitwiseAND(last["heard"]).bitwiseAND(F.bitwise_not(e["c"]["mask"].bitwiseOR(last["c"]["mask"]))))
        start = F.struct(last["c"].alias("c"), _within(last["heard"], last["c"]["mask"]).alias("n"))
        better = lambda both, t, c: (both.bitwiseAND(F.bitwise_not(c["mask"])) == 0) & (_within(last["heard"], c["mask"]) >= t["n"])
        return F.when(meets, tn.bound(shared, lambda both: F.when(both != 0, F.aggregate(masked, start, lambda t, c: F.when(
            better(both, t, c), F.struct(c.alias("c"), _within(last["heard"], c["mask"]).alias("n"))).otherwise(t))["c"]))).otherwise(F.lit(None))

    def step(s: Column, e: Column, masked: Column) -> Column:
        last = s["last"]
        meets = last.isNotNull() & last["c"]["chord"].isNotNull() & e["c"]["chord"].isNotNull()

        def then(f: Column) -> Column:
            borrows = meets & (_within(e["heard"], f["mask"]) >= _within(e["heard"], e["c"]["mask"]))
            done = F.when(last.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(f["chord"])))
            return F.struct(done.alias("done"), F.struct(F.when(borrows, f).otherwise(e["c"]).alias("c"), e["heard"].alias("heard"), e["odd"].alias("odd")).alias("last"))
        return tn.bound(F.coalesce(fixed(last, e, meets, masked), last["c"]), then)
    kind = "struct<c:struct<chord:string,mask:bigint>,heard:bigint,odd:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast(kind).alias("last"))
    chords = tn.bound(F.transform(pool, _masked), lambda masked: F.aggregate(
        events, start, lambda s, e: step(s, e, masked), lambda s: F.concat(s["done"], F.array(s["last"]["c"]["chord"]))))
    return F.zip_with(bar, chords, lambda e, c: F.struct(
        c.alias("chord"), F.when(c.isNotNull(), _outside(e["pitches"], c)).otherwise(F.array().cast("array<string>")).alias("out"),
        e["event_tick"].alias("event_tick"), e["pitches"].alias("pitches"), e["key_no"].alias("key_no")))


def _folded(bars: DataFrame) -> DataFrame:
    """``bars`` (with the chord before as ``before``) with ``told``, the chord and dissonance of each event, ``final``, and the
    first event (``opens``) with its choice (``opening``), on which alone the chord before bears."""
    table = F.create_map(*[x for base, rows in _sevenths().items() for x in (F.lit(base), _literal(rows))])
    state = lambda out, c: F.struct(F.concat(out, F.array(c["chord"])).alias("out"), F.struct(
        F.coalesce(c["chord"], F.lit("")).alias("chord"), F.coalesce(c["mask"], F.lit(0).cast("long")).alias("mask")).alias("b"))
    chosen = F.aggregate("events", F.struct(F.array().cast("array<string>").alias("out"), _masked(F.col("before")).alias("b")),
                         lambda s, e: tn.bound(_choose(e, s["b"]), lambda c: state(s["out"], c)), lambda s: s["out"])
    told = lambda e, c, longer: F.struct(e["event_tick"].alias("event_tick"), e["pitches"].alias("pitches"), e["key_no"].alias("key_no"),
                                         F.coalesce(longer, c).alias("chord"), longer.alias("longer"))
    with_chord = F.zip_with("events", chosen, lambda e, c: tn.bound(_extended(c, e["pitches"], e["key_no"], table), lambda longer: F.struct(
        c.alias("own"), told(e, c, longer).alias("e"))))
    df = bars.withColumn("both", with_chord)
    df = df.withColumn("opening", F.get("both", 0)["own"]).withColumn("chosen", F.transform("both", lambda x: x["e"]))
    found = F.array_except(F.filter(F.transform("chosen", lambda e: e["longer"]), lambda x: x.isNotNull()), F.col("pool"))
    repaired = _repaired("chosen", F.concat("pool", found))
    last = lambda e, longer: F.struct(e["event_tick"].alias("event_tick"), F.coalesce(longer, F.when(e["chord"] != "", e["chord"])).alias("chord"),
                                      F.when(longer.isNotNull(), _outside(e["pitches"], longer)).otherwise(e["out"]).alias("dissonance"))
    df = df.withColumn("told", F.transform(repaired, lambda e: tn.bound(_extended(e["chord"], e["pitches"], e["key_no"], table), lambda longer: last(e, longer))))
    return df.select(*BAR, F.get("events", 0).alias("opens"), "opening", F.coalesce(F.element_at("told", -1)["chord"], F.lit("")).alias("final"), "told")


def choose_chords(events: DataFrame) -> DataFrame:
    """One chord per event with its key and dissonant names. ``events`` are those of ``with_modulation``, with ``pool``."""
    here = F.struct(F.col("now.measure_idx"), F.col("now.event_tick")) == F.struct("measure_idx", "event_tick")
    options, follows = _options(F.col("matched"), F.col("now"), here)
    key_no = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in rt.key_list()]), F.col("now.key")).cast("int") - 1, F.lit(63))  # 63: of no chord
    event = F.struct("event_tick", "pitches", F.transform(options, _masked).alias("options"), follows.alias("follows"), key_no.alias("key_no"),
                     tn.tone_mask(F.col("pitches")).alias("heard"))
    bars = cut_lineage(events.groupBy(*BAR).agg(F.array_sort(F.collect_list(event)).alias("events"), F.first("pool").alias("pool")))
    told = cut_lineage(_folded(bars.withColumn("before", F.lit(""))))
    while True:
        comes = F.coalesce(F.lag("final").over(Window.partitionBy(*KEYS).orderBy("measure_idx")), F.lit(""))  # a row for each bar
        told = told.withColumn("comes", comes)
        other = ~_choose(F.col("opens"), _masked(F.col("comes")))["chord"].eqNullSafe(F.col("opening"))
        late = cut_lineage(told.where(other).select(*BAR, F.col("comes").alias("before")))
        if late.isEmpty():
            break
        again = _folded(bars.join(late, BAR))
        told = cut_lineage(told.drop("comes").join(late.select(*BAR), BAR, "left_anti").unionByName(again))
    each = told.select(*BAR, F.explode("told").alias("t")).select(*BAR, "t.*")
    return events.join(each, tn.EVENT).withColumn("key", F.coalesce("now.key", F.lit(""))).withColumn(
        "chord", tn.bass_first(F.col("chord"), F.col("smeared")))


def analyse(notes: DataFrame, flow: DataFrame, reach: int = 4, tolerance: float = -0.5) -> DataFrame:
    """Chord, key and dissonance of every event."""
    events = cut_lineage(tn.matched_events(tn.sonority_events(notes)))
    pruned = cut_lineage(rt.prune_dead_ends(events))
    steps = cut_lineage(rt.modulations(*rt.flow_entries(pruned, flow), reach, tolerance))
    return choose_chords(cut_lineage(with_modulation(pruned, steps)))


def chosen_modulations(chosen: DataFrame, flow: DataFrame, reach: int = 4, tolerance: float = -0.5) -> DataFrame:
    """The second search: the steps along the chords that were chosen (``chord`` of ``analyse``)."""
    own = F.when(F.col("chord").isNull(), F.array().cast("array<string>")).otherwise(F.array(tn.chord_key(F.col("chord"))))
    return rt.modulations(*rt.flow_entries(chosen.select(*tn.EVENT, own.alias("matched")), flow), reach, tolerance)


def harmony_flags(notes: DataFrame, chords: DataFrame) -> DataFrame:
    """Per note: is it the first, second or third tone of the chord at its
    onset, and is it dissonant. Notes without a chord, or whose chord shares
    nothing with the event, get no flags."""
    told = chords.where(F.size(F.array_intersect("chord", "pitches")) > 0).select(
        *BAR, F.col("event_tick").alias("__at"), "chord", "dissonance")
    joined = notes.where(~F.col("is_rest")).withColumn("__at", F.floor(F.col("offset_ql") * tn.TICKS)).join(told, [*BAR, "__at"], "left")
    tone = lambda k: F.coalesce(F.get("chord", k) == F.col("name"), F.when(F.col("chord").isNotNull(), F.lit(False)))
    return joined.withColumns({"is_base": tone(0), "is_3rd": tone(1), "is_5th": tone(2),
                               "is_dissonant": F.array_contains("dissonance", F.col("name"))}).drop("__at", "chord", "dissonance")
