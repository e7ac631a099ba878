"""Sonorities, chord matching and harmonic flow.

Events are sonority slices of a bar. Their pitch sets are bounded by the pitch
range and the dictionary has a fixed size, so everything about one event fits
in arrays; rows meet by equality on bar, onset or chord set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.functions.ordered import with_neighbours, with_row_number
from scorelake.functions.pitch import accidental_shift, letter_pc, letter_step
from scorelake.session import cut_lineage
from scorelake.sources.views import BAR

EVENT = [*BAR, "event_tick"]
TICKS = 1024


# --- slices ---------------------------------------------------------------


def _slices(notes: DataFrame, halfway: bool, slot_ticks: int = 256) -> DataFrame:
    """(bar, event tick, tone) for every tone sounding at every slice of its
    bar. Notes are reduced to distinct tones and lengths first; a tone is
    spread over the time slots it covers and meets the slices of those."""
    tick = F.floor(F.col("offset_ql") * TICKS).cast("long")
    tones = notes.where(~F.col("is_rest") & (F.col("dur_tick") > 0)).select(
        *BAR, tick.alias("s"), (tick + F.col("dur_tick")).alias("e"), "octave", "name", "pc").distinct()
    starts = [F.col("s")]
    if halfway:
        starts.append(F.when(F.col("e") - F.col("s") == 2 * TICKS, F.col("s") + TICKS))
    events = (tones.select(*BAR, F.explode(F.array(*starts)).alias("event_tick")).where(F.col("event_tick").isNotNull())
              .distinct().withColumn("slot", F.floor(F.col("event_tick") / slot_ticks)))
    spread = tones.withColumn("slot", F.explode(F.sequence(
        F.floor(F.col("s") / slot_ticks), F.floor((F.col("e") - 1) / slot_ticks))))
    return (events.join(spread, [*BAR, "slot"])
            .where((F.col("s") <= F.col("event_tick")) & (F.col("event_tick") < F.col("e")))
            .select(*EVENT, "octave", "name", "pc"))


def _tone() -> Column:
    """Sorts by octave, then letter from C, then spelling."""
    return F.struct("octave", letter_pc(F.substring("name", 1, 1)).alias("letter"), "name")


def tone_names(tones: Column) -> Column:
    return F.array_distinct(F.transform(F.array_sort(tones), lambda t: t["name"]))


def sonority_events(notes: DataFrame) -> DataFrame:
    """One row per slice: every onset of the bar, and the middle of every note
    of length 2. ``tones`` holds all that sounds, ``pitches`` the distinct names
    from the lowest octave up, ``bass`` the lowest; ``event_idx`` counts in the
    bar and ``global_idx`` in the piece."""
    events = _slices(notes, halfway=True).groupBy(*EVENT).agg(
        F.array_sort(F.collect_set(_tone())).alias("tones"),
        F.min_by("name", F.struct("octave", "pc", "name")).alias("bass"))
    events = events.withColumn("pitches", tone_names(F.col("tones")))
    events = events.withColumn(
        "event_idx", (F.row_number().over(Window.partitionBy(*BAR).orderBy("event_tick")) - 1).cast("long"))
    return with_row_number(events, ["piece_id"], ["measure_idx"], ["event_tick"], "global_idx")


def smear_events(events: DataFrame) -> DataFrame:
    """Adds ``smeared``: names of this event and its neighbours in the bar."""
    w = Window.partitionBy(*BAR).orderBy("event_tick")
    none = F.array().cast(events.schema["tones"].dataType)
    around = F.concat(F.coalesce(F.lag("tones").over(w), none), F.col("tones"), F.coalesce(F.lead("tones").over(w), none))
    return events.withColumn("smeared", tone_names(around))


def events_between(events: DataFrame, first: tuple[int, float], last: tuple[int, float]) -> DataFrame:
    """Events from one (measure, offset) up to, not including, another."""
    at = F.struct("measure_idx", (F.col("event_tick") / TICKS).alias("offset"))
    def point(p: tuple[int, float]) -> Column:
        return F.struct(F.lit(p[0]).cast("int").alias("measure_idx"), F.lit(float(p[1])).alias("offset"))
    return events.where((at >= point(first)) & (at < point(last)))


def chordify(notes: DataFrame) -> DataFrame:
    """Slices at every onset as sorted pitch classes."""
    return _slices(notes, halfway=False).groupBy(*EVENT).agg(F.array_sort(F.collect_set("pc")).alias("pcs"))


# --- dictionary frames ----------------------------------------------------


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of fixed size from the dictionary, broadcast on use."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def chord_dictionary(spark: SparkSession) -> DataFrame:
    return _small(spark, [(t, m, n, r, list(c), hm.set_key(c)) for t, m, n, r, c in hm.chord_dictionary()],
                  "tonic string, mode string, numeral string, root_position boolean, tones array<string>, chord string")


def chord_key(names: Column) -> Column:
    """A chord as text: its distinct tones in alphabetical order."""
    return F.array_join(F.array_sort(F.array_distinct(names)), ",")


def key_tones(chord: Column) -> Column:
    return F.split(chord, ",")


# --- matching -------------------------------------------------------------


def match_exact(events: DataFrame) -> DataFrame:
    """(event, chord): the smeared or own set of an event is a chord. A
    four-tone chord stands for the triads at the bottom of its positions, and
    is itself only a ``candidate`` for the bar."""
    spark = events.sparkSession
    sets = _small(spark, hm.chord_sets(), "chord string, size int")
    bases = _small(spark, hm.seventh_bases(), "chord string, base string")
    read = events.select(*EVENT, F.explode(F.array(chord_key(F.col("smeared")), chord_key(F.col("pitches")))).alias("chord"))
    hits = read.distinct().join(sets, "chord")
    three = hits.where(F.col("size") == 3).select(*EVENT, "chord", F.lit(True).alias("matched"))
    four = hits.where(F.col("size") == 4).select(*EVENT, "chord", F.lit(False).alias("matched"))
    under = hits.where(F.col("size") == 4).join(bases, "chord").select(*EVENT, F.col("base").alias("chord"), F.lit(True).alias("matched"))
    return three.unionByName(four).unionByName(under).distinct()


def bar_candidates(matches: DataFrame) -> DataFrame:
    """Three-tone chords found in each bar."""
    small = matches.where(F.size(key_tones(F.col("chord"))) != 4)
    return small.groupBy(*BAR).agg(F.array_sort(F.collect_set("chord")).alias("candidates"))


def tone_mask(names: Column) -> Column:
    """The tones of the dictionary among ``names`` as bits; other names are in no chord of it."""
    bits = F.create_map(*[F.lit(x) for t, k in hm.tone_bits().items() for x in (t, 1 << k)])
    return F.aggregate(names, F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.coalesce(F.element_at(bits, t).cast("long"), F.lit(0).cast("long"))))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, not anew for each element of an inner lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def match_candidates(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``fitting``: candidates of the bar that miss at most one tone of the
    smeared event. Their tones are read once a bar, and met as bits."""
    masked = candidates.withColumn("candidates", F.transform("candidates", lambda c: F.struct(
        c.alias("chord"), tone_mask(key_tones(c)).alias("mask"), F.size(F.array_distinct(key_tones(c))).alias("tones"))))
    fits = F.when(F.col("candidates").isNull(), F.array().cast("array<string>")).otherwise(bound(
        tone_mask(F.col("smeared")), lambda heard: F.transform(
            F.filter("candidates", lambda c: c["tones"] - F.bit_count(c["mask"].bitwiseAND(heard)) <= 1), lambda c: c["chord"])))
    return events.join(masked, BAR, "left").withColumn("fitting", fits).drop("candidates")


def bass_first(chord: Column, order: Column) -> Column:
    """Chord tones in the order of the event, the missing ones last."""
    tones = key_tones(chord)
    return F.concat(F.array_intersect(order, tones), F.array_except(tones, order))


def match_partial(smeared: Column) -> Column:
    """Triads of the dictionary that share at least two tones with the event."""
    table = F.array(*[F.struct(F.lit(t).alias("chord"), F.lit(hm.chord_mask(t)).cast("long").alias("mask")) for t in hm.triads()])
    return bound(tone_mask(smeared), lambda heard: F.transform(
        F.filter(table, lambda c: F.bit_count(c["mask"].bitwiseAND(heard)) >= 2), lambda c: c["chord"]))


def matched_events(events: DataFrame) -> DataFrame:
    """``matched``: the sorted chords each event may stand for. Exact matches
    make the bar's candidates; fitting candidates replace an event's own match;
    an event without any, but more than one name, takes partial matches, which
    become candidates too. ``pool`` has all chords found in the bar, those of four tones too."""
    smeared = cut_lineage(smear_events(events))
    exact = cut_lineage(match_exact(smeared))
    own = exact.where("matched").groupBy(*EVENT).agg(F.array_sort(F.collect_set("chord")).alias("own"))
    first = match_candidates(smeared, bar_candidates(exact)).join(own, EVENT, "left")
    none = F.array().cast("array<string>")
    partial = F.when((F.size("fitting") == 0) & (F.size("pitches") != 1), match_partial(F.col("smeared"))).otherwise(none)
    tried = first.withColumns({"partial": partial, "found": F.size("fitting") > 0})
    tried = tried.withColumn("matched", F.when(F.col("found"), F.col("fitting")).otherwise(
        F.array_sort(F.array_union(F.coalesce("own", none), "partial"))))
    tried = cut_lineage(tried)
    more = tried.groupBy(*BAR).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("partial")))).alias("more"))
    read = exact.groupBy(*BAR).agg(F.array_sort(F.collect_set("chord")).alias("read"))
    both = bar_candidates(exact).join(more, BAR, "full").join(read, BAR, "full")
    fit = F.array_union(F.coalesce("candidates", none), F.coalesce("more", none)).alias("candidates")
    pool = F.array_sort(F.array_union(F.coalesce("read", none), F.coalesce("more", none))).alias("pool")
    again = match_candidates(tried.drop("fitting"), both.select(*BAR, fit, pool))
    final = F.when(F.col("found") | (F.size("fitting") > 0), F.array_sort("fitting")).otherwise(F.col("matched"))
    return again.withColumn("matched", final).drop("own", "partial", "found", "fitting")


# --- flow -----------------------------------------------------------------


def chord_flow(spark: SparkSession, weights: DataFrame | None = None) -> DataFrame:
    """(from, to, tonic, mode) -> numerals and weight; 0 when the numeral stays.
    Chords are sets, read in root position. ``weights`` has (mode, from_numeral,
    to_numeral, weight); absent pairs weigh 0."""
    dictionary = chord_dictionary(spark).where("root_position")
    a = dictionary.select("tonic", "mode", F.col("chord").alias("from_chord"), F.col("numeral").alias("from_numeral"))
    b = dictionary.select("tonic", "mode", F.col("chord").alias("to_chord"), F.col("numeral").alias("to_numeral"))
    if weights is None:
        weights = spark.createDataFrame([(*k, w) for k, w in hm.rule_weights().items()],
                                        "mode string, from_numeral string, to_numeral string, weight double")
    stay = F.col("from_numeral") == F.col("to_numeral")
    return (a.join(b, ["tonic", "mode"]).join(F.broadcast(weights), ["mode", "from_numeral", "to_numeral"], "left")
            .withColumn("weight", F.when(stay, 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))))


def flow_ways(flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps of each (from_chord, tonic, mode) as ``ways``, the best first (of equal weight in name order), and
    one row with the chords ``known`` that they lead to; ``no`` is the place of a way's chord in these. Both have the size of the flow."""
    known = flow.agg(F.array_sort(F.collect_set("to_chord")).alias("known"))
    way = F.struct((-F.col("weight")).alias("cost"), "to_chord", (F.array_position("known", F.col("to_chord")) - 1).cast("int").alias("no"),
                   "weight", "from_numeral", "to_numeral")
    ways = flow.crossJoin(F.broadcast(known)).groupBy("from_chord", "tonic", "mode").agg(F.array_sort(F.collect_list(way)).alias("ways"))
    return ways, known


def best_flow(matched: DataFrame, flow: DataFrame) -> DataFrame:
    """For each chord of an event and each key, the chord of the next event with
    the highest weight (the first in name order on a tie): the first of the key's ways
    that the next event has, so the rows of an event need not be sorted or grouped again."""
    linked = with_neighbours(matched.select(*EVENT, "matched"), ["piece_id"], ["measure_idx"], ["event_tick"],
                             ["matched"], next="__n")
    ways, known = flow_ways(flow)
    there = F.transform("known", lambda c: F.array_contains("__n.matched", c)).alias("__there")
    told = linked.where(F.size("__n.matched") > 0).crossJoin(F.broadcast(known)).select(*EVENT, "matched", there)
    pairs = told.select(*EVENT, F.explode("matched").alias("from_chord"), "__there").join(F.broadcast(ways), "from_chord")
    first = F.slice(F.filter("ways", lambda w: F.get("__there", w["no"])), 1, 1)
    return pairs.select(*EVENT, "from_chord", "tonic", "mode", F.inline(first)).select(
        *EVENT, "from_chord", "tonic", "mode", "to_chord", "weight", "from_numeral", "to_numeral")


def sevenths_in_key(chords: DataFrame, flow: DataFrame) -> DataFrame:
    """(event, chord, tonic, mode) -> seventh chord: the seventh sounds and the
    key knows the step from chord to seventh. ``chords`` has the event's
    ``pitches`` and ``chord``."""
    spark = chords.sparkSession
    bases = _small(spark, hm.seventh_bases(), "seventh string, chord string")
    added = F.array_except(key_tones(F.col("seventh")), key_tones(F.col("chord")))
    able = chords.join(bases, "chord").where(F.array_contains(F.col("pitches"), F.get(added, 0)))
    steps = flow.select(F.col("from_chord").alias("chord"), F.col("to_chord").alias("seventh"), "tonic", "mode")
    return able.join(F.broadcast(steps), ["chord", "seventh"])


def missing_chords(spark: SparkSession, flow: DataFrame) -> DataFrame:
    """Basic chords no flow starts from."""
    basic = spark.createDataFrame(hm.basic_chords(), "root string, type string, chord string")
    return basic.join(flow.select(F.col("from_chord").alias("chord")).distinct(), "chord", "left_anti")


def outside_tones(pitches: Column, chord: Column) -> Column:
    return F.array_except(pitches, chord)


def mark_repeated_chords(events: DataFrame, chord: str = "chord") -> DataFrame:
    """An event repeats when its chord equals that of the event before it in
    the bar; no chord at the start of a bar counts as a repeat."""
    w = Window.partitionBy(*BAR).orderBy("event_tick")
    before = F.lag(F.coalesce(F.col(chord), F.lit("")), 1, "").over(w)
    return events.withColumn("duplicated", F.coalesce(F.col(chord), F.lit("")) == before)


def chord_inversion(tones: Column, bass: Column) -> Column:
    position = F.array_position(tones, bass)
    names = ["root", "first", "second", "third"]
    case = F.when(position == 0, "undecided")
    for i, n in enumerate(names):
        case = case.when(position == i + 1, n)
    return case.otherwise("undecided")


def in_inversion(tones: Column, bass: Column) -> Column:
    """The chord spelled from its bass up."""
    p = F.array_position(tones, bass).cast("int")
    turned = F.concat(F.slice(tones, p, F.size(tones) - p + 1), F.slice(tones, 1, p - 1))
    return F.when((p >= 1) & F.size(tones).isin(3, 4), turned).otherwise(tones)


def analysis_result(events: DataFrame, chord: str = "chord") -> DataFrame:
    """Index, pitches and chord tones from the bass up, or ``n/a``."""
    shown = F.array_join(bass_first(F.col(chord), F.col("pitches")), ",")
    return events.select("piece_id", "global_idx", F.array_join("pitches", ",").alias("pitches"),
                         F.when(F.col(chord).isNotNull(), shown).otherwise("n/a").alias("chord"))


# --- keys -----------------------------------------------------------------

# Published key profiles, from the tonic up.
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def key_estimate(histogram: DataFrame) -> DataFrame:
    """The key whose profile correlates best with a bar's pitch-class histogram
    (columns ``pc_stat_0`` to ``pc_stat_11``)."""
    h = [F.col(f"pc_stat_{k}") for k in range(12)]
    mean = sum(h[1:], h[0]) / 12
    centred = [x - mean for x in h]
    norm = F.sqrt(sum([c * c for c in centred[1:]], centred[0] * centred[0]))
    scores = []
    for mode, profile in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)):
        m = sum(profile) / 12
        size = sum((p - m) ** 2 for p in profile) ** 0.5
        for tonic in range(12):
            shape = [(profile[(k - tonic) % 12] - m) / size for k in range(12)]
            dot = sum([c * s for c, s in zip(centred[1:], shape[1:])], centred[0] * shape[0])
            scores.append(F.struct(F.round(F.when(norm == 0, 0.0).otherwise(dot / norm), 9).alias("r"),
                                   F.lit(-tonic).alias("t"), F.lit(mode).alias("mode")))
    best = F.array_max(F.array(*scores))
    return histogram.select(*BAR, best.alias("b")).select(
        *BAR, (-F.col("b.t")).alias("tonic_pc"), "b.mode", F.col("b.r").alias("correlation"))


# --- corpora of numerals --------------------------------------------------

# Chord qualities of the corpus texts.
TRIAD_QUALITIES = ("maj", "min", "dim")
SEVENTH_QUALITIES = ("maj7", "min7", "hdim", "fdim", "dom7")
SIXTH_PREFIXES = {"Ger6": "ger", "ger6": "ger", "Fr6": "fre", "fr6": "fre", "It6": "ita", "it6": "ita"}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def roman_name(root: Column, quality: Column, inversion: Column, tonic: Column, mode: Column) -> Column:
    """The numeral of a chord in a key, or null."""
    steps = F.pmod(letter_step(root) - letter_step(tonic), F.lit(7))
    semis = F.pmod(letter_pc(F.substring(root, 1, 1)) + accidental_shift(root)
                   - letter_pc(F.substring(tonic, 1, 1)) - accidental_shift(tonic), F.lit(12))
    place = F.concat_ws(",", mode, steps.cast("string"), semis.cast("string"))
    table = {f"{m},{hm.INTERVALS[i][0]},{hm.INTERVALS[i][1]}": n for m, row in hm.ROOT_NUMERALS.items() for i, n in row.items()}
    numeral = _lookup(table, place)
    seventh = quality.isin(*SEVENTH_QUALITIES)
    figure = F.coalesce(
        F.when(quality.isin(*TRIAD_QUALITIES), _lookup({i: f for f, i in hm.TRIAD_FIGURES.items()}, inversion)),
        F.when(seventh, _lookup({i: f for f, i in hm.SEVENTH_FIGURES.items()}, inversion)), F.lit(""))
    prefix = F.when((numeral == "VII") & quality.isin("hdim", "fdim"), "dim").otherwise("")
    raised = (numeral.isin("I", "IV") & (quality == "maj")) | ((numeral == "V") & quality.isin("maj", "dom7"))
    suffix = F.when((mode == "Minor") & raised, "+").otherwise("")
    shown = F.when((numeral == "I") & (figure == "64"), "V").otherwise(numeral)
    return F.when(root == "X", F.concat(_lookup(SIXTH_PREFIXES, quality), F.lit("VI"))).otherwise(
        F.concat(prefix, shown, suffix, figure))


def known_numeral(numeral: Column, mode: Column) -> Column:
    """The numeral if the mode's index lists it, else ``N/A``."""
    ok = F.lit(False)
    for m in hm.NUMERALS:
        ok = ok | ((mode == m) & numeral.isin(*hm.numeral_names(m)))
    return F.when(ok, numeral).otherwise("N/A")


def transition_ngrams(corpus: DataFrame, section: list[str], chunk: list[str], order: list[str], n: int = 2) -> DataFrame:
    """Sliding numeral windows per section as column ``gram``; short ones at the
    start are left out."""
    if n != 2:
        raise ValueError("only pairs cross chunk borders")
    linked = with_neighbours(corpus, section, chunk, order, ["numeral"], prev="__p")
    return linked.where(F.col("__p").isNotNull()).withColumn("from_numeral", F.col("__p.numeral")).withColumnRenamed(
        "numeral", "to_numeral").drop("__p")


def transition_training_set(grams: DataFrame) -> DataFrame:
    """Pairs of the home key labelled Yes and, reread in other keys, No; pairs
    with an unknown numeral are dropped. ``mode`` is the mode they are read
    in."""
    spark = grams.sparkSession
    read = _small(spark, [(m, a, t, om, b) for m in hm.NUMERALS for a, t, om, b in hm.rereadings(m)],
                  "mode string, numeral string, tonic string, other_mode string, other string")
    home = grams.select("from_numeral", "to_numeral", F.lit("Yes").alias("match"), "mode")
    a = read.select("mode", F.col("numeral").alias("from_numeral"), "tonic", "other_mode", F.col("other").alias("new_from"))
    b = read.select("mode", F.col("numeral").alias("to_numeral"), "tonic", "other_mode", F.col("other").alias("new_to"))
    away = (grams.select("from_numeral", "to_numeral", "mode").join(a, ["mode", "from_numeral"])
            .join(b, ["mode", "to_numeral", "tonic", "other_mode"])
            .select(F.col("new_from").alias("from_numeral"), F.col("new_to").alias("to_numeral"),
                    F.lit("No").alias("match"), F.col("other_mode").alias("mode")))
    both = home.unionByName(away).where((F.col("from_numeral") != "N/A") & (F.col("to_numeral") != "N/A"))
    return both.withColumn("trans", F.concat_ws("-", "from_numeral", "to_numeral"))


# --- evaluation -----------------------------------------------------------

VERDICTS = ("exact", "wrong_bass", "overly", "same_function", "wrong")


def chord_verdict(recognised: Column, gold: Column, pitches: Column) -> Column:
    """How a recognised chord compares with the right one; null when nothing
    was recognised."""
    shared = F.size(F.array_intersect(recognised, gold))
    size = F.size(F.array_distinct(recognised))
    def outside(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_except(pitches, c)))
    return (F.when(recognised.isNull(), None)
            .when((shared == size) & (F.get(recognised, 0) == F.get(gold, 0)), "exact")
            .when(shared == size, "wrong_bass")
            .when((F.size(recognised) - shared == 1) & (F.size(recognised) == 4), "overly")
            .when(outside(recognised) == outside(gold), "same_function").otherwise("wrong"))


def chord_eval(judged: DataFrame, file: str) -> DataFrame:
    """Counts per file and over all (``file`` null), with hard, medium and soft
    rates among the recognised and among all."""
    counts = judged.rollup(file).agg(
        F.count(F.lit(1)).alias("events"), F.count("verdict").alias("recognised"),
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS])
    hits = {"hard": F.col("exact"), "medium": F.col("exact") + F.col("overly") + F.col("same_function")}
    hits["soft"] = hits["medium"] + F.col("wrong_bass")
    rates = [F.when(F.col(d) > 0, h / F.col(d)).alias(f"{n}_of_{d}") for n, h in hits.items() for d in ("recognised", "events")]
    return counts.select("*", *rates)


def chord_eval_total(judged: DataFrame, file: str) -> DataFrame:
    """Totals over all files with percentages to two decimals."""
    t = chord_eval(judged, file).where(F.col(file).isNull())
    percent = [F.round(F.col(v) / F.col("recognised") * 100, 2).alias(f"{v}_percent") for v in VERDICTS]
    return t.select("events", "recognised", *VERDICTS,
                    F.round(F.col("recognised") / F.col("events") * 100, 2).alias("recognised_percent"), *percent)
