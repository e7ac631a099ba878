"""Ways through the chords of a piece: which chords lead on to its end, and the path that keys take.

Both are questions about paths as long as a piece, answered in a logarithmic number of joins. No task walks a piece.

*Dead ends.* A chord lives if it shares a key with a living chord of the next event that differs. What an event
passes on is a set of keys, so an event, a block of bars, and any run of blocks is a function from sets of
keys to sets of keys; it keeps unions, so its values on the single keys tell it all. Blocks are composed
pairwise, with twice the reach in each round.

*Modulations.* A node is (entry, key, chord); within a key its best flow leads to one node of the next entry. The nodes of a bar are a row of
small numbers, read as arrays for many bars at once and folded backwards: each gets its run, which leads out of the bar or ends in it, with the sum
of the weights and its least partial sum. Only nodes at the first entry of a bar, the gates, are joined along jumps over 1, 2, 4 ... bars. A stretch in one key
goes on to the last node of its path, or to the first whose sum falls below the tolerance; its whole bars are found bit by bit from the jumps, the rest in the
row of its last bar, for all nodes at which a stretch may begin. Stretches lead to stretches, and doubling these links marks those that the first one reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import harmony as hm
from scorelake.functions.ordered import with_neighbours, with_row_number, with_running_max
from scorelake.operators import tonal as tn
from scorelake.session import cut_lineage, small_batches
from scorelake.sources.views import BAR

PIECE = ["piece_id"]
#: Measures of a block whose events are folded as one array.
BLOCK_BARS = 4


@lru_cache
def key_list() -> list[str]:
    return sorted({f"{tonic},{mode}" for tonic, mode, *_ in hm.chord_dictionary()})


@lru_cache
def chord_list() -> list[str]:
    return sorted({chord for chord, _ in hm.chord_sets()})


@lru_cache
def key_sets() -> dict[str, int]:
    """Chord -> the keys that list it in root position, as bits."""
    out = dict.fromkeys(chord_list(), 0)
    for tonic, mode, _, root, tones in hm.chord_dictionary():
        if root:
            out[hm.set_key(tones)] |= 1 << key_list().index(f"{tonic},{mode}")
    return out


# --- dead ends --------------------------------------------------------------


def _through(masks: Column, asked: Column) -> Column:
    """The keys of the chords that share one with those asked for."""
    return F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: F.when(m.bitwiseAND(asked) != 0, s.bitwiseOR(m)).otherwise(s))


def _later(blocks: DataFrame) -> DataFrame:
    """``blocks`` (piece_id, at: dense, keys: what the block makes of each single key asked for at its end)
    with ``asked``: the keys asked for at the end of each block by all after it."""
    n = len(key_list())
    after = lambda first, then: F.transform(then, lambda asked: F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"),
        lambda s, b: F.when(F.getbit(asked, b) == 1, s.bitwiseOR(F.get(first, b))).otherwise(s)))
    most = blocks.agg(F.max("at")).first()[0] or 0
    run, reach = blocks.select(*PIECE, "at", "keys"), 1
    while reach <= most:
        ahead = run.select(*PIECE, (F.col("at") - reach).alias("at"), F.col("keys").alias("far"))
        run = cut_lineage(run.join(ahead, [*PIECE, "at"], "left").select(
            *PIECE, "at", F.when(F.col("far").isNull(), F.col("keys")).otherwise(after(F.col("keys"), F.col("far"))).alias("keys")))
        reach *= 2
    whole = F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    asked = run.select(*PIECE, (F.col("at") - 1).alias("at"), whole.alias("asked"))
    return blocks.join(asked, [*PIECE, "at"], "left").withColumn("asked", F.coalesce("asked", F.lit((1 << n) - 1)))


def prune_dead_ends(matched: DataFrame) -> DataFrame:
    """``matched`` without chords that lead nowhere. Events of the same chords in a row count as one and keep the
    same. The last event but one is spared, and so is the first that differs from the one after it, as nothing
    before it asks for its pruning. The last event keeps all its chords."""
    total = matched.groupBy("piece_id").agg(F.max("global_idx").alias("__last"))
    seen = matched.join(total, "piece_id").where((F.size("matched") > 0) & (F.col("global_idx") != F.col("__last") - 1))
    linked = with_neighbours(seen.select(*tn.EVENT, "matched"), PIECE, ["measure_idx"], ["event_tick"], ["matched"], next="__n")
    linked = cut_lineage(linked.withColumn("turns", F.coalesce(F.col("__n.matched") != F.col("matched"), F.lit(True))))
    sets = F.create_map(*[F.lit(x) for pair in key_sets().items() for x in pair])
    turns = linked.where("turns").select(*tn.EVENT, F.col("__n").isNull().alias("last"), F.floor(F.col("measure_idx") / BLOCK_BARS).alias("block"),
                                         "matched", F.transform("matched", lambda c: F.coalesce(F.element_at(sets, c), F.lit(0)).cast("long")).alias("masks"))
    told = F.struct("measure_idx", "event_tick", "masks", "matched", "last")
    blocks = turns.groupBy(*PIECE, "block").agg(F.sort_array(F.collect_list(told), asc=False).alias("turns"))
    one = lambda b: F.aggregate("turns", b, lambda k, e: _through(e.masks, k))
    singles = F.array(*[F.lit(1 << b).cast("long") for b in range(len(key_list()))])
    blocks = cut_lineage(blocks.withColumn("keys", F.transform(singles, one)).withColumn(
        "at", (F.row_number().over(Window.partitionBy(*PIECE).orderBy("block")) - 1).cast("long")))
    # Backwards through the block, the keys asked of each event.
    walked = F.aggregate("turns", F.struct(F.col("asked").alias("k"), F.array().cast("array<bigint>").alias("out")), lambda s, e: F.struct(
        _through(e.masks, s.k).alias("k"), F.concat(s.out, F.array(s.k)).alias("out")), lambda s: s.out)
    zipped = _later(blocks).withColumn("walked", walked).select(*PIECE, F.explode(F.arrays_zip("turns", "walked")).alias("z")).select(
        *PIECE, "z.turns.*", F.col("z.walked").alias("asked"))
    alive = F.filter(F.transform("matched", lambda c, i: F.when(F.col("last") | (F.get("masks", i).bitwiseAND(F.col("asked")) != 0), c)), lambda c: c.isNotNull())
    lives = cut_lineage(zipped.select(*tn.EVENT, alive.alias("lives")))
    # Events that do not turn go with the next that does: a running maximum from the end.
    back = linked.select(*tn.EVENT, "turns", (-F.col("measure_idx")).alias("__m"), (-F.col("event_tick")).alias("__t"))
    mark = F.when(F.col("turns"), F.struct(F.col("__m").alias("m"), F.col("__t").alias("t")))
    back = with_running_max(back, PIECE, ["__m"], ["__t"], {"__to": mark}).select(
        *tn.EVENT, (-F.col("__to.m")).cast("int").alias("__to_m"), (-F.col("__to.t")).alias("__to_t"))
    first = linked.where("turns").groupBy("piece_id").agg(F.min(F.struct("measure_idx", "event_tick")).alias("__first"))
    kept = back.join(lives.select("piece_id", F.col("measure_idx").alias("__to_m"), F.col("event_tick").alias("__to_t"), "lives"), ["piece_id", "__to_m", "__to_t"])
    out = matched.join(kept.drop("__to_m", "__to_t"), tn.EVENT, "left").join(first, "piece_id", "left")
    free = F.col("lives").isNull() | F.coalesce(F.struct("measure_idx", "event_tick") == F.col("__first"), F.lit(False))
    return out.withColumn("matched", F.when(free, F.col("matched")).otherwise(F.col("lives"))).drop("lives", "__first")


# --- modulations ------------------------------------------------------------

#: A node in one number: entry, key, chord.
KEY_BITS, CHORD_BITS = 6, 10
ENTRY = KEY_BITS + CHORD_BITS
#: The way of a chord in a key is in the last bits of a node as bars hold it: key, chord, way.
WAY_BITS = 6


def _entry(node: str) -> Column:
    return F.shiftright(node, ENTRY)


def _chord(node: str) -> Column:
    return F.col(node).bitwiseAND((1 << CHORD_BITS) - 1)


def _key(node: Column) -> Column:
    return F.shiftright(node, CHORD_BITS).bitwiseAND((1 << KEY_BITS) - 1)


@dataclass(frozen=True)
class Ways:
    """The steps of the flow as arrays: the pair of chord and key has a number in ``pair`` (or -1), and its ways, the best first, lead ``to`` chords
    (``len(chord_list())`` fills up) with ``weight``. ``numerals`` names the steps by (key, chord, next chord)."""
    pair: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    numerals: list[tuple]


def flow_table(flow: DataFrame) -> Ways:
    """It has the size of the dictionary."""
    chord, key = {c: k for k, c in enumerate(chord_list())}, {c: k for k, c in enumerate(key_list())}
    pair, ways, numerals = np.full((len(chord), 1 << KEY_BITS), -1, np.int32), [], []
    for r in tn.flow_ways(flow)[0].collect():
        name = f"{r.tonic},{r.mode}"
        if r.from_chord not in chord or name not in key:
            continue
        best = {}
        for w in r.ways:
            if w.to_chord in chord:
                best.setdefault(w.to_chord, w)
        pair[chord[r.from_chord], key[name]] = len(ways)
        ways.append([(chord[c], float(w.weight)) for c, w in best.items()])
        numerals += [(name, r.from_chord, c, w.from_numeral, w.to_numeral) for c, w in best.items()]
    most = max([1, *map(len, ways)])
    if most > 1 << WAY_BITS:
        raise ValueError("too many steps of one chord")
    to = np.array([[c for c, _ in w] + [len(chord)] * (most - len(w)) for w in ways], np.int16).reshape(-1, most)
    weight = np.array([[x for _, x in w] + [0.0] * (most - len(w)) for w in ways]).reshape(-1, most)
    return Ways(pair, to, weight, numerals)


@dataclass(frozen=True)
class Nodes:
    """The nodes of a corpus: ``bars`` has a row for each bar, ``rows`` one for each node, worked out when asked for."""
    bars: DataFrame
    ways: Ways
    rows: DataFrame

    def __getattr__(self, name: str):
        return getattr(self.rows, name)


def _listed(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the size of each (0 for null)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """The places inside of each list."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chords as numbers; those that the dictionary lacks are -1, and named in ``rest``."""
    known = pa.array(chord_list())
    for b in batches:
        column = b.column("matched")
        values = column.flatten()
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pc.fill_null(pc.index_in(values, known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        odd = codes < 0
        rest_sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[odd], minlength=len(sizes))
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest_sizes)]).astype(np.int32)), values.filter(pa.array(odd)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in tn.EVENT), _listed(codes, sizes, pa.int32()), rest], [*tn.EVENT, "codes", "rest"])


def _best_ways(codes: np.ndarray, event: np.ndarray, then: np.ndarray, then_event: np.ndarray, events: int, ways: Ways) -> tuple[np.ndarray, np.ndarray]:
    """(event, node) for each chord of the events and each key with a way to a chord of the event after: the first of its ways that this has."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
    many = len(ways.pair)
    step = 1 << 11
    for a in range(0, events, step):
        present = np.zeros((step, many + 1), bool)
        x, y = np.searchsorted(then_event, [a, a + step])
        present[then_event[x:y] - a, np.where(then[x:y] < 0, many, then[x:y])] = True
        present[:, many] = False
        x, y = np.searchsorted(event, [a, a + step])
        own, at = codes[x:y], event[x:y] - a
        own, at = own[own >= 0], at[own >= 0]
        pairs = ways.pair[own]
        row, key = np.nonzero(pairs >= 0)
        pairs = pairs[row, key]
        hits = present[at[row][:, None], ways.to[pairs]]
        first = hits.argmax(axis=1)
        good = hits[np.arange(len(first)), first]
        row, key, first = row[good], key[good], first[good]
        node = (key << (CHORD_BITS + WAY_BITS) | own[row] << WAY_BITS | first).astype(np.int32)
        order = np.lexsort((node, at[row]))
        out.append((at[row][order] + a, node[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@dataclass
class _Read:
    """The nodes of a batch of bars in order of bar, entry (``off`` from the first of the bar), key and chord. ``into`` is the place of the
    node a step leads to in the same bar, or -1; the run of a node leads to (``run_off``, ``run_id``) with ``total`` and ``low``."""
    bar: np.ndarray
    off: np.ndarray
    id: np.ndarray
    next: np.ndarray
    weight: np.ndarray
    into: np.ndarray
    comp: np.ndarray

    def find(self, bar: np.ndarray, off: np.ndarray, ident: np.ndarray) -> np.ndarray:
        comp = (bar.astype(np.int64) << 20 | off) << ENTRY | ident
        if not len(self.comp):
            return np.full(len(comp), -1)
        at = np.minimum(np.searchsorted(self.comp, comp), len(self.comp) - 1)
        return np.where(self.comp[at] == comp, at, -1)

    def runs(self) -> None:
        self.run_off, self.run_id = self.off + 1, self.next.copy()
        self.total, self.low = self.weight + 0.0, self.weight.copy()
        order = np.argsort(self.off, kind="stable")
        ends = np.searchsorted(self.off[order], np.arange(int(self.off.max(initial=-1)) + 2))
        for k in range(len(ends) - 2, -1, -1):  # backwards: what follows in the bar is known
            some = order[ends[k]:ends[k + 1]]
            some = some[self.into[some] >= 0]
            d = self.into[some]
            self.run_off[some], self.run_id[some] = self.run_off[d], self.run_id[d]
            self.low[some] = np.minimum(self.weight[some], self.weight[some] + self.low[d])
            self.total[some] = self.weight[some] + self.total[d]


def _read(batch: pa.RecordBatch, ways: Ways) -> _Read:
    column = batch.column("nodes")
    entries = column.flatten()
    node, sizes = _flat(entries)
    per_bar = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bar = np.repeat(np.repeat(np.arange(len(per_bar)), per_bar), sizes)
    off = np.repeat(_within(per_bar), sizes)
    node = node.astype(np.int64)
    ident, way = node >> WAY_BITS, node & (1 << WAY_BITS) - 1
    key, chord = ident >> CHORD_BITS, ident & (1 << CHORD_BITS) - 1
    pair = ways.pair[chord, key]
    after, weight = key << CHORD_BITS | ways.to[pair, way].astype(np.int64), ways.weight[pair, way]
    out = _Read(bar, off, ident, after, weight, np.zeros(0, np.int64), (bar << 20 | off) << ENTRY | ident)
    out.into = np.where(off + 1 < per_bar[bar], out.find(bar, off + 1, after), -1)
    return out


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _spread(batch: pa.RecordBatch, rows: np.ndarray, names: list[str]) -> list[pa.Array]:
    return [batch.column(n).take(pa.array(rows)) for n in names]


def flow_entries(matched: DataFrame, flow: DataFrame) -> tuple[DataFrame, Nodes]:
    """(entries, nodes). Entries: the matched events of each piece that have a successor and don't merely repeat their one
    chord, numbered by ``i``. Nodes: for each chord of an entry and each key the best flow to the next
    event, ``at`` being its number and ``to`` that of the node it leads to. They are held by bar, as numbers of key, chord and way."""
    ways = flow_table(flow)
    spark = matched.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in matched.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in tn.EVENT)
    with small_batches(spark):
        live = cut_lineage(matched.where(F.size("matched") > 0).select(*tn.EVENT, "matched").mapInArrow(_coded, f"{schema}, codes array<int>, rest array<string>"))
        pairs = with_neighbours(live, PIECE, ["measure_idx"], ["event_tick"], ["codes", "rest"], next="__n").where(F.col("__n").isNotNull())
        told = pairs.where((F.col("__n.codes") != F.col("codes")) | (F.col("__n.rest") != F.col("rest")) | (F.size("codes") != 1))
        numbered = with_row_number(told.select(*tn.EVENT, "codes", F.col("__n.codes").alias("then")), PIECE, ["measure_idx"], ["event_tick"], "i")
        events = numbered.groupBy(*BAR).agg(F.min("i").alias("first"), F.max("i").alias("last"),
                                            F.array_sort(F.collect_list(F.struct("i", "event_tick", "codes", "then"))).alias("events"))

        def run(batches):
            for b in batches:
                column = b.column("events")
                per_bar = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
                each = column.flatten()
                (codes, sizes), (then, then_sizes) = (_flat(pc.struct_field(each, n)) for n in ("codes", "then"))
                at, node = _best_ways(codes, np.repeat(np.arange(len(sizes)), sizes), then, np.repeat(np.arange(len(sizes)), then_sizes), len(sizes), ways)
                held = np.bincount(at, minlength=len(sizes))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_bar)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c) for c in (*BAR, "first", "last")), pa.ListArray.from_arrays(offsets, pc.struct_field(each, "event_tick")),
                    pa.ListArray.from_arrays(offsets, _listed(node, held, pa.int32()))], [*BAR, "first", "last", "ticks", "nodes"])
        bar_schema = ", ".join(f"{c} {kinds[c]}" for c in BAR)
        bars = cut_lineage(events.mapInArrow(run, f"{bar_schema}, first long, last long, ticks array<long>, nodes array<array<int>>"))
    entries = bars.select(*BAR, "first", F.posexplode("ticks").alias("pos", "event_tick")).select(*tn.EVENT, (F.col("first") + F.col("pos")).alias("i"))

    def rows(batches):
        for b in batches:
            r = _read(b, ways)
            first = _numbers(b, "first")[r.bar]
            tick = b.column("ticks").flatten().take(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("ticks")).to_numpy(zero_copy_only=False))])[r.bar].astype(np.int64) + r.off))
            yield pa.RecordBatch.from_arrays([*_spread(b, r.bar, BAR), tick, pa.array(first + r.off), pa.array((first + r.off) << ENTRY | r.id),
                                              pa.array((first + r.off + 1) << ENTRY | r.next), pa.array(r.weight)], [*tn.EVENT, "i", "at", "to", "weight"])
    each = bars.mapInArrow(rows, f"{schema}, i long, at long, to long, weight double")
    each = each.select(*tn.EVENT, "i", _name(key_list(), _key(F.col("at"))).alias("key"), _name(chord_list(), _chord("at")).alias("from_chord"),
                       _name(chord_list(), _chord("to")).alias("to_chord"), "weight", "at", "to")
    return entries, Nodes(bars, ways, each.join(_numerals(bars, ways), ["key", "from_chord", "to_chord"]))


def _name(names: list[str], no: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), no.cast("int"))


def _numerals(df: DataFrame, ways: Ways) -> DataFrame:
    """At most a row for each step of the flow."""
    return F.broadcast(df.sparkSession.createDataFrame(ways.numerals, "key string, from_chord string, to_chord string, from_numeral string, to_numeral string"))


def _gates(bars: DataFrame, ways: Ways) -> DataFrame:
    """The nodes at the first entry of each bar with their runs."""
    def run(batches):
        for b in batches:
            r = _read(b, ways)
            r.runs()
            some = np.flatnonzero(r.off == 0)
            first = _numbers(b, "first")[r.bar[some]]
            yield pa.RecordBatch.from_arrays([*_spread(b, r.bar[some], PIECE), pa.array(first << ENTRY | r.id[some]), pa.array((first + r.run_off[some]) << ENTRY | r.run_id[some]),
                                              pa.array(r.total[some]), pa.array(r.low[some])], [*PIECE, "at", "to", "sum", "low"])
    return bars.mapInArrow(run, f"{_piece(bars)}, at long, to long, sum double, low double")


def _piece(df: DataFrame) -> str:
    return f"piece_id {df.schema['piece_id'].dataType.simpleString()}"


def _jumps(gates: DataFrame) -> list[DataFrame]:
    """Jumps over 1, 2, 4 ... bars: (at, to, sum, low), from the nodes at the first entry of a bar. ``low`` is the least
    sum on the way. As long as there are any."""
    jump = cut_lineage(gates.select(*PIECE, "at", "to", "sum", "low"))
    out = []
    while not jump.isEmpty():
        out.append(jump)
        far = jump.select(*PIECE, F.col("at").alias("to"), F.col("to").alias("to2"), F.col("sum").alias("sum2"), F.col("low").alias("low2"))
        jump = cut_lineage(jump.join(far, [*PIECE, "to"]).select(
            *PIECE, "at", F.col("to2").alias("to"), (F.col("sum") + F.col("sum2")).alias("sum"), F.least("low", F.col("sum") + F.col("low2")).alias("low")))
    return out


def _looked_up(rows: DataFrame, table: DataFrame, at: str, when: Column | None = None) -> DataFrame:
    """``rows`` with the jump from their node ``at``: ``j_to``, ``j_sum``, ``j_low``; null without one, or where ``when`` fails."""
    there = table.select(*PIECE, F.col("at").alias("j_at"), F.col("to").alias("j_to"), F.col("sum").alias("j_sum"), F.col("low").alias("j_low"))
    asked = F.col(at) if when is None else F.when(when, F.col(at))
    return rows.withColumn("j_at", asked).join(there, [*PIECE, "j_at"], "left").drop("j_at")


def _rates(b: pa.RecordBatch, bar: np.ndarray, to: np.ndarray, total: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For nodes whose run lasts to the end of their bar: how many of ``budget`` more measures their path lasts, and its sum over these. The
    columns ``n_`` are the rates of the first nodes of the next bar for all lower budgets."""
    gap = pc.fill_null(pc.subtract(b.column("n_measure"), b.column("measure_idx")), budget + 1).to_numpy(zero_copy_only=False).astype(np.int64)[bar]
    ids, sizes = _flat(b.column("n_at"))
    there = np.repeat(np.arange(len(sizes)), sizes) << ENTRY | ids.astype(np.int64)
    at = np.minimum(np.searchsorted(there, bar << ENTRY | to), max(len(there) - 1, 0))
    meets = there[at] == (bar << ENTRY | to) if len(there) else np.zeros(len(to), bool)
    lasts, out = np.where(gap > budget, budget, gap - 1), total.copy()
    for g in range(1, budget + 1):
        some = np.flatnonzero(meets & (gap == g))
        lasts[some] = g + _flat(b.column(f"n_l{budget - g}"))[0][at[some]]
        out[some] = total[some] + _flat(b.column(f"n_t{budget - g}"))[0][at[some]]
    return lasts, out


def _with_next(rows: DataFrame, doors: DataFrame, bars: DataFrame, budget: int) -> DataFrame:
    """``rows`` of bars with the measure of the next bar and the rates of its first nodes."""
    held = ["at", *[f"{x}{k}" for k in range(budget) for x in "lt"]]
    there = doors.select(*PIECE, (F.col("first") - 1).alias("last"), *[F.col(c).alias(f"n_{c}") for c in held])
    after = bars.select(*PIECE, (F.col("first") - 1).alias("last"), F.col("measure_idx").alias("n_measure"))
    return rows.join(after.join(there, [*PIECE, "last"], "left"), [*PIECE, "last"], "left")


def _ahead(bars: DataFrame, ways: Ways, reach: int) -> DataFrame:
    """For each chord of an entry the node that begins a search best: whose path lasts to the end of its measure and longest, up to ``reach`` measures, and
    weighs most over these. With its run, and whether it is the best of its entry (``top``)."""
    def start(batches):
        for b in batches:
            r = _read(b, ways)
            r.runs()
            length = (_numbers(b, "last") - _numbers(b, "first"))[r.bar]
            some = np.flatnonzero((r.off == 0) & (r.run_off > length))
            sizes = np.bincount(r.bar[some], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([
                *(b.column(c) for c in (*BAR, "first", "last")), _listed(r.id[some], sizes, pa.int32()), _listed(r.run_id[some], sizes, pa.int32()),
                _listed(r.total[some], sizes, pa.float64()), _listed(np.zeros(len(some), np.int32), sizes, pa.int32()), _listed(r.total[some], sizes, pa.float64())],
                [*BAR, "first", "last", "at", "to", "sum", "l0", "t0"])
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = f"{', '.join(f'{c} {kinds[c]}' for c in BAR)}, first long, last long, at array<int>, to array<int>, sum array<double>, l0 array<int>, t0 array<double>"
    doors = cut_lineage(bars.mapInArrow(start, schema))
    for budget in range(1, reach - 1):
        def more(batches, budget=budget, names=tuple(doors.columns)):
            for b in batches:
                to, sizes = _flat(b.column("to"))
                lasts, total = _rates(b, np.repeat(np.arange(b.num_rows), sizes), to.astype(np.int64), _flat(b.column("sum"))[0], budget)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), _listed(lasts, sizes, pa.int32()), _listed(total, sizes, pa.float64())],
                                                 [*names, f"l{budget}", f"t{budget}"])
        schema += f", l{budget} array<int>, t{budget} array<double>"
        doors = cut_lineage(_with_next(doors, doors, bars, budget).mapInArrow(more, schema))

    def best(batches):
        for b in batches:
            r = _read(b, ways)
            r.runs()
            length = (_numbers(b, "last") - _numbers(b, "first"))[r.bar]
            some = np.flatnonzero(r.run_off > length)
            bar, off, ident = r.bar[some], r.off[some], r.id[some]
            lasts, total = _rates(b, bar, r.run_id[some], r.total[some], reach - 1) if reach > 1 else (np.zeros(len(some), np.int64), r.total[some])
            key, chord = ident >> CHORD_BITS, ident & (1 << CHORD_BITS) - 1
            order = np.lexsort((-key, total, lasts, chord, off, bar))
            last = lambda *of: np.append(np.any([c[1:] != c[:-1] for c in of], axis=0), True) if len(of[0]) else np.zeros(0, bool)
            order = order[last(bar[order], off[order], chord[order])]
            order = order[np.lexsort((-key[order], -chord[order], total[order], lasts[order], off[order], bar[order]))]
            top, some = last(bar[order], off[order]), some[order]
            first = _numbers(b, "first")[r.bar[some]]
            yield pa.RecordBatch.from_arrays([
                *_spread(b, r.bar[some], PIECE), pa.array((first + r.off[some]) << ENTRY | r.id[some]), pa.array(first), pa.array((first + r.run_off[some]) << ENTRY | r.run_id[some]),
                pa.array(r.total[some]), pa.array(r.low[some]), pa.array(top)], [*PIECE, "at", "first", "to", "sum", "low", "top"])
    rows = _with_next(bars.select(*BAR, "first", "last", "nodes"), doors, bars, reach - 1)
    return rows.mapInArrow(best, f"{_piece(bars)}, at long, first long, to long, sum double, low double, top boolean")


def _in_bars(rows: DataFrame, bars: DataFrame, ways: Ways, run: Callable, schema: str) -> DataFrame:
    """What ``run`` gives for batches of the bars that begin at the entries ``first`` of ``rows``, their nodes, the columns of the rows, and the bar of
    each row. A bar is sent once, with all its rows."""
    held = [c for c in rows.columns if c not in (*PIECE, "first")]
    groups = rows.groupBy(*PIECE, "first").agg(F.collect_list(F.struct(*held)).alias("rows"))
    joined = groups.join(bars.select(*PIECE, "first", "nodes"), [*PIECE, "first"], "left")

    def read(batches):
        for b in batches:
            each = b.column("rows").flatten()
            sizes = pc.list_value_length(b.column("rows")).to_numpy(zero_copy_only=False).astype(np.int64)
            bar = np.repeat(np.arange(b.num_rows), sizes)
            yield run(b, _read(b, ways), {c: pc.struct_field(each, c) for c in held}, bar)
    return joined.mapInArrow(read, schema)


def _stretches(starts: DataFrame, bars: DataFrame, ways: Ways, jumps: list[DataFrame], tolerance: float) -> DataFrame:
    """For each start its stretch: run out of its bar (if ``moved``: to ``gate``, weighing ``own``), ``n_bars`` whole bars more, then from node
    ``x`` of the bar at ``first``, with ``sum`` before it, to the node ``want`` that it wants next."""
    moved = F.col("low") >= tolerance
    rows = starts.select(*PIECE, "at", F.col("first").alias("begin"), moved.alias("moved"), F.col("to").alias("gate"), F.col("sum").alias("own"),
                         F.when(moved, F.col("to")).otherwise(F.col("at")).alias("x"), F.when(moved, F.col("sum")).otherwise(0.0).alias("sum"), F.lit(0).cast("long").alias("n_bars"))
    for k, jump in reversed(list(enumerate(jumps))):
        rows = _looked_up(rows, jump, "x", F.col("moved"))
        goes = F.coalesce(F.col("sum") + F.col("j_low") >= tolerance, F.lit(False))
        rows = rows.withColumns({"x": F.when(goes, F.col("j_to")).otherwise(F.col("x")), "n_bars": F.when(goes, F.col("n_bars") + (1 << k)).otherwise(F.col("n_bars")),
                                 "sum": F.when(goes, F.col("sum") + F.col("j_sum")).otherwise(F.col("sum"))}).drop("j_to", "j_sum", "j_low")
    rows = rows.withColumn("first", F.when(F.col("moved"), _entry("x")).otherwise(F.col("begin")))
    names = [c for c in rows.columns if c not in (*PIECE, "first")]

    def run(b: pa.RecordBatch, r: _Read, told: dict[str, pa.Array], bar: np.ndarray) -> pa.RecordBatch:
        first, x, total = _numbers(b, "first")[bar], told["x"].to_numpy(zero_copy_only=False), told["sum"].to_numpy(zero_copy_only=False).copy()
        at, want = r.find(bar, (x >> ENTRY) - first, x & (1 << ENTRY) - 1), x.copy()
        live = np.flatnonzero(at >= 0)
        while len(live):  # the node at which the sum falls below the tolerance still belongs to the stretch
            a = at[live]
            total[live] += r.weight[a]
            want[live] = (first[live] + r.off[a] + 1) << ENTRY | r.next[a]
            at[live] = np.where(total[live] < tolerance, -1, r.into[a])
            live = live[at[live] >= 0]
        return pa.RecordBatch.from_arrays([*_spread(b, bar, [*PIECE, "first"]), *(told[c] for c in names), pa.array(want)], [*PIECE, "first", *names, "want"])
    schema = f"{_piece(bars)}, first long, {', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in names)}, want long"
    return cut_lineage(_in_bars(rows, bars, ways, run, schema))


def _reached(links: DataFrame, first: DataFrame) -> DataFrame:
    """The nodes that ``first`` reaches over ``links`` (at -> next)."""
    seen, links = first.select(*PIECE, "at"), links.where(F.col("next").isNotNull())
    while not links.isEmpty():
        more = seen.join(links, [*PIECE, "at"]).select(*PIECE, F.col("next").alias("at"))
        seen = cut_lineage(seen.unionByName(more).distinct())
        far = links.select(*PIECE, F.col("at").alias("next"), F.col("next").alias("next2"))
        links = cut_lineage(links.join(far, [*PIECE, "next"]).select(*PIECE, "at", F.col("next2").alias("next")))
    return seen


def _walked(stretches: DataFrame, bars: DataFrame, ways: Ways, jumps: list[DataFrame]) -> DataFrame:
    """All nodes of the stretches with ``next`` and the sum after each: whole bars are halved along the jumps, each bar is walked by itself."""
    rows = stretches.where(F.col("moved") & (F.col("n_bars") > 0)).select(
        *PIECE, "want", F.col("gate").alias("at"), F.col("n_bars").alias("n"), F.col("own").alias("before"))
    for k, jump in reversed(list(enumerate(jumps))):
        long = F.col("n") > (1 << k)
        cut = _looked_up(rows, jump, "at", long)
        parts = F.when(long, F.array(F.struct("at", F.lit(1 << k).cast("long").alias("n"), "before"),
                                     F.struct(F.col("j_to").alias("at"), (F.col("n") - (1 << k)).alias("n"), (F.col("before") + F.col("j_sum")).alias("before"))))
        rows = cut.select(*PIECE, "want", F.explode(F.coalesce(parts, F.array(F.struct("at", F.col("n").cast("long").alias("n"), "before")))).alias("p")).select(
            *PIECE, "want", "p.*")
    runs = rows.select(*PIECE, "want", F.col("at").alias("x"), "before", _entry("at").alias("first"))
    runs = runs.unionByName(stretches.where("moved").select(*PIECE, "want", "x", F.col("sum").alias("before"), "first"))
    runs = runs.unionByName(stretches.select(*PIECE, "want", F.col("at").alias("x"), F.lit(0.0).alias("before"), F.col("begin").alias("first")))

    def run(b: pa.RecordBatch, r: _Read, told: dict[str, pa.Array], bar: np.ndarray) -> pa.RecordBatch:
        first, x, want, total = _numbers(b, "first")[bar], *(told[c].to_numpy(zero_copy_only=False) for c in ("x", "want", "before"))
        total, end = total.copy(), want >> ENTRY
        at = np.where(x >> ENTRY < end, r.find(bar, (x >> ENTRY) - first, x & (1 << ENTRY) - 1), -1)
        out = [(at[:0], at[:0], total[:0])]
        live = np.flatnonzero(at >= 0)
        while len(live):
            a = at[live]
            total[live] += r.weight[a]
            out.append((live, a, total[live]))
            at[live] = np.where(first[live] + r.off[a] + 1 < end[live], r.into[a], -1)
            live = live[at[live] >= 0]
        row, a, total = (np.concatenate(c) for c in zip(*out, strict=True))
        entry = first[row] + r.off[a]
        return pa.RecordBatch.from_arrays([*_spread(b, bar[row], PIECE), pa.array(entry << ENTRY | r.id[a]), pa.array((entry + 1) << ENTRY | r.next[a]), pa.array(total)],
                                          [*PIECE, "at", "next", "sum"])
    return _in_bars(runs, bars, ways, run, f"{_piece(bars)}, at long, next long, sum double")


def modulations(entries: DataFrame, nodes: Nodes, reach: int = 4, tolerance: float = -0.5) -> DataFrame:
    """The steps of each piece: measure_idx, event_tick, key, chords, numerals, and the weight since the last search.

    A piece begins at the chord and key whose path lasts longest, up to ``reach`` measures, and weighs most over these
    (first in name order on a tie). Where the key has no flow on, or the weight falls below the tolerance, the chord
    keeps its place and the best key for it is searched; if it has none, the search begins afresh at the next entry that gives one."""
    told = [*tn.EVENT, "key", "from_chord", "to_chord", "from_numeral", "to_numeral"]
    bars, ways = nodes.bars, nodes.ways
    if bars.where(F.exists("nodes", lambda x: F.size(x) > 0)).isEmpty():
        return nodes.rows.limit(0).select(*told, "weight")
    with small_batches(bars.sparkSession):
        kept = cut_lineage(_ahead(bars, ways, reach))  # the best of each chord
        afresh = kept.where("top").select(*PIECE, _entry("at").alias("i"), "at")
        # The next entry, itself included, at which a search gives something.
        marks = entries.join(afresh, [*PIECE, "i"], "left").select(*PIECE, "i", "at", (-F.col("measure_idx")).alias("__m"), (-F.col("i")).alias("__i"))
        marks = with_running_max(marks, PIECE, ["__m"], ["__i"], {"__next": F.when(F.col("at").isNotNull(), F.struct(F.col("__i").alias("n"), "at"))})
        fresh = cut_lineage(marks.select(*PIECE, (F.col("i") - 1).alias("i"), F.col("__next.at").alias("fresh")))
        jumps = _jumps(_gates(bars, ways))
        stretches = _stretches(kept, bars, ways, jumps, tolerance)
        links = (stretches.select(*PIECE, "at", _entry("want").alias("i"), _chord("want").alias("chord"))
                 .join(kept.select(*PIECE, _entry("at").alias("i"), _chord("at").alias("chord"), F.col("at").alias("again")), [*PIECE, "i", "chord"], "left")
                 .join(fresh, [*PIECE, "i"], "left").select(*PIECE, "at", F.coalesce("again", "fresh").alias("next")))
        found = _reached(cut_lineage(links), afresh.where("i = 0"))
        steps = cut_lineage(_walked(cut_lineage(stretches.join(found, [*PIECE, "at"])), bars, ways, jumps))
    steps = steps.select(*PIECE, _entry("at").alias("i"), _name(key_list(), _key(F.col("at"))).alias("key"), _name(chord_list(), _chord("at")).alias("from_chord"),
                         _name(chord_list(), _chord("next")).alias("to_chord"), F.col("sum").alias("weight"))
    return steps.join(entries, [*PIECE, "i"]).join(_numerals(bars, ways), ["key", "from_chord", "to_chord"]).select(*told, "weight")
