"""Motif discovery: four-note groups, their encodings, similarity and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import (with_lookahead, with_neighbours, with_row_number,
                                         with_running_max, with_running_sum)
from scorelake.operators.graph import flatten_contractions
from scorelake.session import cut_lineage, spread
from scorelake.sources.views import VOICE

SIZE = 4
CHUNK = ["measure_idx"]


# --- grams ----------------------------------------------------------------


def motif_items(notes: DataFrame) -> DataFrame:
    """Notes and rests of each voice in order; a chord counts as its bass note.
    ``pos`` is the position in the voice."""
    bass = F.struct("name", "pc", "ps", "dur_ql", "tie", "event_id")
    items = notes.groupBy(*VOICE, "measure_idx", "onset_tick", "is_rest").agg(
        F.min_by(bass, F.struct("ps", "event_id")).alias("b"), F.min("onset_ql").alias("onset_ql"))
    flat = items.select(*VOICE, "measure_idx", "onset_tick", "onset_ql", "is_rest",
                        (~F.col("is_rest")).alias("sounding"), "b.*")
    return with_row_number(flat, VOICE, CHUNK, ["onset_tick", "sounding"], "pos").drop("sounding")


def notegrams(items: DataFrame) -> DataFrame:
    """Sliding windows of four items without a rest or a near-empty length that
    do not start inside a tie. Column ``raw`` holds the items."""
    ahead = with_lookahead(items, VOICE, "pos", ["name", "pc", "ps", "dur_ql", "tie", "is_rest"], SIZE, "raw")
    bad = F.exists("raw", lambda n: n["is_rest"] | (n["dur_ql"] < 1e-2))
    starts = F.coalesce(~F.col("tie").isin("continue", "stop"), F.lit(True))
    return ahead.where((F.size("raw") == SIZE) & ~bad & starts).select(*VOICE, *CHUNK, "pos", "raw")


# Chords, as semitones over the root, that make a group of equal
# lengths uninteresting: triads, sevenths and augmented sixths.
CHORD_SHAPES = [
    (0, 4, 7), (0, 3, 7), (0, 3, 6), (0, 4, 8),
    (0, 4, 7, 10), (0, 4, 7, 11), (0, 3, 7, 10), (0, 3, 7, 11), (0, 3, 6, 10), (0, 3, 6, 9), (0, 4, 8, 11),
    (0, 4, 10), (0, 4, 6, 10),
]


def _chord_masks() -> list[int]:
    return sorted({sum(1 << (p + r) % 12 for p in shape) for shape in CHORD_SHAPES for r in range(12)})


def is_chordal(raw: Column) -> Column:
    """Equal lengths, and the names form one of the chords."""
    lengths = F.array_distinct(F.transform(raw, lambda n: n["dur_ql"]))
    pcs = F.array_distinct(F.transform(raw, lambda n: n["pc"]))
    mask = F.aggregate(pcs, F.lit(0), lambda a, p: a + F.pow(F.lit(2), p).cast("int"))
    return (F.size(lengths) == 1) & (F.size(pcs) >= 3) & mask.isin(*_chord_masks())


def drop_chordal_grams(grams: DataFrame) -> DataFrame:
    """Drop chordal groups and every later group that shares a note with a
    dropped one.

    Groups whose starts are at most three apart share notes, so they form
    islands, and a group goes once its island has had a chordal one. Both
    positions are running maxima."""
    marked = grams.withColumn("__chordal", is_chordal(F.col("raw")))
    linked = with_neighbours(marked, VOICE, CHUNK, ["pos"], ["pos"], prev="__p")
    fresh = F.col("__p").isNull() | (F.col("pos") - F.col("__p.pos") >= SIZE)
    run = with_running_max(linked, VOICE, CHUNK, ["pos"], {
        "__island": F.when(fresh, F.col("pos")), "__hit": F.when(F.col("__chordal"), F.col("pos"))})
    gone = F.coalesce(F.col("__hit") >= F.col("__island"), F.lit(False))
    return run.where(~gone).drop("__chordal", "__p", "__island", "__hit")


def tied_runs(items: DataFrame) -> DataFrame:
    """Items with tied successors of equal pitch merged; ``run_pos`` is the
    position among the merged ones, ``n_raw`` how many items each holds."""
    linked = with_neighbours(items, VOICE, CHUNK, ["pos"], ["tie", "ps"], prev="__p")
    joins = (F.col("__p.tie").isin("start", "continue") & F.col("tie").isin("continue", "stop")
             & (F.col("__p.ps") == F.col("ps")))
    fresh = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    runs = with_running_sum(linked, VOICE, CHUNK, ["pos"], fresh, "run_pos")
    merged = runs.groupBy(*VOICE, (F.col("run_pos") - 1).alias("run_pos")).agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_raw"), F.min_by("name", "pos").alias("name"),
        F.min_by("ps", "pos").alias("ps"), F.sum("dur_ql").alias("dur_ql"), F.min_by("is_rest", "pos").alias("is_rest"),
        F.min("onset_ql").alias("first_ql"), F.max("onset_ql").alias("last_ql"))
    return merged


NOTE = ["name", "ps", "dur_ql", "is_rest"]


def extend_ties(grams: DataFrame, items: DataFrame) -> DataFrame:
    """Groups as merged notes. A tie inside a group makes it one item longer,
    so a group always reaches over four merged notes, or to the next rest.
    ``notes`` is normalised: a last note of about a quarter or more counts as a
    quarter."""
    ahead = with_lookahead(tied_runs(items), VOICE, "run_pos", [*NOTE, "n_raw", "first_ql", "last_ql"], SIZE, "runs")
    both = grams.select(*VOICE, *CHUNK, "pos").join(ahead.select(*VOICE, "pos", "runs"), [*VOICE, "pos"])
    rest_at = F.array_position(F.transform("runs", lambda r: r["is_rest"]), True)
    live = F.when(rest_at > 0, F.slice("runs", 1, rest_at.cast("int") - 1)).otherwise(F.col("runs"))
    both = both.withColumn("runs", live)
    return both.select(
        *VOICE, *CHUNK, "pos", F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n_raw"]).alias("n_raw"),
        F.get("runs", 0)["first_ql"].alias("first_ql"), F.element_at("runs", -1)["last_ql"].alias("last_ql"),
        normalise_last(F.transform("runs", lambda r: F.struct(*[r[f].alias(f) for f in NOTE]))).alias("notes"))


def normalise_last(notes: Column) -> Column:
    """The last note, if probably sustained, cut to a quarter."""
    n = F.size(notes)
    return F.transform(notes, lambda x, i: F.struct(
        x["name"].alias("name"), x["ps"].alias("ps"),
        F.when((i == n - 1) & (x["dur_ql"] >= 1.0 - 1e-2), 1.0).otherwise(x["dur_ql"]).alias("dur_ql"),
        x["is_rest"].alias("is_rest")))


# --- encoders -------------------------------------------------------------


def one_decimal(x: Column) -> Column:
    """One decimal, halves to even."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def _pairs(notes: Column, f) -> Column:
    """``f(previous, current)`` over neighbours; pairs of two rests give
    nothing, a change between rest and note gives RN or NR."""
    before = F.slice(notes, 1, F.greatest(F.size(notes) - 1, F.lit(0)))
    after = F.slice(notes, 2, F.greatest(F.size(notes) - 1, F.lit(0)))
    both = F.zip_with(before, after, lambda a, b: (
        F.when(a["is_rest"] & ~b["is_rest"], "RN").when(~a["is_rest"] & b["is_rest"], "NR")
        .when(~a["is_rest"] & ~b["is_rest"], f(a, b))))
    return F.filter(both, lambda x: x.isNotNull())


def note_names(notes: Column) -> Column:
    return F.transform(notes, lambda n: F.when(n["is_rest"], "R").otherwise(n["name"]))


def note_letters(notes: Column) -> Column:
    return F.transform(note_names(notes), lambda x: F.regexp_replace(x, "[^A-GR]", ""))


def rhythms(notes: Column) -> Column:
    return F.transform(notes, lambda n: one_decimal(n["dur_ql"]))


def _same(a: Column, b: Column) -> Column:
    return (a["is_rest"] == b["is_rest"]) & a["name"].eqNullSafe(b["name"]) & a["ps"].eqNullSafe(b["ps"]) & (a["dur_ql"] == b["dur_ql"])


def interval_vector(notes: Column, index: int) -> Column:
    """Semitones from the note at ``index``, which itself gives ``*``; empty if
    that is a rest."""
    ref = F.get(notes, index)
    out = F.transform(notes, lambda n: F.when(_same(n, ref), "*").when(n["is_rest"], "R").otherwise(
        (n["ps"] - ref["ps"]).cast("double").cast("string")))
    return F.when(ref.isNull() | ref["is_rest"], F.array().cast("array<string>")).otherwise(out)


def rhythm_vector(notes: Column, index: int) -> Column:
    ref = F.get(notes, index)
    out = F.transform(notes, lambda n: F.when(_same(n, ref), "*").otherwise(one_decimal(n["dur_ql"] / ref["dur_ql"])))
    return F.when(ref.isNull(), F.array().cast("array<string>")).otherwise(out)


def rhythm_reverse_vector(notes: Column) -> Column:
    """Lengths over that of the last note, from the end."""
    return rhythm_vector(F.reverse(notes), 0)


def letter_transitions(notes: Column) -> Column:
    return _pairs(notes, lambda a, b: (F.ascii(b["name"]) - F.ascii(a["name"])).cast("string"))


def contour(notes: Column) -> Column:
    return _pairs(notes, lambda a, b: F.when(a["ps"] == b["ps"], "=").when(a["ps"] < b["ps"], "<").otherwise(">"))


def semitone_transitions(notes: Column) -> Column:
    return _pairs(notes, lambda a, b: (b["ps"] - a["ps"]).cast("double").cast("string"))


def rhythm_transitions(notes: Column) -> Column:
    before = F.slice(notes, 1, F.greatest(F.size(notes) - 1, F.lit(0)))
    after = F.slice(notes, 2, F.greatest(F.size(notes) - 1, F.lit(0)))
    return F.zip_with(before, after, lambda a, b: one_decimal(b["dur_ql"] / a["dur_ql"]))


def gram_key(notes: Column) -> Column:
    return F.array_join(F.zip_with(note_names(notes), rhythms(notes), lambda n, r: F.concat_ws(",", n, r)), ";")


ENCODERS = {
    "note_names": note_names, "note_letters": note_letters, "rhythms": rhythms,
    "interval_vector": lambda n: interval_vector(n, 0), "rhythm_vector": lambda n: rhythm_vector(n, 0),
    "rhythm_reverse_vector": rhythm_reverse_vector, "letter_transitions": letter_transitions, "contour": contour,
    "semitone_transitions": semitone_transitions, "rhythm_transitions": rhythm_transitions,
}

# The encodings that make up the dissimilarity, with weights.
WEIGHTS = {"note_names": 1.0, "rhythms": 1.0, "contour": 1.0, "interval_vector": 0.5, "rhythm_vector": 0.5,
           "letter_transitions": 1.0, "rhythm_transitions": 1.0}


# --- groups and similarity ------------------------------------------------


def motif_grams(notes: DataFrame) -> DataFrame:
    """All steps from notes to keyed groups."""
    items = cut_lineage(motif_items(notes))
    return extend_ties(drop_chordal_grams(notegrams(items)), items).withColumn("gram_key", gram_key(F.col("notes")))


def group_grams(grams: DataFrame) -> DataFrame:
    """Groups of equal key per piece: size, first occurrence and its notes. The
    occurrences stay rows of ``grams``."""
    order = F.struct("part_idx", "voice", "pos")
    return grams.groupBy("piece_id", "gram_key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("notes", order).alias("notes"))


def encoded(groups: DataFrame) -> DataFrame:
    """Adds the encodings of the dissimilarity as columns."""
    return groups.select("*", *[ENCODERS[e](F.col("notes")).alias(e) for e in WEIGHTS])


def _numbered(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Symbol lists as rows of numbers, equal for equal symbols. Short rows are filled up with numbers of
    no symbol, other ones on either side."""
    names = {s: k for k, s in enumerate(sorted({s for col in (left, right) for x in col for s in x}))}

    def rows(col: pd.Series, fill: int) -> np.ndarray:
        width = max((len(x) for x in col), default=0)
        return np.array([[names[s] for s in x] + [fill] * (width - len(x)) for x in col], np.int32).reshape(len(col), width)
    return rows(left, -1), rows(right, -2)


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of rows that broadcast against each other."""
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    best = np.zeros((b.shape[-1] + 1, *shape), np.int32)
    for x in np.moveaxis(a, -1, 0):
        hit = best[:-1] + (x == np.moveaxis(b, -1, 0))
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], hit), axis=0)
    return best[-1]


def align_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(length - score) / length of the best global alignment: a match scores 1, all else 0, and of equal
    scores the longest alignment counts. So the matches are a longest common subsequence, and every other
    symbol stands alone."""
    sizes = (a >= 0).sum(axis=-1) + (b >= 0).sum(axis=-1)
    score = common_length(a, b)
    length = sizes - score
    return np.where(length > 0, (length - score) / np.maximum(length, 1), 0.0)


def dissimilarity(left: pd.DataFrame, right: pd.DataFrame, grid: bool) -> np.ndarray:
    """Smoothed harmonic mean of the weighted distances of all encodings, row by
    row or, with ``grid``, every left row against every right row. A grid aligns each pair of
    different sequences once, as groups share most of theirs."""
    total: np.ndarray | float = 0.0
    for name, weight in WEIGHTS.items():
        a, b = _numbered(left[name], right[name])
        if grid:
            (a, rows), (b, cols) = (np.unique(x, axis=0, return_inverse=True) for x in (a, b))
            a, b = a[:, None, :], b[None, :, :]
        terms = 1.0 / (align_distance(a, b) * weight + 0.1)
        total = total + (terms[np.ix_(rows.ravel(), cols.ravel())] if grid else terms)
    return np.asarray(1.0 / total)


def gram_dissimilarity(pairs: DataFrame) -> DataFrame:
    """Adds ``dissimilarity`` to rows that hold encodings ``a_*`` and ``b_*``, in
    Arrow batches."""
    names = list(WEIGHTS)

    @F.pandas_udf("double")
    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series(dissimilarity(a, b, grid=False))
    def side(p: str) -> Column:
        return F.struct(*[F.col(f"{p}_{n}").alias(n) for n in names])
    return pairs.withColumn("dissimilarity", score(side("a"), side("b")))


def distance_to_commonest(groups: DataFrame) -> DataFrame:
    """Dissimilarity of every group to the piece's most frequent one."""
    enc = encoded(groups)
    names = list(WEIGHTS)
    top = groups.groupBy("piece_id").agg(F.max_by("gram_key", F.struct("n", "gram_key")).alias("gram_key"))
    best = enc.join(top, ["piece_id", "gram_key"]).select(
        "piece_id", F.col("gram_key").alias("top_key"), *[F.col(n).alias(f"b_{n}") for n in names])
    pairs = enc.select("piece_id", "gram_key", *[F.col(n).alias(f"a_{n}") for n in names]).join(best, "piece_id")
    return gram_dissimilarity(pairs).select("piece_id", "gram_key", "top_key", "dissimilarity")


# --- clusters -------------------------------------------------------------

# Most groups whose full distance matrix one task may hold (about 70 MB).
TASK_GROUPS = 3000


def _merges(matrix: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges of complete linkage as (height, kept, absorbed), where a
    cluster goes by its smallest member and equal heights are ordered by the
    two names. Reciprocal nearest neighbours may merge in any order."""
    n = len(matrix)
    d = matrix.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    live = np.ones(n, dtype=bool)
    merges = []
    chain: list[int] = []

    def nearest(i: int) -> int:
        # The first of equal ones is also first by name: dead rows and the
        # diagonal are infinite.
        return int(np.argmin(d[i]))
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        i = chain[-1]
        j = nearest(i)
        if len(chain) > 1 and j == chain[-2]:
            a, b = min(i, j), max(i, j)
            merges.append((float(d[a, b]), a, b))
            both = np.maximum(d[a], d[b])
            d[a], d[:, a] = both, both
            d[a, a] = np.inf
            d[b], d[:, b] = np.inf, np.inf
            live[b] = False
            chain = chain[:-2]
        else:
            chain.append(j)
    return merges


def cut_tree(n: int, merges: list[tuple[float, int, int]], k: int) -> list[int]:
    """Cluster of each item (its smallest member) after the lowest ``n - k``
    merges."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i
    for _, a, b in sorted(merges)[:max(n - k, 0)]:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(n)]


def _cluster_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("gram_no").reset_index(drop=True)
    n = len(pdf)
    labels = cut_tree(n, _merges(dissimilarity(pdf, pdf, grid=True)), -(-n // 10))
    return pd.DataFrame({"piece_id": pdf["piece_id"], "gram_no": pdf["gram_no"],
                         "cluster": pdf["gram_no"].to_numpy()[labels]})


_CLUSTERS = "piece_id int, gram_no long, cluster long"


def _nearest_in_blocks(grams: DataFrame, block: int) -> DataFrame:
    """For every cluster its nearest other cluster, by complete linkage.

    Clusters are dealt to blocks of about ``block`` groups; one task holds one
    pair of blocks and reports only the best partner of each cluster in it, so
    no list of all pairs ever exists."""
    names = list(WEIGHTS)
    sized = grams.join(grams.groupBy("piece_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "piece_id")
    own = sized.withColumn("b", F.pmod(F.xxhash64("cluster"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = (own.withColumn("o", F.explode(every)).select("*", F.col("b").alias("i"), F.col("o").alias("j"), F.lit(True).alias("is_row"))
             .unionByName(own.withColumn("o", F.explode(every)).select("*", F.col("o").alias("i"), F.col("b").alias("j"), F.lit(False).alias("is_row"))))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf["is_row"]].sort_values("cluster").reset_index(drop=True)
        cols = pdf[~pdf["is_row"]].sort_values("cluster").reset_index(drop=True)
        out = {"piece_id": [], "cluster": [], "height": [], "partner": []}
        if len(rows) and len(cols):
            d = dissimilarity(rows, cols, grid=True)
            rc, r_at = np.unique(rows["cluster"].to_numpy(), return_index=True)
            cc, c_at = np.unique(cols["cluster"].to_numpy(), return_index=True)
            d = np.maximum.reduceat(np.maximum.reduceat(d, r_at, axis=0), c_at, axis=1)
            d[rc[:, None] == cc[None, :]] = np.inf
            for k, c in enumerate(rc):
                low = d[k].min()
                if np.isfinite(low):
                    ties = cc[d[k] == low]
                    p = min(ties, key=lambda t: (min(t, c), max(t, c)))
                    for key, v in zip(out, (rows["piece_id"].iloc[0], c, low, p)):
                        out[key].append(v)
        return pd.DataFrame(out)
    found = spread(cells.select("piece_id", "i", "j", "is_row", "cluster", *names), "piece_id", "i", "j").groupBy("piece_id", "i", "j").applyInPandas(
        best, "piece_id int, cluster long, height double, partner long")
    order = F.struct("height", F.least("cluster", "partner"), F.greatest("cluster", "partner"))
    return found.groupBy("piece_id", "cluster").agg(F.min("height").alias("height"), F.min_by("partner", order).alias("partner"))


def _cluster_blocks(grams: DataFrame, block: int) -> DataFrame:
    """Complete linkage without a full matrix: rounds that merge reciprocal
    nearest neighbours, until the lowest merges wanted are certain. The same
    merges come out as one after the other, since a merged cluster is never
    nearer to a third one than its nearer half was."""
    targets = grams.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "wanted", F.col("n") - F.ceil(F.col("n") / 10))
    state = cut_lineage(grams.withColumn("cluster", F.col("gram_no")))
    merges = None
    while True:
        near = cut_lineage(_nearest_in_blocks(state, block))
        mutual = near.alias("x").join(
            near.alias("y"), (F.col("x.piece_id") == F.col("y.piece_id")) & (F.col("x.partner") == F.col("y.cluster"))
            & (F.col("y.partner") == F.col("x.cluster")) & (F.col("x.cluster") < F.col("x.partner"))).select(
            "x.piece_id", "x.height", F.col("x.cluster").alias("a"), F.col("x.partner").alias("b"))
        merges = cut_lineage(mutual if merges is None else merges.unionByName(mutual))
        step = mutual.select("piece_id", F.col("b").alias("cluster"), F.col("a").alias("__a"))
        state = cut_lineage(state.join(step, ["piece_id", "cluster"], "left")
                            .withColumn("cluster", F.coalesce("__a", "cluster")).drop("__a"))
        lowest = _lowest_merges(merges, targets)
        edge = lowest.groupBy("piece_id").agg(F.max("height").alias("edge"), F.count(F.lit(1)).alias("have"))
        # Merges still to come are no lower than the nearest pairs of now.
        rest = near.join(mutual.select("piece_id", F.explode(F.array("a", "b")).alias("cluster")),
                         ["piece_id", "cluster"], "left_anti").groupBy("piece_id").agg(F.min("height").alias("next"))
        open_ = targets.join(edge, "piece_id", "left").join(rest, "piece_id", "left").where(
            (F.coalesce("have", F.lit(0)) < F.col("wanted")) | (F.col("next") <= F.col("edge")))
        todo = open_.join(state.groupBy("piece_id").agg(F.count_distinct("cluster").alias("c")), "piece_id").where("c > 1")
        if todo.isEmpty():
            break
    edges = lowest.select("piece_id", F.col("a").alias("u"), F.col("b").alias("v"))
    comps = flatten_contractions(edges).withColumnsRenamed({"note_idx": "gram_no", "parent_idx": "cluster"})
    return grams.select("piece_id", "gram_no").join(comps, ["piece_id", "gram_no"], "left").select(
        "piece_id", "gram_no", F.coalesce("cluster", "gram_no").alias("cluster"))


def _lowest_merges(merges: DataFrame, targets: DataFrame) -> DataFrame:
    """The ``wanted`` lowest merges of each piece, ranked by height buckets so
    that no task ranks a whole piece."""
    ranked = with_row_number(merges.withColumn("__h", F.floor(F.col("height") * 4096)), ["piece_id"], ["__h"],
                             ["height", "a", "b"], "__r").drop("__h")
    return ranked.join(targets.select("piece_id", "wanted"), "piece_id").where(F.col("__r") < F.col("wanted")).drop("__r", "wanted")


def cluster_grams(groups: DataFrame, task_groups: int = TASK_GROUPS) -> DataFrame:
    """``(piece_id, gram_key, n, cluster)``: complete linkage of the groups of
    each piece down to a tenth as many clusters.

    Pieces with up to ``task_groups`` distinct groups take one task each, with
    a matrix of checked size; larger ones go through the block rounds, which
    give the same clusters."""
    keyed = groups.withColumn("__c", F.pmod(F.ascii("gram_key"), F.lit(128)))
    numbered = with_row_number(keyed, ["piece_id"], ["__c"], ["gram_key"], "gram_no").drop("__c")
    numbered = cut_lineage(encoded(numbered).drop("notes"))
    sizes = numbered.groupBy("piece_id").agg(F.count(F.lit(1)).alias("__n"))
    tagged = numbered.join(sizes, "piece_id")
    names = ["piece_id", "gram_no", *WEIGHTS]
    labels = spread(tagged.where(F.col("__n") <= task_groups).select(*names), "piece_id").groupBy("piece_id").applyInPandas(_cluster_piece, _CLUSTERS)
    large = tagged.where(F.col("__n") > task_groups).select(*names)
    if not sizes.where(F.col("__n") > task_groups).isEmpty():
        labels = labels.unionByName(_cluster_blocks(large, max(task_groups // 2, 2)))
    return numbered.select("piece_id", "gram_no", "gram_key", "n").join(labels, ["piece_id", "gram_no"]).drop("gram_no")


# Fixed values of the selection.
MIN_CLUSTER_SIZE = 10
MIN_Z_SCORE = 2.0
MIN_OVERLAP = 0.5


def significant_clusters(clustered: DataFrame, min_size: int = MIN_CLUSTER_SIZE, min_z: float = MIN_Z_SCORE) -> DataFrame:
    """Clusters with enough occurrences, absolutely and for their piece."""
    sizes = clustered.groupBy("piece_id", "cluster").agg(F.sum("n").alias("size"))
    stats = sizes.groupBy("piece_id").agg(F.avg("size").alias("__m"), F.stddev_pop("size").alias("__s"))
    z = (F.col("size") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    return (sizes.join(stats, "piece_id").withColumn("z_score", z)
            .where((F.col("size") >= min_size) & (F.col("z_score") >= min_z)).drop("__m", "__s"))


def _overlaps(spans: DataFrame, slot: float = 1.0) -> DataFrame:
    """Pairs of clusters where enough spans of the smaller one meet a span of
    the other. Spans are distinct stretches of time, met through time slots."""
    sizes = spans.groupBy("piece_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    cut = spans.select("piece_id", "cluster", "first_ql", "last_ql").distinct()
    slots = cut.withColumn("slot", F.explode(F.sequence(F.floor(F.col("first_ql") / slot), F.floor(F.col("last_ql") / slot))))
    other = slots.select("piece_id", "slot", F.col("cluster").alias("other"), F.col("first_ql").alias("f"), F.col("last_ql").alias("l"))
    meets = (F.col("cluster") != F.col("other")) & (F.col("f") < F.col("last_ql")) & (F.col("first_ql") < F.col("l"))
    hit = slots.join(other, ["piece_id", "slot"]).where(meets).select(
        "piece_id", "cluster", "first_ql", "last_ql", "other").distinct()
    counts = spans.join(hit, ["piece_id", "cluster", "first_ql", "last_ql"]).groupBy("piece_id", "cluster", "other").agg(
        F.count(F.lit(1)).alias("hits"))
    rated = counts.join(sizes, ["piece_id", "cluster"]).join(
        sizes.select("piece_id", F.col("cluster").alias("other"), F.col("size").alias("other_size")), ["piece_id", "other"])
    smaller = (F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("cluster") < F.col("other")))
    return rated.where(smaller & (F.col("hits") / F.col("size") >= MIN_OVERLAP)).select(
        "piece_id", F.col("cluster").alias("u"), F.col("other").alias("v"))


def merge_overlapping_clusters(occurrences: DataFrame) -> DataFrame:
    """Merge clusters when at least half the spans of the smaller hit the other,
    and repeat on the merged ones until nothing changes. ``occurrences`` has
    (piece_id, cluster, first_ql, last_ql); returns (piece_id, cluster,
    merged)."""
    names = occurrences.select("piece_id", "cluster").distinct().withColumn("merged", F.col("cluster"))
    names = cut_lineage(names)
    while True:
        now = occurrences.join(names, ["piece_id", "cluster"]).select(
            "piece_id", F.col("merged").alias("cluster"), "first_ql", "last_ql")
        edges = cut_lineage(_overlaps(now))
        if edges.isEmpty():
            return names
        comps = flatten_contractions(edges).withColumnsRenamed({"note_idx": "merged", "parent_idx": "__m"})
        names = cut_lineage(names.join(comps, ["piece_id", "merged"], "left").select(
            "piece_id", "cluster", F.coalesce("__m", "merged").alias("merged")))


def find_motifs(notes: DataFrame, min_size: int = MIN_CLUSTER_SIZE, min_z: float = MIN_Z_SCORE) -> DataFrame:
    """Occurrences of the motifs of each piece, with their merged cluster."""
    grams = cut_lineage(motif_grams(notes))
    clustered = cut_lineage(cluster_grams(group_grams(grams)))
    chosen = clustered.join(significant_clusters(clustered, min_size, min_z).select("piece_id", "cluster"),
                            ["piece_id", "cluster"], "left_semi")
    found = grams.join(chosen.select("piece_id", "gram_key", "cluster"), ["piece_id", "gram_key"])
    merged = merge_overlapping_clusters(found.select("piece_id", "cluster", "first_ql", "last_ql"))
    return found.join(merged, ["piece_id", "cluster"]).drop("cluster").withColumnRenamed("merged", "cluster")


def motif_report(found: DataFrame) -> DataFrame:
    """Size, number of distinct groups and a sample group of each motif."""
    order = F.struct("part_idx", "voice", "pos")
    return found.groupBy("piece_id", "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("gram_key").alias("n_groups"),
        F.min_by("gram_key", order).alias("sample"))


def motif_flag(notes: DataFrame, found: DataFrame) -> DataFrame:
    """Whether each note belongs to a motif."""
    items = motif_items(notes).select(*VOICE, "onset_tick", "is_rest", "pos")
    covered = found.select(*VOICE, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n_raw") - 1)).alias("pos")).distinct()
    onsets = items.where(~F.col("is_rest")).join(covered, [*VOICE, "pos"], "left_semi").select(
        *VOICE, "onset_tick", F.lit(True).alias("__m"))
    return (notes.where(~F.col("is_rest")).join(onsets, [*VOICE, "onset_tick"], "left")
            .withColumn("motif", F.coalesce("__m", F.lit(False))).drop("__m"))
