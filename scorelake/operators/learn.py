"""Feature tables, models, cross-validation and regressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.ordered import with_neighbours, with_row_number, with_running_max
from scorelake.operators import features as ft
from scorelake.session import cut_lineage, spread
from scorelake.sources.views import BAR, ONSET, VOICE

FEATURES = ["active_rhythm", "sustained_rhythm", "bass_line", "entrance_effect", "onset_after_rest",
            "rhythm_variety", "strong_beats", "occurrence", "vertical_doubling", "highest_pitch", "pitch_distance"]


def note_features(notes: DataFrame, division: float = 0.5) -> DataFrame:
    """The features of ``FEATURES`` on every sounding note, with one aggregate
    per level (bar and part, voice and bar, onset, voice item) instead of one
    per feature."""
    heard = notes.where(~F.col("is_rest"))
    flags = ft.bar_flags(notes)
    cell = [*VOICE, "measure_idx"]
    names = heard.groupBy(*cell, "name").agg(F.count(F.lit(1)).alias("__n"))
    names = names.withColumn("__t", F.max("__n").over(Window.partitionBy(*cell))).select(
        *cell, "name", ((F.col("__n") == F.col("__t")) & (F.col("__n") > 1)).alias("occurrence"))
    doubled = heard.groupBy(*ONSET, "name").agg((F.count(F.lit(1)) >= 2).alias("vertical_doubling"))
    tops = heard.groupBy(*ONSET).agg(F.max("ps").alias("__top"))
    items = ft.voice_items(notes).withColumn("sounding", ~F.col("is_rest"))
    # Neighbours in the part; those of another voice only count for
    # ``onset_after_rest``.
    items = with_neighbours(items, ["piece_id", "part_idx"], ["voice", "measure_idx"], ft.ITEM_ORDER,
                            ["voice", "is_rest", "item_dur"], prev="__p", next="__n")
    mine = lambda side: F.coalesce(F.col(f"{side}.voice") == F.col("voice"), F.lit(False))
    entry = ~F.col("is_rest") & (~mine("__p") | F.col("__p.is_rest"))
    items = with_running_max(items, VOICE, ["measure_idx"], ft.ITEM_ORDER, {"__entry": F.when(entry, F.col("item_onset"))})
    differs = lambda side: mine(side) & (F.col(f"{side}.is_rest") | (F.col(f"{side}.item_dur") != F.col("item_dur")))
    flow = items.where(~F.col("is_rest")).select(
        *VOICE, "measure_idx", "onset_tick", (F.col("item_onset") - F.col("__entry")).alias("entrance_effect"),
        F.coalesce(F.col("__p.is_rest"), F.lit(True)).alias("onset_after_rest"),
        (~mine("__p") | differs("__p") | differs("__n")).alias("rhythm_variety"))
    return (flags.join(names, [*cell, "name"], "left").join(doubled, [*ONSET, "name"], "left")
            .join(tops, ONSET, "left").join(flow, [*VOICE, "measure_idx", "onset_tick"], "left")
            .withColumn("highest_pitch", F.col("ps") == F.col("__top")).drop("__top")
            .withColumn("strong_beats", F.pmod(F.col("offset_ql"), F.lit(division)) < 1e-3)
            .withColumn("pitch_distance", F.abs(F.col("ps") - 60)))


def assemble(df: DataFrame, columns: list[str], label: str | None = None, out: str = "features") -> DataFrame:
    """Vector of the columns with missing values as 0, and the label as double."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    vectors = VectorAssembler(inputCols=columns, outputCol=out).transform(filled)
    return vectors.withColumn("label", F.col(label).cast("double")) if label else vectors


# --- models ---------------------------------------------------------------


def model(kind: str, n_features: int = 0) -> Estimator:
    """An estimator by name. ``weighted`` stands in for a network with a
    weighted loss: a linear model whose positive rows weigh 0.7, in column
    ``weight``."""
    kinds = {
        "multinomial": lambda: LogisticRegression(family="multinomial", maxIter=50),
        "gaussian_bayes": lambda: NaiveBayes(modelType="gaussian"),
        "network": lambda: MultilayerPerceptronClassifier(layers=[n_features, 2 * n_features, 2], maxIter=20, seed=1),
        "weighted": lambda: LogisticRegression(weightCol="weight", maxIter=50),
        "svm": lambda: LinearSVC(maxIter=20),
        "logistic": lambda: LogisticRegression(maxIter=50),
        "tree": lambda: DecisionTreeClassifier(maxDepth=7, seed=1),
        "forest": lambda: RandomForestClassifier(numTrees=10, seed=1),
    }
    return kinds[kind]()


POSITIVE_WEIGHT = 0.7


def with_class_weight(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.when(F.col("label") > 0, POSITIVE_WEIGHT).otherwise(1.0))


def fit_predict(kind: str, train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Fit on all rows and predict them. The table is written out once, so the
    passes of the solver do not compute the features again."""
    table = cut_lineage(train)
    ready = with_class_weight(assemble(table, columns, label))
    return model(kind, len(columns)).fit(ready).transform(ready)


def probabilities(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("proba", vector_to_array("probability"))


def describe_weights(fitted: Model, columns: list[str], spark) -> DataFrame:
    """Weight of each feature per class, relative to class 0, by mean weight."""
    if fitted.numClasses == 2 and fitted.coefficientMatrix.numRows == 1:
        base, rows = [0.0] * len(columns), [fitted.coefficientMatrix.toArray()[0]]
    else:
        table = fitted.coefficientMatrix.toArray()
        base, rows = table[0], list(table[1:])
    out = [(name, k + 1, float(row[i] - base[i])) for i, name in enumerate(columns) for k, row in enumerate(rows)]
    df = spark.createDataFrame(out, "feature string, label int, weight double")
    mean = F.avg("weight").over(Window.partitionBy("feature"))
    return df.withColumn("mean_weight", mean).orderBy(F.desc("mean_weight"), "feature", "label")


def save_pipeline(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- cross-validation -----------------------------------------------------


def leave_one_piece_out(df: DataFrame, columns: list[str], label: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Accuracy of Gaussian naive Bayes on each piece when trained on all
    others, and the average over pieces.

    The model of a fold needs only counts, sums and squares per class, and those
    of the other pieces are the total less the piece's own. So all folds come
    from one aggregate, without a loop."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    rows = df.select("piece_id", F.col(label).cast("int").alias("label"), F.array(*x).alias("x"))
    n = len(columns)
    stats = ["n"] + [f"s{i}" for i in range(n)] + [f"q{i}" for i in range(n)]
    at = lambda i: F.element_at("x", i + 1)
    own = rows.groupBy("piece_id", "label").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(at(i)).alias(f"s{i}") for i in range(n)],
        *[F.sum(at(i) * at(i)).alias(f"q{i}") for i in range(n)])
    total = own.groupBy("label").agg(*[F.sum(s).alias(f"t_{s}") for s in stats])
    pieces = own.select("piece_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
    folds = pieces.join(F.broadcast(total), "label").join(own, ["piece_id", "label"], "left").na.fill(0.0, stats).select(
        "piece_id", "label", *[(F.col(f"t_{s}") - F.col(s)).alias(s) for s in stats]).where(F.col("n") > 0)
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    var = lambda i: F.greatest(F.col(f"q{i}") / F.col("n") - mean(i) * mean(i), F.lit(1e-9))
    params = folds.select("piece_id", F.struct(
        F.col("label"), F.log("n").alias("prior"), F.array(*[mean(i) for i in range(n)]).alias("mean"),
        F.array(*[var(i) for i in range(n)]).alias("var")).alias("c")).groupBy("piece_id").agg(
        F.array_sort(F.collect_list("c")).alias("classes"))
    def score(c: Column) -> Column:
        parts = F.zip_with(F.col("x"), F.arrays_zip(c["mean"].alias("mean"), c["var"].alias("var")), lambda v, p: -0.5 * (
            F.log(p["var"]) + (v - p["mean"]) * (v - p["mean"]) / p["var"]))
        return F.struct((c["prior"] + F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).alias("score"),
                        (-c["label"]).alias("neg"))
    guess = -F.array_max(F.transform("classes", score))["neg"]
    judged = rows.join(params, "piece_id").withColumn("pred", guess)
    per = judged.groupBy("piece_id").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
    return per.select(F.col("piece_id").cast("string").alias("fold"), "accuracy").unionByName(
        per.agg(F.avg("accuracy").alias("accuracy")).select(F.lit("average").alias("fold"), "accuracy"))


def leave_one_out(df: DataFrame, make: Estimator, pieces: list[int]) -> DataFrame:
    """The same with any estimator over assembled rows, one fit per listed
    piece."""
    parts = []
    for piece in pieces:
        predicted = make.fit(df.where(F.col("piece_id") != piece)).transform(df.where(F.col("piece_id") == piece))
        parts.append(predicted.groupBy("piece_id").agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))
    return reduce(DataFrame.unionByName, parts)


# --- ordering of the notes of an onset -------------------------------------


def ordering_pairs(notes: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Per onset, difference vectors of every kept and dropped note, once each
    way. Run on contracted notes, where an onset is bounded by the number of
    pitches."""
    def side(keep: bool, prefix: str) -> DataFrame:
        rows = notes.where(F.col(label) if keep else ~F.col(label))
        return rows.select(*ONSET, F.col("note_idx").alias(prefix), *[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in columns])
    pairs = side(True, "k").join(side(False, "d"), ONSET)
    up = pairs.select("piece_id", "k", "d", *[(F.col(f"k_{c}") - F.col(f"d_{c}")).alias(c) for c in columns], F.lit(1).alias("label"))
    down = pairs.select("piece_id", "k", "d", *[(F.col(f"d_{c}") - F.col(f"k_{c}")).alias(c) for c in columns], F.lit(0).alias("label"))
    return up.unionByName(down)


def train_ordering(pairs: DataFrame, columns: list[str]) -> Model:
    table = cut_lineage(pairs)
    return LinearSVC(maxIter=20).fit(assemble(table, columns, "label"))


def keep_highest(notes: DataFrame, utility: Column, limit: Column) -> DataFrame:
    """Keep the ``limit`` notes of highest utility per onset; the first in score
    order on a tie."""
    w = Window.partitionBy(*ONSET).orderBy(F.desc("utility"), "note_idx")
    return notes.withColumn("utility", utility).withColumn("keep", F.row_number().over(w) <= limit)


def max_kept(output_count: Column) -> Column:
    return F.least(F.lit(8), F.bround(output_count).cast("int"))


def decode_ordering(notes: DataFrame, fitted: Model, columns: list[str], counts: DataFrame) -> DataFrame:
    """Top notes per onset by a trained ordering; ``counts`` has the expected
    output per onset."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w) for c, w in zip(columns, fitted.coefficients)]
    limit = F.coalesce(max_kept(F.col("output_count")), F.lit(0))
    rows = notes.join(counts.select(*ONSET, "output_count"), ONSET, "left")
    return keep_highest(rows, reduce(lambda a, b: a + b, parts), limit)


# --- chains of onsets ------------------------------------------------------


def onset_numbers(notes: DataFrame) -> DataFrame:
    """The dense number of each sounding onset in its piece."""
    return with_row_number(notes.where(~F.col("is_rest")).select(*ONSET, "onset_ql").distinct(),
                           ["piece_id"], ["measure_idx"], ["onset_tick"], "onset_no")


def onset_members(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Uncontracted notes with their group, the number of their onset, and their
    place in the onset."""
    onsets = onset_numbers(notes)
    live = notes.join(mapping.where(~F.col("is_contracted")).select("piece_id", "note_idx", "group_idx"), ["piece_id", "note_idx"])
    placed = live.withColumn("place", F.row_number().over(Window.partitionBy(*ONSET).orderBy("note_idx")) - 1)
    return placed.join(onsets.select(*ONSET, "onset_no"), ONSET)


def voice_links(members: DataFrame, group_edges: DataFrame) -> DataFrame:
    """Voice edges between groups of successive onsets: (piece, onset_no of the
    later, place before, place now)."""
    ends = members.select("piece_id", "group_idx", "onset_no", "place")
    u = ends.select("piece_id", F.col("group_idx").alias("u"), F.struct("onset_no", "place").alias("a"))
    v = ends.select("piece_id", F.col("group_idx").alias("v"), F.struct("onset_no", "place").alias("b"))
    both = group_edges.select("piece_id", "u", "v").join(u, ["piece_id", "u"]).join(v, ["piece_id", "v"])
    early, late = F.least("a", "b"), F.greatest("a", "b")
    return (both.select("piece_id", early.alias("e"), late.alias("l")).where(F.col("l.onset_no") - F.col("e.onset_no") == 1)
            .select("piece_id", F.col("l.onset_no").alias("onset_no"), F.col("e.place").alias("before"), F.col("l.place").alias("now")))


def onset_table(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per onset: its notes in order, and the edges to the onset
    before."""
    rows = members.groupBy("piece_id", "measure_idx", "onset_tick", "onset_no", "onset_ql").agg(
        F.array_sort(F.collect_list(F.struct("place", "group_idx", "pc"))).alias("notes"))
    edges = links.groupBy("piece_id", "onset_no").agg(F.array_sort(F.collect_list(F.struct("before", "now"))).alias("edges"))
    return rows.join(edges, ["piece_id", "onset_no"], "left")


def chain_potentials(members: DataFrame, links: DataFrame, label: Column, utility: Column,
                     w_onset: float, w_voice: float, w_pc: float) -> DataFrame:
    """Per piece, the vertical and the horizontal potential of a labelling.
    Vertical: utilities of kept notes. Horizontal, between successive onsets and
    per quarter length: crowding, crowding in a voice, and the number of pitch
    classes that change."""
    rows = members.withColumn("__keep", label).withColumn("__u", utility)
    kept = F.col("__keep")
    onsets = rows.groupBy("piece_id", "measure_idx", "onset_no").agg(
        F.first("onset_ql").alias("onset_ql"), F.max(kept.cast("int")).alias("any"),
        F.coalesce(F.bit_or(F.when(kept, F.pow(F.lit(2), F.col("pc")).cast("int"))), F.lit(0)).alias("pcs"),
        F.sum(F.when(kept, F.col("__u")).otherwise(0.0)).alias("vertical"))
    marks = rows.select("piece_id", "onset_no", "place", F.col("__keep").alias("k"))
    now = marks.withColumnsRenamed({"place": "now", "k": "k_now"})
    before = marks.select("piece_id", (F.col("onset_no") + 1).alias("onset_no"), F.col("place").alias("before"), F.col("k").alias("k_before"))
    crowded = links.join(now, ["piece_id", "onset_no", "now"]).join(before, ["piece_id", "onset_no", "before"]).groupBy(
        "piece_id", "onset_no").agg(F.sum((F.col("k_now") & F.col("k_before")).cast("int")).alias("crowded"))
    linked = with_neighbours(onsets, ["piece_id"], ["measure_idx"], ["onset_no"], ["onset_no", "onset_ql", "any", "pcs"], prev="p")
    linked = linked.join(crowded, ["piece_id", "onset_no"], "left").na.fill(0, ["crowded"])
    span = F.col("onset_ql") - F.col("p.onset_ql")
    span = F.when(span == 0, 0.25).otherwise(span)
    joint = (w_onset * F.col("any") * F.col("p.any") + w_voice * F.col("crowded")
             + w_pc * F.bit_count(F.col("pcs").bitwiseXOR(F.col("p.pcs")))) / span
    adjacent = F.col("p.onset_no") == F.col("onset_no") - 1
    return linked.groupBy("piece_id").agg(
        F.sum("vertical").alias("vertical"), F.sum(F.when(adjacent, joint).otherwise(0.0)).alias("horizontal"))


# --- regressions ----------------------------------------------------------


def least_squares(df: DataFrame, keys: list[str], x: list[str], y: str) -> DataFrame:
    """Coefficients and intercept of a linear regression per key, from the sums
    of products."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    n = len(cols)
    products = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]
    sums = df.groupBy(*keys).agg(*products, *[F.sum(cols[i] * F.col(y)).alias(f"v{i}") for i in range(n)])
    matrix = F.array(*[F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for j in range(n)]) for i in range(n)])

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, v: pd.Series) -> pd.Series:
        import numpy as np
        return pd.Series([np.linalg.lstsq(np.stack([np.asarray(r, dtype=float) for r in a]),
                                          np.asarray(b, dtype=float), rcond=None)[0].tolist() for a, b in zip(m, v)])
    solved = sums.withColumn("__b", solve(matrix, F.array(*[F.col(f"v{i}") for i in range(n)])))
    return solved.select(*keys, F.col("__b")[0].alias("intercept"), *[F.col("__b")[i + 1].alias(f"coef_{c}") for i, c in enumerate(x)])


def r_squared(df: DataFrame, keys: list[str], truth: Column, pred: Column) -> DataFrame:
    rows = df.withColumn("__t", truth).withColumn("__p", pred)
    return rows.groupBy(*keys).agg(
        (1 - F.sum((F.col("__t") - F.col("__p")) ** 2) / (F.var_pop("__t") * F.count(F.lit(1)))).alias("r2"))


def rate_regression(notes: DataFrame, out: DataFrame) -> DataFrame:
    """Per piece, log output rate on log base and log detail of the input rate;
    the fit is judged on counts."""
    base = ft.output_count_by_onset(notes)
    outs = out.groupBy(*ONSET).agg(F.count_distinct("ps").alias("out_count"))
    rows = base.join(outs, ONSET, "left").withColumn(
        "count", F.greatest(F.least(F.coalesce("out_count", F.lit(0)), F.col("in_count")), F.lit(1)))
    rows = rows.select("piece_id", "span", "count", F.log("base").alias("log_base"), F.log("detail").alias("log_detail"),
                       F.log(F.col("count") / F.col("span")).alias("log_rate"))
    rows = cut_lineage(rows)
    fit = least_squares(rows, ["piece_id"], ["log_base", "log_detail"], "log_rate")
    guess = F.exp(F.col("intercept") + F.col("coef_log_base") * F.col("log_base")
                  + F.col("coef_log_detail") * F.col("log_detail")) * F.col("span")
    return fit.join(r_squared(rows.join(fit, "piece_id"), ["piece_id"], F.col("count"), guess), "piece_id")


def count_pairs(notes: DataFrame, out: DataFrame) -> DataFrame:
    """Per onset, input and output note counts and the shortest input length,
    where the output is not larger."""
    ins = notes.where(~F.col("is_rest") & (F.col("dur_tick") > 0)).groupBy(*ONSET).agg(
        F.count(F.lit(1)).alias("in_count"), F.min("dur_ql").alias("min_dur"))
    outs = out.groupBy(*ONSET).agg(F.count(F.lit(1)).alias("out_count"))
    return ins.join(outs, ONSET, "left").na.fill(0, ["out_count"]).where(F.col("in_count") >= F.col("out_count"))


def count_tally(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("piece_id", "in_count", "out_count").agg(F.count(F.lit(1)).alias("n"))


def count_regression(pairs: DataFrame) -> DataFrame:
    """Per piece, output count on 1 / input count and log2 of the shortest
    length."""
    rows = pairs.withColumn("inverse", 1 / F.col("in_count")).withColumn("log_dur", F.log2("min_dur"))
    fit = least_squares(rows, ["piece_id"], ["inverse", "log_dur"], "out_count")
    guess = F.col("intercept") + F.col("coef_inverse") * F.col("inverse") + F.col("coef_log_dur") * F.col("log_dur")
    return fit.join(r_squared(rows.join(fit, "piece_id"), ["piece_id"], F.col("out_count"), guess), "piece_id")


def _median_bucket(radius: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("onset_ql")
        start = pdf["onset_ql"].to_numpy()
        end = start + pdf["span"].to_numpy()
        rate = pdf["rate"].to_numpy()
        home = pdf[pdf["home"]]
        out = []
        for c in home["onset_ql"].to_numpy():
            a = np.searchsorted(end, c - radius, side="right")
            b = np.searchsorted(start, c + radius, side="left")
            left = np.maximum(start[a:b] - c, -radius)
            right = np.where(start[a:b] >= c, np.minimum(end[a:b] - c, radius), end[a:b] - c)
            full = np.flatnonzero(np.cumsum(right - left) >= radius - 1e-12)
            out.append(rate[a:b][full[0] if len(full) else -1])
        return home[["piece_id", "measure_idx", "onset_tick"]].assign(median_rate=out)
    return run


def median_filter(rates: DataFrame, radius: float) -> DataFrame:
    """The value at which the time inside ``radius`` around each onset, added up
    from the left, reaches the radius."""
    own = F.floor(F.col("onset_ql") / radius)
    copies = (rates.withColumn("bucket", F.explode(F.sequence(
        F.floor((F.col("onset_ql") - radius) / radius), F.floor((F.col("onset_ql") + F.col("span") + radius) / radius))))
        .withColumn("home", F.col("bucket") == own))
    return spread(copies, "piece_id", "bucket").groupBy("piece_id", "bucket").applyInPandas(
        _median_bucket(radius), "piece_id int, measure_idx int, onset_tick long, median_rate double")


# --- flow weights ---------------------------------------------------------


def flow_weight_training(training: DataFrame) -> DataFrame:
    """Weights of the previous numeral, the next one and the pair for "this is
    the home key", as (attribute, value, weight). Equal rows are counted first
    and weigh as often as they occur."""
    rows = cut_lineage(training.groupBy("from_numeral", "to_numeral", "trans", "match").agg(
        F.count(F.lit(1)).cast("double").alias("weight")).withColumn("label", (F.col("match") == "Yes").cast("double")))
    sources = {"1": "from_numeral", "2": "to_numeral", "Trans": "trans"}
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_i", stringOrderType="alphabetAsc") for c in sources.values()]
    encoder = OneHotEncoder(inputCols=[f"{c}_i" for c in sources.values()], outputCols=[f"{c}_v" for c in sources.values()], dropLast=False)
    vector = VectorAssembler(inputCols=[f"{c}_v" for c in sources.values()], outputCol="features")
    fitted = Pipeline(stages=[*indexers, encoder, vector, LogisticRegression(
        weightCol="weight", regParam=0.01, maxIter=50)]).fit(rows)
    labels = [(a, v) for (a, _), ix in zip(sources.items(), fitted.stages[:3]) for v in ix.labels]
    weights = fitted.stages[-1].coefficients.toArray()
    return rows.sparkSession.createDataFrame(
        [(a, v, float(w)) for (a, v), w in zip(labels, weights)], "attribute string, value string, weight double")
