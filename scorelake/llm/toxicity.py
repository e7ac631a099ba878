"""Toxicity by weak supervision.

Voters are terms (words and beginnings of words) and lexicons of terms that the labelled rows mark
as telling, patterns of the writing, and the given label itself. A generative model with a hidden
class estimates how often each voter fires in either class, and how far voters repeat one another
within a class: the say of a voter is divided by the mass of the voters it goes along with. Its
posterior, not the raw label, trains a logistic regression on the terms, which scores every text.

Only labels of rows with crc32(doc_id) mod 3 other than 1 are read; labels, language, source and id
are no inputs of a score. At most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows are used, chosen by a
hash of the id; every document is scored whole.

Null and empty texts score like a text without any term. A null label is no label; the mean decides
between several labels of an id. Without rows of both classes to learn from, every score is the
share of toxic labels (0 without labels). A null doc_id is not held out. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import apart, in_arrow, table, written
from scorelake.llm.registry import register

MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: Lengths of the beginnings of words that count as terms, besides whole words (at most 24 letters).
STEMS = (3, 4, 5, 6, 7)
TERMS = 1024
TERM_VOTERS = 48
LEXICONS = 8
THRESHOLD = 0.7

WORD = re.compile(r"[^\W_]+")
#: Weaker correlations of two voters within a class are taken for chance.
WEAK = 0.2
_SCALE = 1 << 40


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def terms_of(text: str | None, among: frozenset | dict | None = None) -> set[str]:
    """Words (ending in a blank) and beginnings of words of a text."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        if len(w) <= 24:
            out.add(w + " ")
        for k in STEMS:
            if len(w) < k:
                break
            out.add(w[:k])
    return out if among is None else {t for t in out if t in among}


def patterns_of(text: str | None) -> list[bool]:
    """How it is written: shouting, exclamations, second person marks, repeated letters."""
    t = text or ""
    letters = sum(map(str.isalpha, t[:0])) or len(t)
    capitals = len(re.findall(r"[A-Z]", t))
    return [capitals * 4 > letters > 20, t.count("!") * 100 > len(t) > 0, t.count("?") * 100 > len(t) > 0,
            bool(re.search(r"([^\W\d_])\1{3}", t)), bool(re.search(r"[!?]{3}|[*#$@]{2}[a-z]", t))]


N_PATTERNS = len(patterns_of(""))


def _sample(labels: DataFrame, doc_id: str, label: str) -> tuple[DataFrame, int, int, float, float]:
    """Labelled rows to learn from (id, y): not held out, bounded per class."""
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(doc_id))
             .groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    known = written(known)
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    f1, f0 = min(1.0, MAX_TOXIC / max(n1, 1)), min(1.0, MAX_CLEAN / max(n0, 1))
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(_SCALE))
    some = known.where(draw < F.when(F.col("y") == 1, F.lit(int(f1 * _SCALE))).otherwise(F.lit(int(f0 * _SCALE))))
    return some, n1, n0, f1, f0


def _select_terms(sample: DataFrame) -> list[tuple[str, int, int]]:
    """Terms that the toxic rows hold more often than chance explains, best first, with their counts."""
    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]], ["term", "clean", "toxic"])
            counts.clear()
            return rows
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                for term in terms_of(t):
                    counts.setdefault(term, [0, 0])[y] += 1
                if len(counts) > 400_000:
                    yield flush()
        if counts:
            yield flush()
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return []
    found = sample.select("text", "y").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    found = written(found.where("t >= 3"))
    tried = max(found.count(), 2)
    log = lambda x, p: F.when(x > 0, x * F.log(x / p)).otherwise(F.lit(0.0))
    share = (F.col("t") + F.col("c")) / (n1 + n0)
    gain = 2 * (log(F.col("t"), n1 * share) + log(F.col("c"), n0 * share))
    rows = (found.withColumn("gain", gain).where((F.col("t") * n0 > 3 * F.col("c") * n1) & (F.col("gain") > 2 * math.log(tried)))
            .orderBy(F.desc("gain"), "term").limit(TERMS).collect())
    return [(r.term, r.t, r.c) for r in rows]


def _voters(terms: list[tuple[str, int, int]]) -> tuple[list[str], list[list[str]]]:
    """Terms that vote on their own (of a word and its beginnings with like counts, one), and lexicons of the others."""
    own: list[tuple[str, int]] = []
    for term, n, _ in terms:
        stem = term.strip()
        if len(own) < TERM_VOTERS and not any((stem.startswith(o.strip()) or o.startswith(stem)) and min(n, m) * 10 >= max(n, m) * 9 for o, m in own):
            own.append((term, n))
    chosen = {o for o, _ in own}
    rest = [t for t, _, _ in terms if t not in chosen]
    return [o for o, _ in own], [rest[k::LEXICONS] for k in range(LEXICONS) if rest[k::LEXICONS]]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden class for rows of 0/1 votes, and per voter how often it fires in class
    1 and 0, and its share of independent say. ``start``: first guess of the posterior."""
    q, v = start.astype(float), votes.astype(float)
    say = np.ones(v.shape[1])
    for _ in range(rounds):
        fire = [((w @ v) + 0.5) / (w.sum() + 1.0) for w in (1 - q, q)]
        # Within the likelier class of each row: soft shares would read the split into classes as correlation.
        together, mass = np.zeros((v.shape[1],) * 2), np.full(v.shape[1], 1e-9)
        for side in (q < 0.5, q >= 0.5):
            if side.sum() > 20:
                d = v[side] - v[side].mean(axis=0)
                sd = np.sqrt((d * d).mean(axis=0)) + 1e-9
                r = (d.T @ d) / len(d) / np.outer(sd, sd)
                fires = v[side].sum(axis=0)
                together += np.where(r > WEAK, r, 0) * fires[:, None]
                mass += fires
        together /= mass[:, None]
        np.fill_diagonal(together, 0)
        say = 1 / (1 + together.sum(axis=1))
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        logit = math.log(prior / (1 - prior)) + v @ (say * np.log(fire[1] / fire[0])) + (1 - v) @ (say * np.log((1 - fire[1]) / (1 - fire[0])))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    return q, fire[1], fire[0], say


class Model:
    """Weights of terms and patterns; ``constant`` instead if there was nothing to learn."""

    def __init__(self, weights: dict[str, float], patterns: list[float], intercept: float, constant: float | None = None):
        self.weights, self.patterns, self.intercept, self.constant = weights, patterns, intercept, constant

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        # In a fixed order, so that a score doesn't depend on the order of a set.
        x = self.intercept + sum(self.weights[t] for t in sorted(terms_of(text, self.weights)))
        x += sum(w for w, on in zip(self.patterns, patterns_of(text), strict=True) if on)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    spark = docs.sparkSession
    chosen, n1, n0, f1, f0 = _sample(labels, doc_id, label)
    if not n1 or not n0:
        return Model({}, [], 0.0, float(n1 > 0))
    # At most MAX_TOXIC + MAX_CLEAN rows in expectation, so small enough to be sent to every scan.
    sample = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id"))
    terms = _select_terms(sample)
    if not terms:
        return Model({}, [], 0.0, n1 / (n1 + n0))
    own, lexicons = _voters(terms)
    vocabulary = [t for t, _, _ in terms] + [f"#{k}" for k in range(N_PATTERNS)]
    among = frozenset(vocabulary)

    def run(batch):
        out = [[*sorted(terms_of(t, among)), *(f"#{k}" for k, on in enumerate(patterns_of(t)) if on)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y").cast(pa.int32()), pa.array(out, pa.list_(pa.string()))], ["id", "y", "terms"])
    rows = written(in_arrow(sample.select(F.col("id").cast("string"), "y", "text"), run, "id string, y int, terms array<string>"))
    # Bounded: one short row for each distinct set of votes of the sample.
    cases = rows.groupBy(F.array_sort("terms").alias("terms"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    votes = np.zeros((len(cases), len(own) + len(lexicons) + N_PATTERNS + 1), np.int8)
    for r, case in enumerate(cases):
        held = set(case.terms)
        votes[r] = [*(t in held for t in own), *(not held.isdisjoint(x) for x in lexicons), *(f"#{k}" in held for k in range(N_PATTERNS)), case.y]
    times = np.array([c.n for c in cases])
    full = np.repeat(np.arange(len(cases)), times)
    q, _, _, _ = label_model(votes[full], np.where(votes[full, -1] > 0, 0.95, 0.05))
    posterior = np.zeros(len(cases))
    posterior[full] = q
    made = spark.createDataFrame(
        [(c.terms, float(y), float(c.n * w)) for c, p in zip(cases, posterior.tolist(), strict=True) for y, w in ((1, p), (0, 1 - p)) if c.n * w > 1e-6],
        "terms array<string>, label double, weight double")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    fitted = LogisticRegression(weightCol="weight", regParam=0.0001, elasticNetParam=0.0, maxIter=100, standardization=False).fit(vectors.transform(made))
    w = [float(x) for x in fitted.coefficients.toArray()]
    shift = math.log(f1 / f0)  # classes were drawn at different rates
    return Model(dict(zip(vocabulary[:-N_PATTERNS], w, strict=False)), w[-N_PATTERNS:], float(fitted.intercept) - shift)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]

    def run(batch):
        m = shared.value
        yield batch.append_column("score", pa.array([m.score(t.as_py()) for t in batch.column(text)], pa.float64()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    return in_arrow(docs.select(*[f"`{c}`" for c in kept]), run, schema + ", score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@apart("doc_id", "text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("score") < THRESHOLD).select(*docs.columns)


register("op10_toxicity", op10)
