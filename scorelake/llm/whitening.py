"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never squared into a covariance. A step sends a vector w of the entries' space to the
rows, takes Xw row by row, and adds up what goes back: XᵀXw, the products of Xw with all earlier left
vectors, and its square. Left vectors are kept as u = Xw, by their w, so a task makes its part of them again from
its rows, and a lost executor costs nothing but its tasks. Both sides are orthogonalised in full: u against all earlier u, with
a second round through the rows where the first took much away, v against all earlier v. When a new v vanishes, all
that the start could reach is found; the search goes on with a vector orthogonal to all so far, so repeated
singular values are found too. The singular value decomposition of the small bidiagonal matrix gives the components (right
vectors) and the deviations along them (singular values over the root of n).

Steps go on until the wanted singular values have settled (by the residuals of the small problem), or the space is exhausted. Each step
sends the driver a few numbers per dimension; neither rows nor a row's coordinate is collected.

An entry c becomes floor(64 * c) + 1000000. A vector takes part if it is not null and not empty, all its entries are
finite and below 2**40, and it has the most common length (the longer one on a tie): others have no place in
one covariance. Repeated ids and vectors count row by row; a null id stays null. Components whose variance is
not above 1e-12 of the greatest can't be scaled to one and are left out, so equal vectors, a single one or an empty table give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import table
from scorelake.llm.registry import register

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 40)
#: Rows that one step of numpy works on.
ROWS = 2048
#: A residual this small, against the greatest singular value, is settled; components below ``RANK`` of the greatest variance have no scale.
SETTLED, RANK = 1e-13, 1e-12


def _vectors(column: pa.Array, dim: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers of their entries) of the rows that take part, some rows at a time; of any one length if ``dim`` is None."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    for a in range(0, len(column), ROWS):
        for d in [dim] if dim else np.unique(size[a:a + ROWS][valid[a:a + ROWS]]):
            rows = a + np.flatnonzero(valid[a:a + ROWS] & (size[a:a + ROWS] == d))
            if not d or not len(rows):
                continue
            flat = column.values.take(pa.array((offsets[rows][:, None] + np.arange(d)).ravel()))
            c = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), d)  # a null entry becomes NaN
            good = (np.abs(c) < LARGEST).all(axis=1)
            if good.any():
                yield rows[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def _sums(df: DataFrame, task, width: int) -> np.ndarray:
    """The sum over all rows of what ``task`` gives for their blocks of vectors, an array of ``width`` numbers."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            total += task(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "v"])
    out = np.zeros(width)
    got = df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # width rows
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


class Fit:
    """``n`` vectors of ``dim`` entries with per-entry sums ``sums``; ``components`` by column, variances ``values``,
    ``share`` of these in all variance, ``steps`` taken."""

    def __init__(self, dim: int, n: int, sums: np.ndarray):
        self.dim, self.n, self.sums = dim, n, sums
        self.components, self.values, self.share, self.steps, self.identity_error = np.zeros((dim, 0)), np.zeros(0), np.zeros(0), 0, 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(float) / self.n

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        small = self.n * int(np.abs(x).max(initial=0)) < 1 << 62
        return self.n * x - self.sums if small else self.n * x.astype(object) - self.sums.astype(object)

    def deviation(self, x: np.ndarray) -> list[int]:
        far = self.exact(x)
        if far.dtype == object or self.dim * float(np.abs(far).max(initial=0)) ** 2 > 1 << 62:
            far = far.astype(object)
        return [int(s) for s in (far * far).sum(axis=1)]


def _start(df: DataFrame) -> Fit | None:
    """The length that takes part, and its exact sums."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _vectors(batch.column("v"), None):
                s = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                s[0] += len(x)
                s[1] += x.sum(axis=0)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int64)), pa.array(np.arange(d)), pa.array(np.full(d, n, np.int64)), pa.array(s)],
                                             ["dim", "i", "n", "s"])
    sums = df.mapInArrow(run, "dim long, i long, n long, s long").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = sums.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    rows = sums.where(F.col("dim") == most.dim).orderBy("i").select("s").collect()  # one for each dimension
    return Fit(most.dim, most.n, np.array([r.s for r in rows], np.int64))


def _product(df: DataFrame, fit: Fit, w: np.ndarray, left: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """For r = Xw: its square, its products with the left vectors X ``left``, and Xᵀr."""
    k = left.shape[1]

    def task(batch):
        out = np.zeros(1 + k + fit.dim)
        for _, x in _vectors(batch.column("v"), fit.dim):
            x = fit.centred(x)
            r = x @ w
            out[0] += r @ r
            out[1:1 + k] += r @ (x @ left)
            out[1 + k:] += r @ x
        return out
    got = _sums(df, task, 1 + k + fit.dim)
    return got[0], got[1:1 + k], got[1 + k:]


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(df: DataFrame, fit: Fit, wanted: int) -> None:
    """Fill in the components of ``fit``. ``df`` has the vectors in column ``v``."""
    d = fit.dim
    r = np.random.default_rng(1)
    v = r.standard_normal(d)
    right, left, back = (np.zeros((d, 0)) for _ in range(3))  # v; w of u = Xw; Xᵀu
    small = np.zeros((d, d))
    beta, rank, top = 0.0, min(wanted, d, fit.n - 1), 0.0
    for k in range(d):
        v = _orthogonal(v / np.linalg.norm(v), right)
        v /= np.linalg.norm(v)
        w = v - beta * left[:, -1] if beta else v
        square, c, xr = _product(df, fit, w, left)
        w, xr, rest = w - left @ c, xr - back @ c, square - c @ c
        if c @ c > 1e-8 * square:  # much was taken away: once more through the rows
            square, c, xr = _product(df, fit, w, left)
            w, xr, rest = w - left @ c, xr - back @ c, square - c @ c
        alpha = np.sqrt(max(rest, 0.0))
        top = max(top, alpha, beta)
        right = np.column_stack([right, v])
        if beta:
            small[k - 1, k] = beta
        if alpha <= 1e-13 * top:  # nothing left along v: it is a null direction as far as doubles tell
            alpha, left, back = 0.0, np.column_stack([left, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
            v, beta = np.zeros(d), 0.0
        else:
            left, back = np.column_stack([left, w / alpha]), np.column_stack([back, xr / alpha])
            v = _orthogonal(back[:, -1] - alpha * right[:, -1], right)
            beta = float(np.linalg.norm(v))
        small[k, k] = alpha
        fit.steps = k + 1
        if k + 1 < d and beta <= 1e-13 * top:  # all that the start reaches is found
            beta, v = 0.0, _orthogonal(r.standard_normal(d), right)
        elif k + 1 >= rank:
            p, s, _ = np.linalg.svd(small[:k + 1, :k + 1])
            if k + 1 >= rank + 8 and (beta * np.abs(p[-1, :rank]) <= SETTLED * s[0]).all():
                break
    k = fit.steps
    _, s, q = np.linalg.svd(small[:k, :k])
    values = s ** 2 / fit.n
    some = min(rank, int((values > RANK * values[0]).sum())) if rank > 0 and values[0] > 0 else 0
    fit.components, fit.values = (right @ q.T)[:, :some], values[:some]


def _spread(df: DataFrame, fit: Fit) -> None:
    """All variance, and how far the covariance of the whitened vectors is from the identity."""
    k, scale = len(fit.values), fit.components / np.sqrt(fit.values)

    def task(batch):
        out = np.zeros(1 + k + k * k)
        for _, x in _vectors(batch.column("v"), fit.dim):
            x = fit.centred(x)
            z = x @ scale
            out[0] += (x * x).sum()
            out[1:1 + k] += z.sum(axis=0)
            out[1 + k:] += (z.T @ z).ravel()
        return out
    got = _sums(df, task, 1 + k + k * k) / fit.n
    fit.share = fit.values / got[0]
    mean = got[1:1 + k]
    fit.identity_error = float(np.abs(got[1 + k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The whitening of the vectors, or None where there are none."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    found = _start(rows)
    if found is not None and found.n > 1:
        bidiagonalise(rows, found, components)
        if len(found.values):
            _spread(rows, found)
    return found


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, model: Fit | None = None) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation (exact), whitened, explained, identity_error."""
    model = fit(df, vector, components) if model is None else model
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if model is None or not len(model.values):
        return rows.limit(0).selectExpr("id AS vec_id", "1 AS component", "0L AS n", "CAST(0 AS decimal(38,0)) AS deviation", "0D AS whitened",
                                        "0D AS explained", "0D AS identity_error")
    k, scale = len(model.values), model.components / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            for at, x in _vectors(batch.column("v"), model.dim):
                z = model.centred(x) @ scale
                rows = len(at)
                each = np.repeat(np.arange(rows), k)
                far = pa.array([Decimal(s) for s in model.deviation(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, model.n, np.int64)), far.take(pa.array(each)), pa.array(z.ravel()),
                     pa.array(np.tile(model.share, rows)), pa.array(np.full(rows * k, model.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, WHITENED)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


register("op13_lanczos_whitening", op13)
