"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import BATCH_BYTES, cut_lineage, small_batches  # noqa: F401

#: Bytes of text that one numpy step works on; a single longer text is one step of its own.
SLICE = 1 << 20
#: Short rows that make a task worth while, and the tasks that a small table is left in at least.
ROWS_A_TASK, LEAST_TASKS = 1 << 14, 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again."""
    return cut_lineage(df)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most about ``rows`` short rows in no more tasks than these need: each task of a small table leaves
    several files behind, in its table or its shuffle. Their number grows with the rows."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_A_TASK)))


def apart(*used: str) -> Callable:
    """A pipeline stage to which only the columns ``used`` are known by name. All others travel under reserved names, so
    that none meets a column of the stage, and come back as they were. A column that the stage adds gets ``mix_``
    before its name if the documents have one of that name already."""
    def wrap(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            inner = [c if c in used else f"__kept_{k}" for k, c in enumerate(docs.columns)]
            out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]), sf_dir)
            taken = {c.lower() for c in docs.columns}
            added = [c for c in out.columns if c not in inner]
            return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)],
                              *[F.col(c).alias(f"mix_{c}" if c.lower() in taken else c) for c in added])
        return run
    return wrap


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch; it yields batches of ``schema``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A string column in runs of rows of about ``most`` bytes: first row, row
    after the last, their bytes, their offsets in these. A null has no bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of the first word of each row
    (with one more entry at the end). Words don't reach over rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in steps of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, from their hashes; it depends on ``k`` too."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h + words[i:i + n] * np.uint64(2 * i + 3))
    return h


class Frequent:
    """The most frequent of a stream of hashes, in bounded memory. Runs of ``CHUNK`` hashes are counted;
    those that occur once in a run are left out, and the rarest when more than ``keep`` are held. A hash that
    makes up several times ``1 / keep`` of the stream is among them, with a count that may be somewhat low."""

    CHUNK = 1 << 22

    def __init__(self, keep: int):
        self.keep, self.keys, self.counts, self.seen, self.held, self.size = keep, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size >= self.CHUNK:
            self.count()

    def count(self) -> None:
        if not self.size:
            return
        new = np.concatenate(self.held)
        self.seen += self.size
        self.held, self.size = [], 0
        new.sort()
        # Most hashes occur once and are left out before anything else is made of them.
        twice = np.zeros(len(new), bool)
        twice[1:] = new[1:] == new[:-1]
        twice[:-1] |= twice[1:]
        new = new[twice]
        at = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if len(new) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(new)))
        keys, where = np.unique(np.concatenate([self.keys, new[at]]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([self.counts, n]), len(keys)).astype(np.int64)
        if len(keys) > self.keep:
            floor = np.partition(counts, len(counts) - self.keep - 1)[len(counts) - self.keep - 1]
            counts = counts - floor
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def frequent(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that make up more than about ``2 / keep`` of all, at most ``keep`` of them,
    ascending, with their counts. Each task gives a summary of bounded size."""
    def run(batches):
        top = Frequent(keep)
        for b in batches:
            for h in hashes(b):
                top.add(h)
        top.count()
        strong = top.counts * keep >= top.seen
        keys, counts = top.keys[strong], top.counts[strong]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(counts, 0)),
             pa.array(np.append(np.zeros(len(keys), np.int64), top.seen))], ["key", "n", "seen"])
    found = written(df.mapInArrow(run, "key long, n long, seen long"))
    total = found.agg(F.sum("seen")).first()[0] or 0
    rows = (found.where("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
            .where(F.col("n") * keep >= F.lit(2 * total)).toArrow())  # their number is below keep / 2
    keys, counts = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def bitset(positions: DataFrame, bits: int) -> np.ndarray:
    """A set of bit positions (column ``p``, below ``bits``) as an array of 64-bit words.
    Its size is fixed by ``bits``, whatever the number of rows."""
    words = positions.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    out = np.zeros((bits + 63) // 64, np.int64)
    for chunk in words.select("w", "v").toArrow().to_batches():
        out[chunk.column(0).to_numpy()] = chunk.column(1).to_numpy()
    return out.view(np.uint64)


def has_bit(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    positions = positions.astype(np.uint64)
    return (words[(positions >> np.uint64(6)).astype(np.int64)] >> (positions & np.uint64(63))) & np.uint64(1) > 0
