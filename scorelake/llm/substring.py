"""Removal of word passages that occur earlier in the corpus (super-k-mer partitioning).

A window is 20 consecutive words. Its minimiser is the lowest hash of the runs of 4 words in it;
consecutive windows of a document that share the minimiser travel as one packed string to the
minimiser's bucket, about three bytes for each byte of text instead of twenty. In the bucket, sorted by minimiser,
windows are compared word for word, and every window that a smaller doc_id holds too is reported.
Repeats inside one document are found on the document itself, so a bucket only compares ids.

A first pass counts the minimisers; super-k-mers whose minimiser occurs once hold no repeated window
and stay where they are (a filter of bounded size tells most of them).

Runs of words that are very frequent in the corpus (found in bounded memory) are the last choice for
a minimiser, so no bucket gathers the surroundings of a common passage. Windows made of such runs
only are not sent to a bucket: their lowest id is found by an aggregate that is combined before the
shuffle, and the result, whose size is checked, is looked up when the documents are rewritten. This
changes the work, not the result.

Null and empty texts have no words. A null doc_id takes no part in comparisons between documents.
Rows that share a doc_id don't remove words from one another; within each row repeats are removed.
Other columns are ignored. Buckets are redone from the input when an executor is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import SLICE, bitset, frequent, gram_hashes, has_bit, in_arrow, mix, table, word_hashes, word_spans, written
from scorelake.llm.registry import register

WINDOW = 20
RUN = 4
#: Frequent runs that are avoided as minimisers; it changes the work, not the result.
KEEP = 1 << 14
#: Bytes of windows made of frequent runs that are looked up at once.
LOOKUP_BYTES = 32 << 20
#: Bits of the filter that thins the documents to be moved (2 MB), and the most bits of that which thins
#: the super-k-mers (64 MB). When more keys than bits are set they let all pass: more is moved, nothing is lost.
FILTER_BITS = 1 << 24
SHARED_BITS = 1 << 29

_TOP = np.uint64(1 << 63)


class Words:
    """Documents as their words joined by one space, in one buffer, with the words' places and hashes."""

    def __init__(self, texts: list[bytes]):
        norm = [b" ".join(t.split()) for t in texts]
        self.buffer = b"\n".join(norm)
        data = np.frombuffer(self.buffer, np.uint8)
        offsets = np.cumsum([0, *(len(t) + 1 for t in norm)])
        offsets[-1] = len(data)
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1."""
        return self.buffer[self.starts[a]:self.ends[b - 1]]


def word_runs(column: pa.Array):
    """First row and ``Words`` of runs of rows of bounded size."""
    texts, size, start = [], 0, 0
    for k, t in enumerate(column):
        t = (t.as_py() or "").encode("utf-8", "surrogatepass")
        texts.append(t)
        size += len(t)
        if size >= SLICE:
            yield start, Words(texts)
            texts, size, start = [], 0, k + 1
    if texts:
        yield start, Words(texts)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Lowest of each ``width`` consecutive values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def window_hashes(w: Words, window: int) -> np.ndarray:
    """A hash of the window that starts at each word, from those of its runs; equal windows have equal ones."""
    grams = gram_hashes(w.hashes, RUN)
    n = len(w.hashes) - window + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in [*range(0, window - RUN, RUN), window - RUN]:
        h = mix(h + grams[k:k + len(h)]) if len(h) else h
    return h


def minimisers(w: Words, hot: np.ndarray, window: int) -> np.ndarray:
    """The minimiser of the window that starts at each word (of the whole buffer)."""
    grams = gram_hashes(w.hashes, RUN)
    if len(grams) < window - RUN + 1:
        return np.zeros(0, np.uint64)
    order = mix(grams) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        order |= np.where(hot[at] == grams, _TOP, np.uint64(0))
    return window_minimum(order, window - RUN + 1)


def repeated(w: Words, h: np.ndarray, a: int, n: int, window: int) -> np.ndarray:
    """Which windows of the document (words a to a + n - 1) start earlier in it too. ``h``: ``window_hashes``."""
    count = n - window + 1
    out = np.zeros(max(count, 0), bool)
    if count < 2:
        return out
    h = h[a:a + count]
    in_order = np.sort(h)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(twice[at] == h).tolist():
        text = w.text(a + i, a + i + window)
        if text in seen:
            out[i] = True
        else:
            seen[text] = i
    return out


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


PIECES = "mini long, id long, row long, start int, packed binary"


def _super_kmers(batch, hot: np.ndarray, window: int):
    """Maximal runs of windows of a document with one minimiser, without windows that repeat in their
    document or consist of frequent runs: the words, and arrays of the row, minimiser, first and last window."""
    ids = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
    for first, w in word_runs(batch.column("text")):
        low = minimisers(w, hot, window)
        if not len(low):
            continue
        h = window_hashes(w, window)
        use = low < _TOP
        part = np.full(len(low), -1)
        for k in range(len(w.first) - 1):
            a, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
            if n >= window and ids[first + k]:
                part[a:a + n - window + 1] = first + k
                use[a:a + n - window + 1] &= ~repeated(w, h, a, n, window)
        use &= part >= 0
        change = np.flatnonzero((low[1:] != low[:-1]) | (use[1:] != use[:-1]) | (part[1:] != part[:-1])) + 1
        s, e = np.append(0, change), np.append(change, len(low))
        good = use[s]
        s, e = s[good], e[good]
        yield w, part[s], low[s], s, e, s - w.first[part[s] - first]


def _shared_minimisers(docs: DataFrame, hot, window: int, filter_bits: int) -> tuple[np.ndarray, int]:
    """A filter of the minimisers of more than one super-k-mer. What has another one occurs once in the corpus."""
    def run(batch):
        for _, _, mini, *_ in _super_kmers(batch, hot.value, window):
            yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64))], ["mini"])
    shared = written(in_arrow(docs, run, "mini long").groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mini"))
    bits = min(filter_bits, max(1 << 16, 16 * shared.count()))
    return bitset(shared.select(F.pmod(F.col("mini"), F.lit(bits)).alias("p")), bits), bits


def _pieces(docs: DataFrame, hot, shared, window: int) -> DataFrame:
    """Super-k-mers whose minimiser may be shared, packed."""
    def run(batch):
        words, bits = shared.value
        ids, rows = batch.column("id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy()
        for w, part, mini, s, e, start in _super_kmers(batch, hot.value, window):
            keep = has_bit(words, mini % np.uint64(bits))
            part, mini, s, e, start = part[keep], mini[keep], s[keep], e[keep], start[keep]
            lo, hi = w.starts[s].tolist(), w.ends[e - 2 + window].tolist()
            packed = [w.buffer[x:y] for x, y in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mini.view(np.int64)), pa.array(ids[part].astype(np.int64)), pa.array(rows[part]), pa.array(start.astype(np.int32)), pa.array(packed, pa.binary())],
                ["mini", "id", "row", "start", "packed"])
    return in_arrow(docs, run, PIECES)


def window_texts(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    at = np.cumsum([0, *(len(x) + 1 for x in words)]).tolist()
    return [packed[at[j]:at[j + window] - 1] for j in range(len(words) - window + 1)]


def _compare(rows: list[tuple[int, int, int, bytes]], window: int):
    """Of the super-k-mers of one bucket (id, row, start, packed): spans of windows that a smaller id holds too."""
    places: dict[bytes, list] = {}
    for i, row, start, packed in rows:
        places.setdefault(packed, []).append((i, row, start))
    lowest: dict[bytes, int] = {}
    texts = {}
    for packed, found in places.items():
        low = min(found)[0]
        texts[packed] = window_texts(packed, window)
        for t in texts[packed]:
            if lowest.get(t, low) >= low:
                lowest[t] = low
    for packed, found in places.items():
        low = np.array([lowest[t] for t in texts[packed]])
        for i, row, start in found:
            for s, e in zip(*spans_of(low < i), strict=True):
                yield i, row, start + int(s), start + int(e) - 1 + window


def _bucket_spans(pieces: DataFrame, window: int) -> DataFrame:
    def run(batches):
        group, mini, out = [], None, []

        def close():
            if len(group) > 1:
                out.extend(_compare(group, window))
            group.clear()

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:2]], *[pa.array(c, pa.int32()) for c in cols[2:]]],
                                              ["id", "row", "start", "stop"])
        for b in batches:
            minis = b.column("mini").to_numpy()
            cut = np.flatnonzero(minis[1:] != minis[:-1]) + 1
            edges = [0, *cut.tolist(), len(minis)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if minis[s] != mini:
                    close()
                    mini = minis[s]
                elif not group:
                    raise AssertionError("a bucket came apart")
                if e - s == 1 and s > 0 and e < len(minis):
                    continue  # alone in its bucket
                part = b.slice(s, e - s)
                group.extend(zip(*(part.column(c).to_pylist() for c in ("id", "row", "start", "packed")), strict=True))
            if len(out) > 20000:
                yield flush()
        close()
        if out:
            yield flush()
    return pieces.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, "id long, row long, start int, stop int")


def _common_windows(docs: DataFrame, hot, window: int) -> DataFrame:
    """Windows that consist of frequent runs only, with the lowest id that holds each."""
    def run(batches):
        lowest: dict[bytes, int] = {}

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(lowest), pa.binary()), pa.array(list(lowest.values()), pa.int64())], ["packed", "id"])
            lowest.clear()
            return rows
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, w in word_runs(batch.column("text")):
                low = minimisers(w, hot.value, window)
                for a in np.flatnonzero(low >= _TOP).tolist():
                    k = int(np.searchsorted(w.first, a, "right")) - 1
                    i = ids[first + k]
                    if a + window <= w.first[k + 1] and i is not None:
                        text = w.text(a, a + window)
                        if lowest.get(text, i) >= i:
                            lowest[text] = i
            if len(lowest) > 50000:
                yield flush()
        if lowest:
            yield flush()
    return docs.mapInArrow(run, "packed binary, id long").groupBy("packed").agg(F.min("id").alias("id"))


KEPT = "n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: int = KEEP,
                   lookup_bytes: int = LOOKUP_BYTES, filter_bits: int = SHARED_BITS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))

    def runs(batch):
        for _, w in word_runs(batch.column("text")):
            yield gram_hashes(w.hashes, RUN)
    keys, counts = frequent(docs, runs, keep)
    keys = keys[np.argsort(-counts, kind="stable")]
    while True:  # fewer frequent runs, if too many windows consist of them
        hot = spark.sparkContext.broadcast(np.sort(keys))
        common: dict[bytes, int] = {}
        if len(keys):
            found = written(_common_windows(docs, hot, window))
            if (found.agg(F.sum(F.octet_length("packed") + 100)).first()[0] or 0) > lookup_bytes:
                keys = keys[:len(keys) // 2]
                continue
            common = {bytes(r.packed): r.id for r in found.toLocalIterator()}
        break
    shared = spark.sparkContext.broadcast(_shared_minimisers(docs, hot, window, filter_bits))
    spans = written(_bucket_spans(_pieces(docs, hot, shared, window), window).groupBy("id", "row").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")))
    bits = spark.sparkContext.broadcast(bitset(spans.select(F.pmod(F.xxhash64("id", "row"), F.lit(FILTER_BITS)).alias("p")), FILTER_BITS))
    known = spark.sparkContext.broadcast(common)

    def rewritten(batch):
        ids, given = batch.column("id").to_pylist(), batch.column("spans").to_pylist()
        for first, w in word_runs(batch.column("text")):
            low = minimisers(w, hot.value, window) if known.value else None
            h = window_hashes(w, window)
            out = [[], [], [], []]
            for k in range(len(w.first) - 1):
                a, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
                gone = np.zeros(n, bool)
                i = ids[first + k]
                if n >= window:
                    starts = repeated(w, h, a, n, window)
                    if known.value and i is not None:
                        for s in np.flatnonzero((low[a:a + n - window + 1] >= _TOP) & ~starts).tolist():
                            starts[s] = known.value[w.text(a + s, a + s + window)] < i
                    for s, e in zip(*spans_of(starts), strict=True):
                        gone[s:e - 1 + window] = True
                    for span in given[first + k] or ():
                        gone[span["start"]:span["stop"]] = True
                parts = [w.text(a + int(s), a + int(e)) for s, e in zip(*spans_of(~gone), strict=True)]
                out[0].append(i)
                out[1].append(n)
                out[2].append(int(gone.sum()))
                out[3].append(b" ".join(parts).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    def chosen(hit: bool):
        def run(batch):
            mask = has_bit(bits.value, batch.column("p").to_numpy()) == hit
            yield batch.select(["id", "row", "text"]).filter(pa.array(mask))
        return in_arrow(docs.withColumn("p", F.pmod(F.xxhash64("id", "row"), F.lit(FILTER_BITS))), run, "id long, row long, text string")
    none = F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans")
    touched = chosen(True).join(spans, ["id", "row"], "left")
    out = "doc_id long, " + KEPT
    return in_arrow(touched.select("id", "text", "spans"), rewritten, out).union(
        in_arrow(chosen(False).select("id", "text", none), rewritten, out))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS t
            FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

register("op5_substring_dedup", op5, SQL)
