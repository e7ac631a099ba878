"""Quality by divergence from the language: histograms of character classes and of common words, held against
those of the document's language by Jensen-Shannon distance. All of it is column code.

Base rules: fewer than 20 words, or more than 30 % of the words in 8-word windows that occur twice.

References: for each language, the mean share of each character class over all documents of
``CLASS_CHARS`` characters, and, over all documents of ``WORD_WORDS`` words, the ``COMMON`` most frequent words (lower-cased runs of letters and of characters
outside ASCII) with their shares. A language of fewer than ``LEAST_DOCS`` such documents, and a null one, is held
against the documents of all languages together.

Verdict: a document is kept if its classes lie within ``CLASS_LIMIT`` of the reference and its words within
``WORD_LIMIT`` plus what chance adds to the distance of a sample of that length. Both need a least length: below ``CLASS_CHARS`` characters
or ``WORD_WORDS`` words that comparison is left out.

Repeated windows are found by 64-bit hashes within one document. Nulls: a null text has no words and is not kept. Empty texts likewise. Repeated rows are
judged row by row; ties in frequency go to the lesser word. An empty table gives no rows. Other columns pass through, but for those
that have the name of a result, which takes their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import table, written
from scorelake.llm.registry import register

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
COMMON = 100
LEAST_DOCS = 20
CLASS_CHARS, WORD_WORDS = 100, 50
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.1
#: Buckets of common words in a reference; a word is looked for in its own only.
BUCKETS = 256
#: Languages whose references travel to all executors; with more of them the references are joined by language.
SENT = 2000

#: What stands between words, and between runs of letters.
SPACES = r"[\x20\x09-\x0D]+"
OTHERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SYMBOLS = r"[#*$%&|<>]"
#: Taken out one after the other; what is left is symbols.
CLASSES = {"lower": "[a-z]+", "space": r"[\x20\x09-\x0D]+", "beyond": r"[^\x00-\x7F]+", "upper": "[A-Z]+", "digit": "[0-9]+", "stop": r"""[.,;:!?'"()-]+"""}


RESULTS = {"chars", "classes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_letter_words",
           "class_distance", "word_distance", "kept"}


def _words(text: Column | str, between: str) -> Column:
    return F.coalesce(F.array_remove(F.split(text, between), ""), F.array().cast("array<string>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once for each row, however often and deep ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def window_keys(words: str) -> Column:
    """A hash of each window of ``WINDOW`` (a power of two) words, from those of its halves."""
    def doubled(span: int) -> Callable[[Column], Column]:
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + span)))
    keys, n, span = F.transform(words, lambda w: F.xxhash64(w)), F.size(words), 1
    while span < WINDOW:
        keys, span = _let(keys, doubled(span)), 2 * span
    return F.when(n > WINDOW, F.slice(keys, 1, n - WINDOW + 1)).otherwise(F.array().cast("array<long>"))


def repeated_words(keys: str) -> Column:
    """Words in windows that occur twice or more. A text whose windows all differ ends after one pass through a
    hash set; else equal windows stand side by side in key order, and those with a neighbour are put in text order."""
    def starts(s: Column) -> Column:
        twin = lambda x, j: F.when((F.get(s, j - 1)["k"] == x.k) | (F.get(s, j + 1)["k"] == x.k), x.i)
        return F.sort_array(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))
    covered = _let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), lambda s: F.aggregate(
        starts(s), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda t, i: F.struct((t.n + F.least(F.lit(WINDOW), i - t["last"])).alias("n"), i.alias("last")), lambda t: t.n))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered).otherwise(0)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``chars``, ``classes`` (characters of each class), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    df = docs.withColumn("__words", _words(text, SPACES)).withColumn("__lines", lines)
    df = df.withColumn("__keys", window_keys("__words"))
    df = class_counts(df, text).select(*docs.columns, "chars", "classes", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
                   "n_symbols",
                   long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), long(repeated_words("__keys")).alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def class_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``chars``, ``classes`` (characters of each class) and ``n_symbols``, all of which stand in the last class."""
    kept, left = df.columns, df.withColumn("__0", F.coalesce(F.col(text), F.lit("")))
    for k, pattern in enumerate(CLASSES.values()):
        left = left.withColumn(f"__{k + 1}", F.regexp_replace(f"__{k}", pattern, ""))
    n = len(CLASSES)
    counts = [F.length(f"__{k}") - F.length(f"__{k + 1}") for k in range(n)] + [F.length(f"__{n}")]
    return left.select(*kept, F.length("__0").cast("long").alias("chars"), F.array(*counts).alias("classes"),
                       F.regexp_count(f"__{n}", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def letter_words(text: Column | str) -> Column:
    return _words(F.lower(text), OTHERS)


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def references(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> DataFrame:
    """A row for each language with ``LEAST_DOCS`` documents of ``CLASS_CHARS`` characters, and one with a null language for
    all: ``lang``, ``class_shares``, ``words`` (buckets of common words) and ``word_shares`` (theirs)."""
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    shares = [(F.col("classes")[k] / F.col("chars")).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    sums = written(class_counts(own.where(F.length("text") >= CLASS_CHARS), "text").select("lang", *shares).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(CLASSES) + 1)]))
    words = own.select("lang", letter_words("text").alias("w")).where(F.size("w") >= WORD_WORDS)
    counts = written(words.select("lang", F.explode("w").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    enough = sums.where(F.col("lang").isNotNull() & (F.col("n") >= LEAST_DOCS)).select("lang")
    both = lambda df, *keys: df.join(F.broadcast(enough) if enough.count() <= SENT else enough, "lang").unionByName(
        df.withColumn("lang", F.lit(None).cast("string")).groupBy("lang", *keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in ("lang", *keys)]))
    classes = both(sums).select("lang", F.array(*[F.col(f"c{k}") / F.col("n") for k in range(len(CLASSES) + 1)]).alias("class_shares"))
    words = written(both(counts, "word"))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= common)
    entries = top.withColumn("slot", _slot(F.col("word"))).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("slot", "word", "n"))).alias("e"))
    told = entries.alias("a").join(total.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select(F.col("a.lang").alias("lang"), "e", "total")
    bucket = lambda of: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda s: F.transform(F.filter("e", lambda x: x.slot == s), of))
    told = told.select("lang", bucket(lambda x: x.word).alias("words"), bucket(lambda x: x.n / F.col("total")).alias("word_shares"))
    return classes.alias("a").join(told.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").select(
        F.col("a.lang").alias("lang"), "class_shares", "words", "word_shares")


def _half(p: Column, q: Column) -> Column:
    """What one entry adds to twice the Jensen-Shannon divergence in bits."""
    one = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return one(p, q) + one(q, p)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice, F.lit(0.0)) / 2)


def distances(df: DataFrame, refs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``df`` (with ``chars`` and ``classes``) with ``n_letter_words``, ``class_distance`` and ``word_distance``."""
    kept = df.columns
    own = refs.where("lang IS NOT NULL").select(F.col("lang").alias("__lang"), F.struct("class_shares", "words", "word_shares").alias("__own"))
    whole = refs.where("lang IS NULL").select(F.struct("class_shares", "words", "word_shares").alias("__all"))
    small = refs.count() <= SENT
    df = df.withColumn("__w", letter_words(text))
    df = df.join(F.broadcast(own) if small else own, F.col(lang).cast("string") == F.col("__lang"), "left").join(F.broadcast(whole), how="left")  # one row
    df = df.withColumn("__ref", F.coalesce("__own", "__all"))
    bucket = lambda w: F.col("__ref.words")[_slot(w)]
    place = F.transform(F.filter("__w", lambda w: F.array_contains(bucket(w), w)), lambda w: F.array_position(bucket(w), w).cast("int") * BUCKETS + _slot(w))
    df = df.withColumn("n_letter_words", F.size("__w").cast("long"))
    share = lambda b: F.col("__ref.word_shares")[F.pmod(b, F.lit(BUCKETS))][(b / BUCKETS).cast("int") - 1]

    def hist(b: Column) -> Column:  # in sorted bins a count is the distance of two ends
        ends = F.filter(F.transform(b, lambda x, j: F.when(F.get(b, j + 1).isNull() | (F.get(b, j + 1) != x), j)), lambda j: j.isNotNull())
        one = lambda e: lambda j, k: F.struct(((j - F.coalesce(F.get(e, k - 1), F.lit(-1))) / F.col("n_letter_words")).alias("p"), share(b[j]).alias("q"))
        return _let(ends, lambda e: F.transform(e, one(e)))
    df = df.withColumn("__hist", _let(F.sort_array(place), hist))
    zero = F.lit(0.0)
    total = lambda of: F.aggregate("__hist", zero, lambda s, x: s + of(x))
    common = F.aggregate(F.flatten("__ref.word_shares"), zero, lambda s, x: s + x)
    seen = total(lambda x: x.q)
    other = _half(F.greatest(1 - total(lambda x: x.p), zero), F.greatest(1 - common, zero))
    words = total(lambda x: _half(x.p, x.q)) + (common - seen) + other  # an absent word adds its share
    classes = F.aggregate(F.zip_with("classes", "__ref.class_shares", lambda c, q: _half(c / F.col("chars"), q)), zero, lambda s, x: s + x)
    return df.select(*kept, "n_letter_words", F.when(F.col("chars") > 0, _distance(classes)).alias("class_distance"),
                     F.when(F.col("n_letter_words") > 0, _distance(words)).alias("word_distance"))


def allowance(n: Column, common: int = COMMON) -> Column:
    """What chance adds to the word distance of a sample of ``n`` words: the root of the expected divergence."""
    return F.sqrt(F.lit(common / 8 / 0.6931471805599453) / F.greatest(n, F.lit(1)))


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", refs: DataFrame | None = None) -> DataFrame:
    """The columns of ``base`` and ``distances`` with ``kept``, beside those of ``docs``."""
    judged = base(docs, text)
    refs = written(references(docs, lang, text)) if refs is None else refs
    told = distances(judged, refs, lang, text)
    classes = (F.col("chars") < CLASS_CHARS) | (F.col("class_distance") <= CLASS_LIMIT)
    words = (F.col("n_letter_words") < WORD_WORDS) | (F.col("word_distance") <= WORD_LIMIT + allowance(F.col("n_letter_words")))
    return told.withColumn("kept", ~F.col("base_failed") & F.coalesce(classes, F.lit(True)) & F.coalesce(words, F.lit(True)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                              F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT no, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k FROM (SELECT no, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT no, count(DISTINCT p) AS n FROM (SELECT no, unnest(range(i, i + 8)) AS p FROM (SELECT no, i, count(*) OVER (PARTITION BY no, k) AS c FROM win) WHERE c > 1) GROUP BY 1),
base AS (SELECT w.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN rep USING (no)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
c1 AS (SELECT no, t, regexp_replace(t, '[a-z]+', '', 'g') AS t1 FROM judged),
c2 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM c1),
c3 AS (SELECT *, regexp_replace(t2, '[^\x00-\x7F]+', '', 'g') AS t3 FROM c2),
c4 AS (SELECT *, regexp_replace(t3, '[A-Z]+', '', 'g') AS t4 FROM c3),
c5 AS (SELECT *, regexp_replace(t4, '[0-9]+', '', 'g') AS t5 FROM c4),
c6 AS (SELECT *, regexp_replace(t5, '[.,;:!?''"()-]+', '', 'g') AS t6 FROM c5),
shares AS (SELECT no, length(t) AS chars, unnest(range(7)) AS c, unnest([length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3),
                  length(t3) - length(t4), length(t4) - length(t5), length(t5) - length(t6), length(t6)]) / length(t) AS p FROM c6 WHERE length(t) > 0),
lw AS (SELECT no, lang, regexp_extract_all(lower(t), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM judged),
tf AS (SELECT no, lang, n_letters, word, count(*) AS n FROM (SELECT no, lang, len(w) AS n_letters, unnest(w) AS word FROM lw) GROUP BY ALL),
known AS (SELECT lang FROM judged WHERE length(t) >= 100 AND lang IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
refc AS (SELECT lang AS ref, c, avg(p) AS q FROM shares JOIN judged USING (no) JOIN known USING (lang) WHERE chars >= 100 GROUP BY ALL
         UNION ALL SELECT NULL, c, avg(p) FROM shares JOIN judged USING (no) WHERE chars >= 100 GROUP BY ALL),
counts AS (SELECT lang AS ref, word, sum(n) AS n FROM tf JOIN known USING (lang) WHERE n_letters >= 50 GROUP BY ALL
           UNION ALL SELECT NULL, word, sum(n) FROM tf WHERE n_letters >= 50 GROUP BY ALL),
refw AS (SELECT ref, word, q FROM (SELECT ref, word, n / sum(n) OVER (PARTITION BY ref) AS q, row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) AS r FROM counts) WHERE r <= 100),
refq AS (SELECT ref, sum(q) AS q FROM refw GROUP BY 1),
own AS (SELECT no, known.lang AS ref, len(w) AS n FROM lw LEFT JOIN known USING (lang)),
seen AS (SELECT no, sum(p) AS p, sum(q) AS q, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) AS h
         FROM (SELECT no, tf.n / own.n AS p, q FROM own JOIN tf USING (no) JOIN refw ON refw.word = tf.word AND refw.ref IS NOT DISTINCT FROM own.ref) GROUP BY 1),
wrest AS (SELECT no, own.n, coalesce(h, 0) AS h, greatest(1 - coalesce(seen.p, 0), 0) AS po, greatest(1 - refq.q, 0) AS qo, refq.q - coalesce(seen.q, 0) AS unseen
          FROM own JOIN refq ON refq.ref IS NOT DISTINCT FROM own.ref LEFT JOIN seen USING (no) WHERE own.n > 0),
wd AS (SELECT no, sqrt(greatest(h + unseen + CASE WHEN po > 0 THEN po * log2(2 * po / (po + qo)) ELSE 0 END + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (po + qo)) ELSE 0 END, 0) / 2) AS word_distance FROM wrest),
cd AS (SELECT no, any_value(chars) AS chars, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 0) / 2) AS class_distance
       FROM shares JOIN own USING (no) JOIN refc ON refc.ref IS NOT DISTINCT FROM own.ref AND refc.c = shares.c GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(chars < 100 OR class_distance <= 0.3, true)
         AND coalesce(own.n < 50 OR word_distance <= 0.1 + sqrt(100 / 8 / 0.6931471805599453 / greatest(own.n, 1)), true) AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged JOIN own USING (no) LEFT JOIN cd USING (no) LEFT JOIN wd USING (no)
"""

register("op12_divergence", op12, SQL)
