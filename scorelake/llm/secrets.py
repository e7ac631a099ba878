"""Secret scan: candidates by their shape, false positives removed by a random forest.

DataFrame and SQL functions and Spark ML only. A candidate is a run of 16 or more letters, digits and
``+/_=-`` that has a digit or mixes cases, or that is assigned to the name of a credential; of an unspaced ``name=value`` it is
the value. Its features are
the length, how often the kind of character changes, shares of digits, hexadecimal digits and capitals, the number of
different characters, the part of it that words of a dictionary cover, signs of a path around it, and the
words before and after. The dictionary is that of the corpus: its most frequent words.

The forest is trained on labelled findings. ``findings`` may be given (doc_id, candidate, is_secret). Without them
the scan labels its own in a bounded sample. A secret is a value of random look that is assigned to the name of a credential
(quoted or not) or follows ``Bearer`` or ``Basic`` of such a header, and a token of a known format wherever it stands. Not a secret is what has none
of the signs around it, or is called a hash and not a credential. What has some of the signs only is doubtful and
left out. The forest sees each of its own labels a second time without the signs that made it, so it learns the look of the value
and the other features too; with labels from people it sees them once.

Null and empty texts have no findings. Every occurrence in every row is one finding; equal findings of a text are told apart by their
word number. Without labels of both kinds every finding keeps the share of secrets among the labels as its score
(0 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import table, written
from scorelake.llm.registry import register

#: Labelled findings of each kind to learn from, and words of the dictionary.
MAX_LABELS = 10_000
DICTIONARY = 400
TREES, DEPTH = 24, 6

SHAPE = r"[A-Za-z0-9+/_=-]{16,}"
#: A whole run, but for a name and the sign of assignment at its start.
VALUE = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z_-][A-Za-z0-9_-]*=(?=[A-Za-z0-9+/_-]))?([A-Za-z0-9+/_=-]{16,})"
NAMES = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
#: Directly before a value: an assignment; the scheme of an authorization header.
DIRECT = r"(?:[=:]>?\s*[\"'`(\[]*|(?i:\b(?:bearer|basic))\s+[\"'`]?)$"
#: Formats of tokens that are known by their first letters.
KNOWN = (r"^(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|sk-(?:ant-\w+-|proj-)?\w{20,}|"
         r"xox[abeoprs]-[A-Za-z0-9-]{10,}|(?:AKIA|ASIA)[0-9A-Z]{16}$|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{20,}|hf_[A-Za-z0-9]{20,}|"
         r"shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}|dop_v1_[0-9a-f]{40,}|eyJ[A-Za-z0-9_-]{14,})")
#: More consonants in a row than words have.
UNSPOKEN = "(?i)[bcdfghjklmnpqrstvwxz]{5,}"
_SCALE = 1 << 40

FEATURES = ["length", "changes", "digits", "hex", "capitals", "different", "covered", "dashes", "slashes", "dotted", "path_before",
            "named", "assigned", "quoted", "direct", "known", "unspoken", "hash_before", "word_after", "plain_before"]
#: Features that the own labels are made of.
SIGNS = ["named", "assigned", "quoted", "direct", "known"]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: ``doc_id``, ``word`` (its number, from 0), ``part``, ``candidate``, and the words around."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+").alias("w"))
    # Few words are long enough, so only these are looked at any further.
    long = F.filter(F.transform("w", lambda x, i: F.when(F.length(x) >= 16, F.struct(
        i.alias("word"), x.alias("x")))), lambda s: s.isNotNull() & s.x.rlike(SHAPE))
    each = words.select("doc_id", "w", F.explode(long).alias("s"))
    at = lambda k: F.coalesce(F.try_element_at("w", F.col("s.word") + 1 + k), F.lit(""))
    before = F.when(F.col("s.word") > 0, at(-1)).otherwise("")
    earlier = F.when(F.col("s.word") > 1, at(-2)).otherwise("")
    runs = each.select("doc_id", F.col("s.word").alias("word"), F.col("s.x").alias("whole"), earlier.alias("earlier"), before.alias("before"), at(1).alias("after"),
                       F.posexplode(F.regexp_extract_all("s.x", F.lit(VALUE), F.lit(1))).alias("part", "candidate"))
    mixed = F.col("candidate").rlike("[0-9]") | (F.col("candidate").rlike("[a-z]") & F.col("candidate").rlike("(?s).[A-Z]"))
    return runs.where(mixed | (_context().rlike(NAMES) & _before().rlike(DIRECT)))


def _lead() -> Column:
    return F.expr("substring_index(whole, candidate, 1)")


def _before() -> Column:
    return F.concat_ws(" ", "before", _lead())


def _context() -> Column:
    return F.concat_ws(" ", "earlier", "before", _lead())


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 4 to 12 letters, by the number of rows that hold them."""
    words = docs.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+"), lambda w: F.length(w).between(4, 12)))).alias("w"))
    return [r.w for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda kind: F.regexp_count(c, F.lit(kind)) / n
    lead, context = _lead(), _context()
    covered = F.lit(0.0)
    if words:
        # Longest first, so that a word isn't covered by a shorter one only.
        either = "|".join(sorted(words, key=lambda w: (-len(w), w)))
        covered = (n - F.length(F.regexp_replace(F.lower(c), either, ""))) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.withColumns({
        "length": n,
        "changes": F.regexp_count(c, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[+/_=-](?=[^+/_=-])")) / n,
        "digits": share("[0-9]"), "hex": share("[0-9a-fA-F]"), "capitals": share("[A-Z]"),
        "different": F.size(F.array_distinct(F.split(c, ""))).cast("double"),
        "covered": covered, "dashes": share("[_-]"), "slashes": share("/"), "dotted": flag(F.col("whole").rlike(r"[.][A-Za-z0-9]{1,5}$|[.]\w+[/]")),
        "path_before": flag(lead.rlike(r"[/\\.:]\S*$") & lead.rlike(r"[/\\]")),
        "named": flag(context.rlike(NAMES)), "assigned": flag(_before().rlike(r"[=:]\s*[\"'`]?$|[=:]")),
        "direct": flag(_before().rlike(DIRECT)), "known": flag(c.rlike(KNOWN) & c.rlike("[0-9]")), "unspoken": flag(c.rlike(UNSPOKEN)),
        "quoted": flag(lead.rlike("[\"'`]$")), "hash_before": flag(context.rlike(r"(?i)\b(sha\d*|md5|commit|checksum|digest|hash|rev|uuid|etag)\b")),
        "word_after": flag(F.col("after").rlike("^[A-Za-z]+[.,]?$")), "plain_before": flag(F.col("before").rlike("^[A-Za-z]+[.,]?$"))})


def own_labels(found: DataFrame) -> DataFrame:
    """``found`` (with features) with ``is_secret`` by the rule of the module, null where doubtful."""
    on = lambda c: F.col(c) > 0
    look = ((F.col("changes") > 0.2) | on("unspoken")) & (F.col("different") >= 8) & (F.col("covered") < 0.4)
    secret = on("known") | (on("named") & on("direct") & look & ~on("hash_before"))
    other = ~on("named") & (on("hash_before") | ~look | ~(on("assigned") | on("quoted")))
    return found.withColumn("is_secret", F.when(secret, 1).when(other, 0))


def train(labelled: DataFrame, blank: bool = False):
    """(model, share): a forest fitted on at most ``MAX_LABELS`` findings of each kind, chosen by a
    hash of finding and document; model is null without findings of both kinds. ``blank``: each is learnt from
    a second time without ``SIGNS``."""
    rows = labelled.where("is_secret is not null").withColumn("draw", F.pmod(F.xxhash64("candidate", "doc_id", "word"), F.lit(_SCALE)))
    n = {r.is_secret: r.n for r in rows.groupBy("is_secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = n.get(1, 0), n.get(0, 0)
    share = yes / (yes + no) if yes + no else 0.0
    if not yes or not no:
        return None, share
    limit = F.when(F.col("is_secret") == 1, F.lit(int(min(1.0, MAX_LABELS / yes) * _SCALE))).otherwise(F.lit(int(min(1.0, MAX_LABELS / no) * _SCALE)))
    some = written(rows.where(F.col("draw") < limit).select(*FEATURES, F.col("is_secret").cast("double").alias("label")))
    if blank:
        some = some.union(some.select(*[F.lit(0.0).alias(c) if c in SIGNS else F.col(c) for c in some.columns]))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, maxBins=32, cacheNodeIds=False)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(some), share


def scan(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate with ``score`` and ``is_secret``."""
    found = written(with_features(candidates(docs, doc_id, text), dictionary(docs, text)))
    labelled = own_labels(found) if findings is None else found.join(
        findings.select("doc_id", "candidate", F.col("is_secret").cast("int").alias("is_secret")).distinct(), ["doc_id", "candidate"])
    model, share = train(labelled, blank=findings is None)
    out = ["doc_id", "word", "part", "candidate"]
    if model is None:
        return found.select(*out, F.lit(share).alias("score"), F.lit(share >= 0.5).alias("is_secret"))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*out, "score", (F.col("score") >= 0.5).alias("is_secret"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


register("op8_secret_forest", op8)
