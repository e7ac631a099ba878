"""The training-data operators against SQL twins, brute force and edge cases."""

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from check import TABLES, _norm
from scorelake.llm import components, decontaminate, jaccard, mixing, nndescent, pii, secrets, substring, toxicity, urls, webtext
from scorelake.llm.common import BATCH_BYTES, LEAST_TASKS, written

SQL = oracle_sql()
TWINS = sorted(n for n in SQL if re.match(r"op\d+_", n))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, items string"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    head = [c[0] for c in cur.description]
    assert sorted(head) == cols
    assert got == sorted(tuple(_norm(r[head.index(c)]) for c in cols) for r in cur.fetchall())


def docs(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "en", None if i in (None, 1) else f"s{i % 2}", len(t or ""), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 99)) for _ in range(n))


A, B = words(1, 60), words(2, 60)
ODD = [(0, A), (1, None), (2, ""), (3, A), (3, A), (4, B + " " + B), (5, A[: len(A) // 2] + " end"), (None, A), (6, "one two"), (7, "One TWO"), (8, words(3, 30000))]


def test_plain_identifiers_equal_regular_expressions():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(kind, text):
        d = re.sub(r"\D", "", text)
        return (True, kind == 1 and all(int(p) <= 255 for p in text.split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[kind]
    r = random.Random(5)
    for _ in range(5000):
        t = "".join(r.choice("a@.1+- (24") for _ in range(r.randint(0, 40)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if good(k, m[0]))
        assert pii.plain(t) == want, t


@pytest.mark.parametrize("text,found", [
    ("mail john (at) mail (dot) com now", "email:5:29"), ("j​ohn@mail.com", "email:2:14"), ("x １９２.168.1.20 y", "ip:2:14"),
    ("four one one one one one one one one one one one one one one one", "card:0:64"), ("look at example.com today", ""), ("one two three", "")])
def test_disguised_identifiers(text, found):
    base, every = pii.spans(text)
    if text.startswith("j​"):
        assert any(k == 0 and a == 0 and b == len(text) for a, k, b in every)
    else:
        assert pii.listed([s for s in every if s not in base]) == found


@pytest.mark.parametrize("text,found", [
    ("write john_at_example.com soon", "email:6:25"), ("write john-at-example.com soon", "email:6:25"), ("ring +1 212 five 55 0100 soon", "phone:5:24"),
    ("write john@mail .com soon", "email:6:20"), ("write john @mail.com soon", "email:6:20"), ("write john at mail dot com soon", "email:6:26"),
    ("write john@mail(dot)com soon", "email:6:23"), ("ring plus 12125550100 soon", "phone:5:21"), ("pay 4111·1111·1111·1111 soon", "card:4:23"),
    ("pay \"four one one one one one one one one one one one one one one one\"", "card:5:69")])
def test_each_disguise_alone(text, found):
    base, every = pii.spans(text)
    assert pii.listed([s for s in every if s not in base]) == found


def test_gate_leaves_no_disguise_out(monkeypatch):
    r = random.Random(8)
    parts = ["john", "mail", "com", "@", ".", " ", " ", "_", "-", "at", "dot", "[", "]", "(", ")", "\t", "plus", "+", "1", "212", "55", "five", "Two",
             "double", ",", "·", "x", "\n", "192.168", "4111", "ſix", "Punkt", "\""]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(3, 16))) for _ in range(20000)]
    gated = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "suspicious", lambda t: True)
    assert [t for t, g in zip(texts, gated, strict=True) if pii.spans(t) != g] == []


def test_pii_edges(spark):
    rows = pii.find(docs(spark, ODD + [(9, "a@b.co " * 3)]), with_masked=True).collect()
    assert len(rows) == len(ODD) + 1
    last = next(r for r in rows if r.doc_id == 9)
    assert (last.n_email, last.masked) == (3, "[EMAIL] [EMAIL] [EMAIL] ")
    assert next(r for r in rows if r.doc_id == 1).masked is None
    assert pii.find(docs(spark, [])).count() == 0


def test_decontamination_edges_and_passes(spark):
    bench = spark.createDataFrame([(1, A), (2, None), (3, ""), (4, "ONE two"), (None, B), (1, A)], "item_id long, text string")
    whole = sorted(map(str, decontaminate.search(docs(spark, ODD), bench).select("doc_id", "n_words", "hits", "items").collect()))
    parts = sorted(map(str, decontaminate.search(docs(spark, ODD), bench, pass_bytes=300).select("doc_id", "n_words", "hits", "items").collect()))
    assert whole == parts
    by_id = {r.doc_id: r for r in decontaminate.search(docs(spark, ODD), bench).collect()}
    assert by_id[0].items == [1] and by_id[0].hits[0].stop == 60
    assert by_id[7].items == [4] and by_id[4].items == [] and by_id[4].hits
    assert decontaminate.search(docs(spark, []), bench).count() == 0
    assert decontaminate.search(docs(spark, ODD), bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_jaccard_edges(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs(spark, ODD)).collect()}
    for row in ((0, 56, 0), (1, 0, 1), (2, 0, 2), (3, 56, 0), (6, 1, 6), (7, 1, 6), (None, 56, None)):
        assert row in got
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0


def test_jaccard_near_copies_equal_brute_force(spark):
    r = random.Random(3)
    base = [words(10 + k, 50).split() for k in range(4)]
    texts = []
    for i in range(90):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(50)] = f"new{r.randint(0, 9)}"
        texts.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(46)} for i, t in texts}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs(spark, texts)).collect()} == comp


def test_jaccard_repeated_ids_with_different_texts(spark):
    near = lambda t, k: f"{t} new{k}"
    texts = [(5, A), (5, B), (9, near(B, 9)), (11, near(A, 11))]
    # Another id is the lowest of one set and repeats the set of another.
    c, d = words(4, 60), words(5, 60)
    texts += [(20, c), (21, c), (21, d), (22, near(d, 22)), (30, words(6, 60)), (30, ""), (31, near(words(6, 60), 31))]
    # Many ids of two sets each, each with a near copy.
    for k in range(40):
        x, y = words(100 + k, 40), words(200 + k, 40)
        texts += [(1000 + k, x), (1000 + k, y), (2000 + k, near(x, k)), (3000 + k, near(y, k))]
    random.Random(1).shuffle(texts)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in (5, 9, 11, 20, 21, 22, 30, 31)] == [5, 5, 5, 20, 20, 20, 30, 30]
    assert all(got[1000 + k] == got[2000 + k] == got[3000 + k] == 1000 + k for k in range(40))


def test_jaccard_marks_tell_long_texts_apart_and_never_too_much():
    r = np.random.default_rng(5)
    for size in (30, 300, 1500):
        one, two = (np.unique(r.integers(0, 1 << 63, size).astype(np.uint64)) for _ in "ab")
        near = np.unique(np.concatenate([one[size // 8:], two[:size // 8]]))
        for x, y, alike in ((one, two, False), (one, near, True)):
            apart = len(np.setxor1d(x, y))
            seen = sum((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(jaccard.marks(x), jaccard.marks(y), strict=True))
            least = jaccard.fewest_differences(jaccard.bitmap(x), jaccard.bitmap(y))
            assert seen <= apart and least <= apart
            assert (7 * seen <= len(x) + len(y)) == (7 * least <= len(x) + len(y)) == alike


def test_jaccard_turns_leave_out_buckets_of_one_class(spark):
    buckets = spark.createDataFrame([(t, g, 0, 9) for t, g in ((1, 10), (1, 11), (2, 10), (2, 12), (3, 11), (3, 12))], "token long, g long, pos int, size int")
    of_group = spark.createDataFrame([(k, 10 + k, 1) for k in range(3)], "node long, g long, members long")
    label = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    assert {r.token for r in jaccard._drawn(1, buckets, of_group, label).collect()} == {2, 3}
    assert {r.token for r in jaccard._drawn(0, buckets, of_group, None).collect()} == {1, 2, 3}


def test_jaccard_frequent_shingles_are_few_enough_and_the_most_frequent(spark):
    texts = spark.createDataFrame([(i, f"{words(7, 20)} {words(8 + i % 2, 20) if i % 4 else ''}") for i in range(400)], "id long, text string")
    keys, counts = jaccard.frequent_shingles(texts, 5, 1000)
    assert len(keys) > 20 and (np.diff(keys.astype(object)) > 0).all()
    some, few = jaccard.frequent_shingles(texts, 5, 20)
    assert 0 < len(some) <= 20 and few.min() > np.sort(counts)[-len(some) - 1]
    assert len(jaccard.frequent_shingles(texts.limit(0), 5, 20)[0]) == 0


@pytest.mark.parametrize("run,hot", [(1 << 20, 1), (64, 400)])
def test_jaccard_counts_shingles_in_every_document(spark, monkeypatch, run, hot):
    monkeypatch.setattr(jaccard, "RUN", run)
    texts = [(i, f"{words(1000 + i // 2, 12)} {words(1, 8)}" if i < hot * 2 else words(2000 + i // 3, 12)) for i in range(1000)]
    want = Counter(int(s) >> 32 for one in jaccard.shingle_sets(pa.array([t for _, t in texts])) for s in one)
    keys, counts = jaccard.frequent_shingles(spark.createDataFrame([*texts, (None, texts[0][1])], "id long, text string"), 5, 1 << 20)
    assert dict(zip((int(k) >> 32 for k in keys), counts.tolist(), strict=True)) == {k: c for k, c in want.items() if c > 1}


def test_jaccard_sets_are_made_in_small_steps():
    column = pa.array([f"{words(k, 150)} end{k}" for k in range(60)] * 60)
    tracemalloc.start()
    sets = sum(len(s) for s in jaccard.shingle_sets(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sets and column.nbytes > 2 << 20 and peak < 24 << 20


def test_jaccard_sends_texts_to_python_by_their_bytes(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text")
    widest = lambda: max(r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect())
    sketches = jaccard.sketches
    monkeypatch.setattr(jaccard, "sketches", lambda *a: seen.append(widest()) or sketches(*a))
    before = spark.conf.get(key, None)
    assert widest() > 10_000_000
    jaccard.jaccard_classes(docs(spark, ODD[:5]))
    assert seen and seen[0] <= BATCH_BYTES + 10_000
    assert spark.conf.get(key, None) == before


def test_small_links_stay_in_few_files(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "written", lambda df: tables.append(written(df)) or tables[-1])
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        links = spark.range(4000).selectExpr("id * 10 AS a", "id * 10 + 1 + id % 9 AS b").union(spark.range(4000).selectExpr("id * 10 + 1 + id % 9", "id * 10 + 20"))
        got = {r.node: r.component for r in components.components(links, 8000).collect()}
        assert {got[k] for k in range(0, 40_000, 10)} == {0, 10}
        assert all(c == k // 10 * 10 % 20 for k, c in got.items())
        assert max(len(t.inputFiles()) for t in tables) <= LEAST_TASKS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_jaccard_reads_the_prefixes_from_the_sketches(spark):
    texts = [(0, A), (1, A.upper()), (2, None), (None, B), (3, ""), (4, B), (5, "one two"), (6, words(9, 300))]
    sets = {i: s for (i, _), s in zip(texts, jaccard.shingle_sets(pa.array([t for _, t in texts])), strict=True)}
    keys = np.sort(np.concatenate([sets[0][:7], sets[6][::9]]))
    rank = np.arange(len(keys))[::-1].copy()
    order = spark.sparkContext.broadcast((keys, rank, jaccard._bits_of(keys)))
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    rows = jaccard.sketches(df, order, 5, 3, 4).collect()
    assert [(r.id, r.size) for r in rows] == [(i, len(s)) for (i, _), s in zip(texts, jaccard.shingle_sets(pa.array([t for _, t in texts])), strict=True)]
    assert [r.prefix is not None for r in rows] == [True, False, False, False, False, True, True, True]
    assert rows[0].g == rows[1].g and rows[3].g == rows[5].g
    place = dict(zip(keys.tolist(), rank.tolist(), strict=True))
    got = {}
    for r in jaccard._entries(spark.createDataFrame(rows, jaccard.SKETCH)).collect():
        got.setdefault(r.g, []).append((r.at & 0xFFFFFFFF, r.at >> 32, r.token))
    for r in rows:
        if r.prefix is not None:
            full = sorted(sets[r.id].tolist(), key=lambda t: (t in place, place.get(t, t)))
            first = np.array(full[:jaccard.prefix_length(len(full))], np.uint64).view(np.int64).tolist()
            assert sorted(got.pop(r.g)) == [(k, len(full), t) for k, t in enumerate(first)]
    assert not got


def test_substring_edges(spark):
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.remove_repeats(docs(spark, ODD), keep=64).collect())
    assert (3, 60, 60) in got and (4, 120, 60) in got and (1, 0, 0) in got and (-1, 60, 0) in got
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_urls_edges_and_slices(spark):
    rows = [(1, "http://A.example.net/en/x"), (2, "https://b.net"), (3, "https://b.net/?q"), (4, None), (5, "no url"), (6, "ftp://x.org/fr/"), (7, "http://casino.org/en/"), (7, "http://casino.org/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: ("org/fr/", "allow"), 7: (None, "block")}
    for size in (urls.MAX_BYTES, 1):
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, max_bytes=size).collect()} == want
    assert urls.judge(pages.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 16))
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    got = {}
    for row in nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, chunk=64).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        assert len(got[q]) == 20
        hit += len({int(v) for v in want} & {v for _, v in got[q]})
    assert hit >= 0.9 * 20 * 15
    assert sorted(v for _, v in got[60]) == [v for v in range(50, 71) if v != 60]
    assert nndescent.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def recall_of_nearest(spark, x, **options):
    """Share of the 20 largest inner products that are found, over every 20th row."""
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for row in nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hit = 0
    for q in range(0, len(x), 20):
        with np.errstate(over="ignore"):
            s = x @ (x[q] / np.abs(x[q]).max())
        s[q] = -np.inf
        hit += len({int(v) for v in np.lexsort((np.arange(len(x)), -s))[:20]} & got[q])
    return hit / (20 * len(range(0, len(x), 20)))


@pytest.mark.parametrize("kind", ["lognormal", "one long", "huge"])
def test_nearest_with_unequal_lengths(spark, kind):
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 16))
    if kind == "lognormal":
        x *= r.lognormal(0.0, 1.0, 3000)[:, None]
    elif kind == "one long":
        x[7] *= 1e4
    else:
        x[7] *= 1e200
    assert recall_of_nearest(spark, x, chunk=128, sample=128) >= 0.9


def test_main_text(spark):
    page = ("<html><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head</h1><p>First &amp; "
            + "long running text, " * 5 + "<b>bold</b>end.<script>var x='</p>';</script><div class=comments><p>" + "silly " * 30 + "</div></article><footer>foot</footer>")
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", None), (3, None, page), (4, "http://a.b/4", ""), (1, "http://a.b/1", page)]
    got = [(r.page_id, r.text) for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = "Head First & " + "long running text, " * 5 + "boldend."
    assert sorted(got) == [(1, want), (1, want), (2, ""), (3, want), (4, "")]
    assert webtext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_budget_and_limit(spark):
    rows = [(i, words(i, 20 + i % 7)) for i in range(300)] + [(500, None), (501, "")]
    table = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") < 250, "big").when(F.col("doc_id") < 290, "mid").when(F.col("doc_id") < 500, "small"))
    units, plan = mixing.mix_sources(table, max_repeats=2.0, last_block=8)
    use = {r.source_key: r for r in units.groupBy("source_key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    for p in plan.collect():
        u = use[p.source_key]
        assert u.given <= p.goal and u.given > p.goal - 30 or not p.tokens
        assert u.most - u.least <= 1 and u.most <= 2
    half = mixing.mix_sources(table, entropy=0.8, max_repeats=None)[1].where("weight > 0").toPandas().weight.to_numpy()
    assert abs(-(half * np.log(half)).sum() - 0.8 * np.log(3)) < 1e-6
    assert mixing.mix_sources(table.limit(0))[0].count() == 0


def test_toxicity(spark):
    rows = [(i, words(i, 30) + (" zzgrub zzgrubben kartoff" if i % 5 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(900, None), (5000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(table, toxicity.train(table, labels)).withColumn("held", toxicity.held_out()).collect()}
    held = [i for i in range(400) if got[i].held]
    assert held and all((got[i].score >= 0.7) == (i % 5 == 0) for i in held)
    assert got[900].score == got[901].score < 0.7
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(table, toxicity.train(table, none)).collect()} == {0.0}
    assert toxicity.score(table.limit(0), toxicity.train(table.limit(0), labels.limit(0))).count() == 0


def test_secrets(spark):
    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f"text before token = \"{h}\" and after" if i % 2 else f"see commit {h} of today") for i, h in enumerate(hexes)] + [(100, None), (101, "")]
    got = {row.doc_id: row.is_secret for row in secrets.scan(docs(spark, rows)).collect()}
    assert len(got) == 60 and all(got[i] == bool(i % 2) for i in range(60))
    assert "Python" not in secrets.scan(docs(spark, rows))._jdf.queryExecution().toString()
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_in_other_forms(spark):
    r = random.Random(7)
    draw = lambda signs, n: "".join(r.choice(signs) for _ in range(n))
    hexed, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    forms = [("set token: {} here", hexed, 40), ("set token = {} here", hexed, 40), ("send Authorization: Bearer {} then", letters, 40), ("export API_KEY={} now", letters, 32),
             ("curl --access-key={} now", hexed, 40), ("we saw {} there", "ghp_", 36), ("set secret: {} here", "abcdefghijklmnopqrstuvwxyz", 40), ("call x?auth_token={}&b=1 now", letters, 32)]
    others = ["see commit {} of today", "the file at /usr/{}/lib was read", "checksum={} was right", "under id {} of it"]
    rows, want = [], {}
    for k in range(25):
        for j, (form, signs, n) in enumerate(forms):
            value = signs + draw(letters, n) if signs == "ghp_" else draw(signs, n)
            rows.append((len(rows), form.format(value)))
            want[len(rows) - 1] = (value, True)
        for form in others:
            value = draw(hexed, 40)
            rows.append((len(rows), form.format(value)))
            want[len(rows) - 1] = (value, False)
    got = {row.doc_id: row for row in secrets.scan(docs(spark, rows)).collect()}
    assert [(rows[i][1], v) for i, (v, yes) in want.items() if yes and (i not in got or got[i].candidate != v or not got[i].is_secret)] == []
    assert [rows[i][1] for i, (_, yes) in want.items() if not yes and i in got and got[i].is_secret] == []
