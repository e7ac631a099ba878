"""Ranked search, divergence rules and whitening against brute force and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scorelake.llm import bitsliced, divergence, whitening

DOCS = "doc_id long, text string, lang string, n_words long, key long, words string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def docs(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None if i == 1 else "en", -1, -1, "x") for i, t in texts], DOCS)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary * r.random() ** 3)}" for _ in range(n))


def ranked(texts, items, top=20):
    terms = [TERM.findall(ascii_lower(t or "")) for _, t in texts]
    n, length = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for w in terms for t in set(w))
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(ascii_lower(text or "")))
        scores = []
        for (i, _), w in zip(texts, terms, strict=True):
            tf, s = Counter(w), 0
            m = 75 + 25 * len(w) * n // max(length, 1)
            for t, c in asked.items():
                if tf[t]:
                    s += c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


TEXTS = [(0, prose(1, 60)), (1, None), (2, ""), (3, prose(1, 60)), (3, prose(1, 60)), (None, prose(1, 60)), (4, "W1 w1,W2é w3"), (5, "...")] + [
    (10 + k, prose(k, 5 + 7 * (k % 40), 60)) for k in range(160)] + [(500, prose(7, 30000)), (501, "w0 " * 5000)]
ITEMS = [(1, prose(3, 12)), (2, prose(1, 20)), (3, ""), (4, None), (5, "w1 W1 w59 unknown"), (5, prose(9, 8)), (7, "w58"), (None, "w2 w3")]


@pytest.mark.parametrize("pass_bytes", [1 << 22, 60])
def test_search_equals_brute_force(spark, pass_bytes):
    items = spark.createDataFrame([(*x, "y") for x in ITEMS + ITEMS[:1]], "item_id long, text string, rank string")
    got = bitsliced.search(docs(spark, TEXTS), items, pass_bytes=pass_bytes).collect()
    assert sorted([tuple(r) for r in got], key=str) == ranked(TEXTS, ITEMS)


def test_bounds_never_fall_below_the_score_and_leave_most_out(spark):
    q = bitsliced.Queries([t for _, t in ITEMS if t])
    rows = bitsliced._keyed(docs(spark, TEXTS), "doc_id", "text")
    bitsliced._weigh(rows, q)
    exact = {}
    for k, (_, t) in enumerate(x for x in ITEMS if x[1]):
        for r in ranked(TEXTS, [(k, t)], 10 ** 6):
            exact[k, r[2]] = r[3]
    loose = total = 0
    for row in bitsliced.build_index(docs(spark, TEXTS)).collect():
        got = bitsliced.bounds(row.asDict(), q)
        for k in range(len(got)):
            for j, i in enumerate(row.ids):
                assert got[k, j] >= exact.get((k, i), 0)
                loose += got[k, j] > exact.get((k, i), 0) and (k, i) not in exact
                total += 1
    assert loose < 0.1 * total


def test_search_on_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bitsliced.search(none, items).count() == 0
    assert bitsliced.search(docs(spark, TEXTS), items.limit(0)).count() == 0


def repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if at[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return len(w), len(hit)


def test_base_rules_equal_brute_force(spark):
    r = random.Random(3)
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "a b c d e f g h"), (4, "a " * 15), (5, "a\n\na\n \na b\na b\n"), (6, "#é $   x\x0by")]
    texts += [(10 + k, "".join(r.choice(["a", "b", "cd", "#"]) + r.choice([" ", "\n", "  "]) for _ in range(r.randint(0, 60)))) for k in range(150)]
    texts += [(900, prose(2, 20000)), (901, (prose(3, 100) + " ") * 200)]
    got = {x.doc_id: x for x in divergence.judge(docs(spark, texts)).collect()}
    base = {x.doc_id: x for x in divergence.base(docs(spark, texts)).collect()}
    for i, t in texts:
        n, hit = repeats(t)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        x = base[i]
        assert (x.n_words, x.n_repeat_words) == (n, hit), i
        assert x.n_dup_lines == len(lines) - len(set(lines))
        assert x.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert x.word_chars == sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t or "")))
        assert x.base_failed == (n < 20 or 100 * hit > 30 * n)
        assert x.words == "x" and not (x.base_failed and got[i].kept)


def jensen_shannon(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    h = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return math.sqrt((h(p) + h(q)) / 2)


def test_distances_and_verdicts(spark):
    texts = [(k, prose(k, 150, 300)) for k in range(2, 60)] + [(100, prose(2, 150, 300).upper()), (101, re.sub(" ", "### ", prose(2, 150, 300))),
                                                                (102, " ".join(f"z{k}z" for k in range(200)).translate(str.maketrans("0123456789", "abcdefghij")))]
    texts = [(i, t.translate(str.maketrans("0123456789", "abcdefghij"))) for i, t in texts]
    got = {x.doc_id: x for x in divergence.judge(docs(spark, texts)).collect()}
    assert [i for i, _ in texts if not got[i].kept] == [100, 101, 102]
    words = Counter(w for _, t in texts for w in re.findall("[a-z]+", t.lower()))
    total = sum(words.values())
    top = sorted(words, key=lambda w: (-words[w], w))[:divergence.COMMON]
    own = Counter(texts[0][1].split())
    n = sum(own.values())
    p, q = [own[w] / n for w in top], [words[w] / total for w in top]
    assert abs(got[2].word_distance - jensen_shannon([*p, 1 - sum(p)], [*q, 1 - sum(q)])) < 1e-9
    assert got[100].class_distance > divergence.CLASS_LIMIT and got[102].word_distance > divergence.WORD_LIMIT
    few = {x.doc_id: x for x in divergence.judge(docs(spark, [(1, "THIS IS SHORT " * 7), (3, prose(3, 30))])).collect()}
    assert few[3].kept and not few[1].kept
    assert divergence.judge(docs(spark, [])).count() == 0


def test_divergence_runs_no_python(spark):
    plan = divergence.judge(docs(spark, [(1, "a b")]).select("doc_id", "lang", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, -1, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, component string")


def test_whitening_equals_eigenvectors(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 10)) * np.geomspace(3, 0.05, 10)
    odd = [(1000, None), (1001, [float("nan")] * 10), (1002, [None] * 10), (1003, [1.0, 2.0]), (1004, []), (1005, [1e300] * 10), (1006, [float("inf")] * 10)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[1].tolist())]
    got = whitening.whiten(vectors(spark, rows + odd), components=6).collect()
    assert len(got) == 302 * 6
    y = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, s = len(y), y.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(y.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    z = (y - s / n) @ v / np.sqrt(e)
    exact = ((n * y - s) ** 2).sum(axis=1)
    for r_ in got:
        assert r_.n == n and r_.identity_error < 1e-9 and abs(r_.explained / (e[r_.component - 1] / e.sum()) - 1) < 1e-9
        if r_.vec_id is not None:
            assert int(r_.deviation) == int(exact[r_.vec_id])
            assert abs(abs(r_.whitened) - abs(z[r_.vec_id, r_.component - 1])) < 1e-8
    signs = {(r_.component, math.copysign(1, r_.whitened * z[r_.vec_id, r_.component - 1])) for r_ in got if r_.vec_id and abs(r_.whitened) > 1e-6}
    assert len(signs) == 6


def test_whitening_of_flat_repeated_and_empty_tables(spark):
    cross = [(k, (np.eye(5)[k % 5] * (-1) ** (k // 5)).tolist() + [0.0]) for k in range(10)]  # five equal values, one null direction
    found = whitening.fit(vectors(spark, cross))
    assert len(found.values) == 5 and np.allclose(found.values, found.values[0]) and found.identity_error < 1e-9
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(4)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    large = whitening.whiten(vectors(spark, [(0, [-2.0 ** 37, 0.0]), (1, [2.0 ** 37, 0.0])])).collect()
    assert [int(r.deviation) for r in large] == [(2 ** 44) ** 2] * 2


def test_levels_and_terms():
    assert bitsliced.LEVELS[:9].tolist() == [1, 2, 3, 4, 6, 8, 12, 16, 24]
    assert bitsliced.terms("Ab-cÉé 9_x") == [b"ab", "cÉé".encode(), b"9", b"x"]
