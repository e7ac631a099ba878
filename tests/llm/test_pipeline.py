"""The pipeline against brute force, each stage on what the one before kept."""

import random
import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from scorelake.llm import jaccard, mixing
from scorelake.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prose(r, n):
    return [r.choice("bcdfghklmn") + r.choice("aeiou") + str(r.randint(0, 400)) for _ in range(n)]


def corpus():
    """Documents (id, text), toxic ids, benchmark texts."""
    r = random.Random(8)
    base = [prose(r, r.randint(30, 80)) for _ in range(150)]
    toxic = set(range(0, 150, 5))
    texts = {i: " ".join(w) + (" zzgrub zzgrubben kartoff" if i in toxic else "") for i, w in enumerate(base)}
    for k in range(40):  # exact and near copies, some of copies
        w = texts[150 + k - 30 if k > 35 else r.choice([i for i in range(150) if i not in toxic])].split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "changed"
        texts[150 + k] = " ".join(w)
    items = [" ".join(prose(r, 25)) for _ in range(4)] + ["", "alone here"]
    for k, i in enumerate(range(200, 212)):
        words = prose(r, 40 if k % 2 else 900)
        words[10:10] = items[k % 4].split()[:13 + k % 3]
        texts[i] = " ".join(words)
    for k, i in enumerate(range(212, 224)):
        texts[i] = " ".join(prose(r, 30)) + (" mail a.b@c.org now", " host 10.0.0.7 up", " call +1 212 555 0100 x", " card 4111 1111 1111 1111.")[k % 4]
    texts |= {300: None, 301: "", 302: "alone HERE", 303: "one two"}
    return texts, toxic, items


def test_near_copies_count_the_shingles_of_every_document(spark, tmp_path, monkeypatch):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus()[0].items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counted, count = [], jaccard.frequent_shingles
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda *a: counted.append(count(*a)) or counted[-1])
    corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    want = Counter(int(s) >> 32 for one in jaccard.shingle_sets(pa.array([r[1] for r in rows])) for s in one)
    (keys, counts), = counted
    assert dict(zip((int(k) >> 32 for k in keys), counts.tolist(), strict=True)) == {k: c for k, c in want.items() if c > 1}


def test_each_stage_equals_brute_force(spark, tmp_path):
    texts, toxic, items = corpus()
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3 == 0}", None if t is None else len(t)) for i, t in texts.items()]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    def kept(df):
        return {r.doc_id: r.text for r in df.collect()}
    stages, at = [], table(spark, sf, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, at, sf)
        assert got.columns == at.columns
        got.write.parquet(f"{sf}/stage{k}")
        at = spark.read.parquet(f"{sf}/stage{k}")
        stages.append(kept(at))

    assert set(stages[0]) == {i for i, t in texts.items() if "kartoff" not in (t or "")}

    sets = {}
    for i, t in stages[0].items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if component[i] != component[j] and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
    assert set(stages[1]) == {i for i in sets if component[i] == i} < set(sets)

    windows = set()
    for t in items:
        w = re.findall(WORD, t.lower())
        windows |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for i, t in stages[1].items():
        w = re.findall(WORD, (t or "").lower())
        hit = {p for x in windows for k in range(len(w) - len(x) + 1) if tuple(w[k:k + len(x)]) == x for p in range(k, k + len(x))}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert set(stages[2]) == clean and {200, 302} - clean == {302} and 201 not in clean

    for i, t in stages[3].items():
        want = stages[2][i]
        for found, tag in ((r"a\.b@c\.org", "[EMAIL]"), (r"10\.0\.0\.7", "[IP]"), (r"\+1 212 555 0100", "[PHONE]"), ("4111 1111 1111 1111", "[CARD]")):
            want = want and re.sub(found, tag, want)
        assert t == want
    assert set(stages[3]) == clean

    final = corpus_pipeline.run(spark, sf)
    uses = final.collect()
    assert {r.doc_id for r in uses} <= clean and all(r.text == stages[3][r.doc_id] for r in uses)
    plan = {p.source_key: p for p in mixing.mix_sources(at)[1].collect()}
    sources = {r.doc_id: r.source for r in at.collect()}
    for key, p in plan.items():
        mine = [i for i, s in sources.items() if key == ("n" if s is None else "s" + s)]
        copies = {i: sum(r.doc_id == i for r in uses) for i in mine}
        given = sum(copies[i] * len((stages[3][i] or "").split()) for i in mine)
        longest = max(len((stages[3][i] or "").split()) for i in mine)
        assert p.goal - longest < given <= p.goal + 1e-6
        assert max(copies.values()) - min(copies.values()) <= 1


def test_stages_hand_other_columns_through(spark, tmp_path):
    """Columns named like those that the stages use themselves keep their values."""
    texts, toxic, items = corpus()
    names = ["spans", "items", "hits", "score", "copies", "epoch", "place", "source_key", "n_words", "masked", "component_id", "Tokens", "with space", "a.b"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), *[f"{n}{i}" for n in names]) for i, t in texts.items()]
    sf = str(tmp_path)
    extra = ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns + (["mix_epoch", "mix_place"] if k == 4 else [])
        found = got.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
        assert all(r.lang == "en" and r.source == f"s{r.doc_id % 3}" for r in found)
