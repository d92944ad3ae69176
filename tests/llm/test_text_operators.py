"""Brute-force versions of the operators on small texts with all the odd cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import decontamination, language_id, license_scan, near_dedup, quality_rules, sharding

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, failed_bits string, shard string"


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


def prose(seed, n):
    draw = random.Random(seed)
    return [draw.choice("the of and to harbour lantern weaving copper meadow silent orbit glass timber velvet anchor".split()) + draw.choice(["", "", "s", "ed", "ing"]) + str(draw.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    base = prose(1, 120)
    edited = base.copy()
    edited[60] = "changed"
    far = base[:60] + prose(2, 60)
    return [
        " ".join(base),
        " ".join(edited),
        " ".join(far),
        " ".join(base),
        None,
        "",
        "   \n\n \t",
        "!!! ### ***",
        "one two three",
        "ONE, two; three!",
        "Und " * 300,
        "same line here\n" * 12 + "and one more line of words that stands alone at the end",
        "É ê ñ straße Straße K İ mixed_under-score 12 x",
        " ".join(prose(3, 9000)),
        "word" * 5000,
        "a " * 40 + "mit license and MIT-License, cc by nc 4.0; GNU General\nPublic License version 3",
        "%%% shouting!! LOUD!! WORDS!! ### $$$ | | |",
        "\x00\x01 control\x7f chars ퟿ \U0001f600 emoji",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[0], rows[8], (None, texts[0], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def measured_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + o for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for o in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_measures(docs):
    rows = quality_rules.ledger(docs, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured_by_hand(r.text), r.text
        assert bool(r.failed_bits & 1) == (r.n_words < 20)
        assert bool(r.failed_bits & 2) == (100 * r.n_repeat_words > 30 * r.n_words)


def test_policies_and_ablation(docs):
    rows = quality_rules.ledger(docs).cache()
    for version, names in quality_rules.POLICIES.items():
        mask = quality_rules.mask(names)
        bits = [r.failed_bits & mask for r in rows.collect()]
        found = {r.rule: r for r in quality_rules.ablation(rows, version).collect()}
        for name in names:
            bit = quality_rules.mask((name,))
            assert found[name].n_failing == sum(bool(b & bit) for b in bits)
            assert found[name].n_only_this == sum(b == bit for b in bits)
            assert found[name].n_kept_without == sum(not b & ~bit for b in bits)
        assert rows.where(~quality_rules.rejected_by(version)).count() == sum(b == 0 for b in bits)


def hit_by_hand(text, items):
    w = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        x = words_of(item)
        size = min(10, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(spark, docs, texts, block):
    base = prose(1, 120)
    items = [("3", " ".join(base[5:25])), ("1", "one two three"), ("20", " ".join(base[40:52]).upper()), ("7", None), ("8", ""), ("9", "und und und und und und und und und und und"), ("10", " ".join(prose(9, 30))), ("11", " ".join(base[70:79]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    rows = decontamination.contamination(docs, bench, block=block).withColumn("n_hit", decontamination.hit_words(F.col("hits"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = None if r.doc_id is None and not r.n_words else texts[r.doc_id or 0]
        assert (r.n_words, r.n_hit, r["items"]) == hit_by_hand(text, items), text


def test_items_that_share_an_id(spark):
    a, b, c, d, e = (prose(k, n) for k, n in ((31, 24), (32, 17), (33, 12), (34, 15), (35, 14)))
    items = [("1", " ".join(a)), ("1", " ".join(a)), (None, " ".join(b)), (None, " ".join(c)), ("2", " ".join(d)), ("2", " ".join(e)), ("2", " ".join(d))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    filler = prose(36, 6)
    texts = [filler + one[low:high] + filler for one in (a, b, c, d, e) for low, high in ((0, 5), (2, 12), (0, 99))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = decontamination.contamination(docs, bench, slack=0).withColumn("n_hit", decontamination.hit_words(F.col("hits"))).collect()
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == hit_by_hand(" ".join(texts[r.doc_id]), [(i or "", t) for i, t in items]), r.doc_id
    kept = decontamination.without_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {0, 3, 6, 9, 12}


def test_proximity(spark):
    item = spark.createDataFrame([("a", "alpha beta gamma delta epsilon")], "item_id string, text string")
    doc = spark.createDataFrame([(1, "x alpha beta extra gamma delta epsilon y"), (2, "epsilon x x x x x x x alpha")], "doc_id int, text string")
    found = {r.doc_id: r for r in decontamination.contamination(doc, item, slack=2).collect()}
    assert found[1]["items"] == [] and found[1].near_items == ["a"]
    assert found[2].near_items == []
    assert all(r.near_items == [] for r in decontamination.contamination(doc, item, slack=0).collect())


def test_without_contaminated(spark, docs, texts):
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.where("text IS NULL OR NOT text ILIKE '%one%two%three%'").count()


def similarity(a, b):
    def cells(t):
        w = words_of(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    a, b = cells(a), cells(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_duplicates(spark, docs, texts):
    more, draw = [], random.Random(5)
    for g in range(6):
        base = prose(100 + g, 150)
        for c in range(14):
            copy = base.copy()
            for _ in range(draw.choice([0, 1, 2, 4, 7, 12])):
                copy[draw.randrange(150)] = f"new{draw.random()}"
            more.append((1000 + 100 * g + c, " ".join(copy)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = near_dedup.classes(both).collect()
    assert len(rows) == both.count()
    have = {i: t for i, t in enumerate(texts)} | dict(more)
    parent = {i: i for i in have}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(have)
    for i in ids:
        for j in ids:
            if i < j and similarity(have[i], have[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == {i: root(i) for i in ids}
    assert [r.class_id for r in rows if r.doc_id is None and r.root is not None] == [0]
    kept = near_dedup.one_of_each(both)
    classes = {root(i) for i in ids if words_of(have[i])}
    assert kept.columns == both.columns
    assert Counter(r.doc_id for r in kept.where("text rlike '[A-Za-z0-9]'").collect()) == Counter(classes)


def test_signature_is_weighted_jaccard():
    import numpy as np

    draw = np.random.default_rng(3)
    one, two = draw.choice(2**40, 300, replace=False).astype(np.uint64), draw.choice(2**40, 300, replace=False).astype(np.uint64)
    two[:240] = one[:240]
    weights = draw.random(300) * 3
    cells = lambda x, w: (np.concatenate([near_dedup.W.salted(x, j) for j in range(3)]), np.concatenate([np.clip(w - j, 0, 1) for j in range(3)]))
    half = weights.copy()
    half[:100] /= 2
    want = np.minimum(weights, half)[:240].sum() / (np.maximum(weights, half)[:240].sum() + weights[240:].sum() + half[240:].sum())
    signs = [near_dedup.dart_signatures(c, s, np.zeros(len(c), int), 1, 4096)[0] for c, s in (cells(one, weights), cells(two, half))]
    assert abs((signs[0] == signs[1]).mean() - want) < 0.04


def test_shards(spark, docs):
    placed = sharding.assign(docs, "doc_id", [1.0] * 24, "shard", "grown")
    assert all(r.grown in (r.shard, 24) for r in placed.collect())
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 3.0, 2.0]
    found = dict(sharding.assign(keys, "k", weights, "s").groupBy("s").count().collect())
    assert all(abs(found[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate(weights))
    grown = sharding.assign(keys, "k", weights, "s", "t", 2.0).where("s <> t")
    assert grown.where("t <> 4").count() == 0 and abs(grown.count() / 20_000 - 0.2) < 0.015


def test_slots_are_gapless(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).withColumn("shard", F.lit(1))
    found = [r.slot for r in sharding.numbered(rows, "shard", parts=3).collect()]
    assert sorted(found) == list(range(rows.count()))


def test_language(spark, docs):
    train = [("en", "the house and the garden of the town"), ("de", "das haus und der garten in der stadt"), (None, "ignored"), ("en", None)] * 3
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    assert model.languages == ["de", "en"]
    probe = spark.createDataFrame([(1, "the town"), (2, "der Garten"), (3, None), (4, " 12 !"), (5, "gartenhaus"), (6, "ж")], "doc_id int, text string")
    found = {r.doc_id: r for r in language_id.predict(probe, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "de"]
    assert found[6].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in found.values())
    assert len(language_id.predict(docs, model, keep=("doc_id", "text", "lang")).collect()) == docs.count()
    nothing = language_id.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in language_id.predict(probe, nothing).collect()} == {"und"}


def test_license_phrases(docs, texts):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    for r in license_scan.scan(docs).collect():
        text = None if r.doc_id is None and not r.n_words else texts[r.doc_id or 0]
        w = words_of(text)
        at = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert [r.labels for r in license_scan.scan(docs.where("doc_id = 15")).collect()] == ["cc-by,cc-by-nc,gpl,gpl-3.0,mit"]


def test_edited_notice(spark):
    notice = license_scan.TEMPLATES[14][2].split()
    edited = notice[:12] + ["really"] + notice[12:30] + notice[32:]
    rows = spark.createDataFrame([(1, "x y " + " ".join(edited) + " z"), (2, " ".join(notice[:10]))], "doc_id int, text string")
    found = {r.doc_id: r for r in license_scan.scan(rows).collect()}
    assert found[1].labels == "mit-notice" and 0.6 <= found[1].score < 1
    assert found[2].labels == ""


@pytest.mark.parametrize("name", ["ledger", "contamination", "classes", "scan", "shards", "language"])
def test_empty_table(spark, name):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    run = {
        "ledger": lambda: quality_rules.ledger(none),
        "contamination": lambda: decontamination.contamination(none, bench),
        "classes": lambda: near_dedup.classes(none),
        "scan": lambda: license_scan.scan(none),
        "shards": lambda: sharding.numbered(sharding.assign(none.select("doc_id"), "doc_id", [1.0, 1.0]), "shard"),
        "language": lambda: language_id.predict(none, language_id.fit(none.select("lang", "text"))),
    }
    assert run[name]().count() == 0
