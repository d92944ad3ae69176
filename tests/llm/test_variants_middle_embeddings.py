"""Operators 11 to 13 against plain versions, over the smallest tables and on constructed rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.llm import embedding_dedup, fill_in_middle, spelling_variants
from shelfcast.llm.tables import stage

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)


def documents(spark, rows, ids="long"):
    return spark.createDataFrame(rows, f"doc_id {ids}, text string, n int, word string, vector string, key string, output string")


def of(spark, texts):
    return documents(spark, [(i, t, 1, "w", "v", "k", "o") for i, t in enumerate(texts)])


# spelling variants


def counted_by_hand(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near_by_hand(words):
    near, shorter, masked = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
            masked[i, w[:i], w[i + 1 :]].add(w)
    pairs = {(a, b) for group in masked.values() for a in group for b in group if a < b}
    pairs |= {tuple(sorted((w, v))) for w in words for v in shorter.get(w, ())}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def variants_by_hand(docs):
    n = counted_by_hand(docs)
    near = near_by_hand(n)
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found_variants(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(docs).collect()}


def test_variants_by_hand(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.op11_pivotal_grams(spark, DATA).collect()}
    assert found == variants_by_hand(rows)
    assert any(f[0] for f in found.values())


def test_variants_of_constructed_texts(spark):
    texts = [None, "", "short words", "1234567 -- \n", "ABCDEFGH abcdefgh abcdefgh" * 40, "Écoleève écoleève " * 3, "aaaaaaaa " * 300, "aaaaaaa " * 30, "aaaaaaaaa " * 3, "abcdefgi " * 5, "abcdefgj " * 5, "x" * 60_000 + " " + "x" * 60_000, ("hä" * 9 + " ") * 3, ("hä" * 9 + "h ") * 40, ("y" * 40 + " ") * 30, ("y" * 41 + " ") * 3, ("yz" * 30 + " ") * 40, ("yz" * 30 + "z ") * 3]
    docs = documents(spark, [(i, t, 1, "w", "v", "k", "o") for i, t in enumerate(texts)] + [(None, "abcdefgh abcdefgh", 1, "w", "v", "k", "o")] * 2)
    want = variants_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert found_variants(docs) == want
    assert want["aaaaaaaaa"][:2] == ("aaaaaaaa", "aaaaaaaa")
    assert want["y" * 41][0] == "y" * 40 and want["yz" * 30 + "z"][0] == "yz" * 30
    assert spelling_variants.variants(docs.limit(0)).count() == 0


def test_forms_lead_to_roots(spark):
    pairs, n = [("abcdefg", "abcdefh"), ("abcdefh", "abcdefi"), ("abcdefi", "abcdefj")], {"abcdefg": 2, "abcdefh": 20, "abcdefi": 200, "abcdefj": 2000, "zzzzzzz": 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    formed = spelling_variants.forms(words, spark.createDataFrame(pairs, "a string, b string"))
    found = spelling_variants.rooted(formed)
    assert {r.word: r.root for r in found.collect()} == {w: "zzzzzzz" if w[0] == "z" else "abcdefj" for w in n}
    groups = {r.root: (r.n_words, r.n, r.most) for r in spelling_variants.groups(found).collect()}
    assert groups == {"abcdefj": (4, 2222, "abcdefi"), "zzzzzzz": (1, 7, None)}


@settings(max_examples=3000, deadline=None)
@given(st.text("abc", min_size=7, max_size=12) | st.sampled_from(["a" * 9, "ab" * 6, "aab" * 4, "a" * 7 + "b" * 5]), st.integers(0, 12), st.sampled_from("abcd"), st.sampled_from(["insert", "delete", "replace"]), st.dictionaries(st.text("abcd", min_size=2, max_size=2), st.integers(0, 50), max_size=16))
def test_a_pivot_of_one_is_in_the_prefix_of_the_other(word, at, letter, kind, frequency):
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :], "replace": word[:at] + letter + word[at + 1 :]}[kind]
    if len(other) < 7 or other == word:
        return
    one, two = ((*spelling_variants.pivotal(w, frequency), w) for w in (word, other))
    a, b = sorted((one, two), key=lambda s: (s[2], s[3]))
    shifts = {0: (0,), 1: (0, 1), -1: (0, -1)}[len(b[3]) - len(a[3])]
    assert any((gram, place + shift) in b[1] for gram, place in a[0] for shift in shifts)
    assert set(spelling_variants.filed_under(a[3], a[0])) & set(spelling_variants.looked_up(b[3], b[1]))


def test_disjoint_grams_are_the_cheapest():
    draw = random.Random(3)
    for _ in range(200):
        grams = [(k, p) for k, p in enumerate(draw.sample(range(12), draw.randint(2, 7)))]
        costs = [draw.randint(0, 9) for _ in grams]
        pairs = [(costs[i] + costs[j], i, j) for i in range(len(grams)) for j in range(i) if abs(grams[i][1] - grams[j][1]) >= 2]
        found = spelling_variants.disjoint(grams, costs, 2)
        assert not pairs if not found else sum(costs[k] for k in found) == min(pairs)[0] and abs(grams[found[0]][1] - grams[found[1]][1]) >= 2


# fill in the middle


def middle_by_hand(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    spm = h4 % 100 < spm_rate
    return len(lines), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def hard_texts():
    draw = random.Random(11)
    texts = [None, "", "\n", "\n\n\n", "one line", "ends\n", "<P>", "a<S>b\nc", "x<M>", "<", "<P", "P>\n<S", "\n<", "aé中\U0001f600\n" * 5, "\r\n\x0b\x0c \n", "long\n" * 60_000, "no end " * 50_000, "<\nP>\n<\nM>"]
    return texts + ["".join(draw.choice("ab<>PSM\né\U0001f600") for _ in range(draw.randint(1, 40))) for _ in range(300)]


def test_middles_by_hand(spark):
    docs = of(spark, hard_texts()).unionByName(documents(spark, [(None, "no\nid\n", 1, "w", "v", "k", "o")] * 2))
    made = fill_in_middle.transformed(docs)
    found = sorted(tuple(r) for r in made.where("doc_id IS NOT NULL").collect())
    assert found == sorted((i, *middle_by_hand(i, t)) for i, t in enumerate(hard_texts()))
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    again = fill_in_middle.restored(made)
    assert sorted((r.doc_id, r.restored) for r in again.where("doc_id IS NOT NULL").collect()) == [(i, t or "") for i, t in enumerate(hard_texts())]
    assert [r.output for r in made.where("doc_id IS NULL").collect()] == [middle_by_hand(None, "no\nid\n")[-1]] * 2
    assert fill_in_middle.transformed(docs.limit(0)).count() == 0


def test_rates_of_middles(spark):
    docs = of(spark, ["a\nb\nc\n"] * 400)
    for rate, spm in ((0, 50), (30, 0), (100, 100)):
        found = {r.doc_id: r.output for r in fill_in_middle.transformed(docs, rate=rate, spm_rate=spm).collect()}
        assert found == {i: middle_by_hand(i, "a\nb\nc\n", rate, spm)[-1] for i in range(400)}


def test_middles_of_outputs_that_lack_sentinels(spark):
    rows = [("psm", "<P>a<S>b<M>c"), ("psm", "<P>a<M>b"), ("spm", "<P>a<S>b<M>c"), ("spm", "<S>b<P>a<M>c"), (None, "x<P>"), ("plain", None), ("psm", "")]
    found = fill_in_middle.restored(spark.createDataFrame(rows, "form string, output string").coalesce(1), ("form",)).collect()
    assert [r.restored for r in found] == ["acb", None, None, "acb", "x<P>", "", None]


def test_middles_equal_their_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = duck.sql(fill_in_middle.SQL)
    found = fill_in_middle.op12_displacement_scatter(spark, DATA)
    assert sorted(map(str, ([r[c] for c in want.columns] for r in found.collect()))) == sorted(map(str, map(list, want.fetchall())))


# embeddings


def links_by_hand(vectors, threshold=0.9):
    """Links, and the smallest id that each row reaches."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    unit = [np.array(v, float) / np.abs(v).max() if ok else None for (_, v), ok in zip(vectors, fine, strict=True)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(vectors)
    near = [[j for j in range(n) if j != i and fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    first = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first[i] = min((vectors[j][0] for j in seen if vectors[j][0] is not None), default=None)
    return sorted(((v[0], len(near[i]), first[i]) for i, v in enumerate(vectors)), key=str)


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "k", "leaf") for i, v in vectors], "vec_id long, embedding array<double>, label int, key string, leaf string")


def found_links(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.classes(df, **options).collect()), key=str)


def test_links_of_hard_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1e300, 1e299]), (10, [1e-310, 0.0]), (11, [1.0]), (12, [-1.0, 0.0]), (None, [0.0, 1.0]), (13, [0.1, 1.0]), (14, [1.0, 0.0, 0.0]), (15, [2.0, -0.0])]
    assert found_links(embeddings(spark, vectors)) == links_by_hand(vectors)
    assert embedding_dedup.classes(embeddings(spark, vectors[:1]).limit(0)).count() == 0
    assert found_links(embeddings(spark, vectors[:6])) == links_by_hand(vectors[:6])


def planted(seed=2, n=700, size=24):
    draw = np.random.default_rng(seed)
    rows = [v for v in draw.standard_normal((n, size))]
    for k, (many, noise) in enumerate([(2, 0.05), (5, 0.2), (40, 0.25), (260, 0.2)]):
        rows += [rows[k] + noise * draw.standard_normal(size) for _ in range(many)]
    rows += [rows[10]] * 30
    order = draw.permutation(len(rows))
    return [(int(i), rows[i].tolist()) for i in order]


@pytest.mark.parametrize("options", [{}, {"leaf": 64}, {"leaf": 64, "block": 16}])
def test_links_by_hand(spark, options):
    vectors = planted()
    found, want = found_links(embeddings(spark, vectors), **options), links_by_hand(vectors)
    if not options:
        assert found == want
    # trees of small leaves may part a pair, but find none that is no link, and the same components
    assert [(f[0], f[2]) for f in found] == [(w[0], w[2]) for w in want] and all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert sum(f[1] for f in found) >= 0.99 * sum(w[1] for w in want)


def test_balls_hold_linked_rows_alone(spark):
    draw = np.random.default_rng(4)
    near = draw.standard_normal(24) + 0.2 * draw.standard_normal((300, 24))
    rows = stage(embedding_dedup.different(embeddings(spark, list(enumerate(near.tolist()))), "vec_id", "embedding"), "vectors")
    placed = rows.select("key", F.lit(1).cast("long").alias("leaf"))
    found = embedding_dedup.balls(rows, placed, least=100).join(rows, "key").collect()
    values = np.array([np.frombuffer(r.vector) for r in found])
    assert len(values) > 1 and (values @ values.T >= embedding_dedup.THRESHOLD).all()
    assert embedding_dedup.balls(rows, placed, least=10**6) is None


def test_blocks_meet_once(spark):
    rows = [(k, leaf, 7 if leaf == 1 and k % 3 else None) for leaf in (1, 2) for k in range(100 if leaf == 1 else 9)]
    groups = defaultdict(dict)
    for r in embedding_dedup.dealt(spark.createDataFrame(rows, "key long, leaf long, ball long"), block=10).collect():
        groups[r.leaf, r.one, r.two][r.key] = r.home
    met = Counter()
    for (leaf, one, two), keys in groups.items():
        met.update((leaf, a, b) for a in keys for b in keys if a < b and (one == two or keys[a] != keys[b]))
    core = lambda leaf, k: leaf == 1 and k % 3
    assert met == {(leaf, a, b): 1 for leaf, n in ((1, 100), (2, 9)) for a in range(n) for b in range(a + 1, n) if not (core(leaf, a) and core(leaf, b))}


@pytest.mark.parametrize("many", [4, 60])
def test_shared_leaves(many):
    draw = np.random.default_rng(many)
    leaves = [np.unique(draw.integers(-50, 50, 6)) for _ in range(many)]
    one, two = np.nonzero(np.triu(np.ones((many, many), bool), 1))
    want = [any(x < 5 for x in set(leaves[a].tolist()) & set(leaves[b].tolist())) for a, b in zip(one, two, strict=True)]
    assert embedding_dedup._shared_before(leaves, one, two, 5).tolist() == want


def test_recall_next_to_the_threshold(spark):
    draw = np.random.default_rng(9)
    base = draw.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = draw.standard_normal((500, 64))
    away -= (away * base[:500]).sum(axis=1, keepdims=True) * base[:500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.905 * base[:500] + math.sqrt(1 - 0.905**2) * away
    df = embeddings(spark, list(enumerate(np.vstack([base, near]).tolist())))
    assert embedding_dedup.classes(df, leaf=128).agg(F.sum("n_links")).first()[0] >= 0.95 * 1000
