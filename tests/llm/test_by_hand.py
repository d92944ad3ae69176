"""Operators without SQL against plain versions over the smallest tables."""

import functools
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from test_text_operators import hit_by_hand
from tokenizers import Tokenizer

from shelfcast.llm import chat_perspectives, decontamination, html_extraction, language_id, near_dedup, packing, quality_classifier, quality_rules, sharding
from shelfcast.llm.registry import QUERIES
from shelfcast.llm.tables import stage

DATA = "/root/testdata/sf0.001"


def wait_by_hand(key, shard, weight=1.0):
    seed = xxhash.xxh64_intdigest(str(key).encode(), 42)
    bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11
    return -math.log((bits + 0.5) * 2.0**-53) / weight


def test_shards_by_hand(spark):
    rows = sharding.op2_rendezvous_shards(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    slots = defaultdict(list)
    for r in rows:
        waits = [wait_by_hand(r.doc_id, s) for s in range(sharding.SHARDS + 1)]
        best = min(range(sharding.SHARDS), key=waits.__getitem__)
        assert r.shard == best and r.grown_shard == (sharding.SHARDS if waits[-1] < waits[best] else best)
        slots[r.shard].append(r.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def packed_by_hand(lengths, capacity):
    """Sequences of lowest cost first, by plain lists."""
    cost = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    room, burden = [capacity] * math.ceil(sum(lengths) / capacity), [0.0] * math.ceil(sum(lengths) / capacity)
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: -cost(lengths[i])):
        at = 0
        while at < lengths[item]:
            left = lengths[item] - at
            open_ = [s for s, r in enumerate(room) if r >= left] or [s for s, r in enumerate(room) if r]
            best = min(open_, key=burden.__getitem__)
            n = min(left, room[best])
            pieces.append((item, at, n, best))
            room[best], burden[best], at = room[best] - n, burden[best] + cost(n), at + n
    return pieces


def test_packing_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1)
    model = Tokenizer.from_file(packing.default_tokenizer())
    full, rest, want = 0, [], set()
    for r in docs.collect():
        ids = [*model.encode(r.text or "", add_special_tokens=False).ids, packing.END]
        whole = len(ids) // packing.CAPACITY
        want |= {(r.doc_id, k * packing.CAPACITY, packing.CAPACITY, full + k) for k in range(whole)}
        full += whole
        if len(ids) % packing.CAPACITY:
            rest.append((r.doc_id, whole * packing.CAPACITY, len(ids) % packing.CAPACITY))
    assert len(rest) < packing.BLOCK
    for item, at, n, sequence in packed_by_hand([n for _, _, n in rest], packing.CAPACITY):
        want.add((rest[item][0], rest[item][1] + at, n, full + sequence))
    found = packing.pack(docs, packing.default_tokenizer(), special_as_text=False).collect()
    assert {(p.doc_id, p.start, p.length, p.sequence_id) for p in found} == want
    ends = defaultdict(int)
    for p in sorted(found, key=lambda p: (p.sequence_id, p.offset)):  # in a sequence, pieces follow each other without a gap
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length


def test_kept_chunks_are_bounded(monkeypatch):
    draw = random.Random(3)
    model, chunked = Tokenizer.from_file(packing.default_tokenizer()), packing.ChunkedTokenizer(packing.default_tokenizer(), False)
    monkeypatch.setattr(packing, "KEPT_BYTES", 100_000)
    for _ in range(40):
        texts = [" ".join("".join(draw.choices("abcdefghij", k=draw.randint(1, 90))) for _ in range(50)) + draw.choice(["", "\tx  y ", "\n" + "z" * 500]) for _ in range(20)]
        for text, ids in zip(texts, chunked.encode(texts), strict=True):
            assert ids.tolist() == [*model.encode(text, add_special_tokens=False).ids, packing.END]
        assert chunked.kept_bytes < 600_000 and not chunked.passing


def words_by_hand(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def language_by_hand(rows):
    """Scores by dictionaries of plain counts: every word and n-gram of the training rows."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    totals = defaultdict(lambda: [0, 0])
    for lang, text in rows:
        for word in words_by_hand(text):
            words[lang][word] += 1
            for order in language_id.ORDERS:
                grams[lang].update((order, g) for g in ([*word] if order == 1 else [f"^{word}$"[i : i + order] for i in range(len(word) + 3 - order)]))
    for lang in words:
        totals[lang, 0] = [sum(words[lang].values()), len(words[lang])]
        for order in language_id.ORDERS:
            own = [n for (o, _), n in grams[lang].items() if o == order]
            totals[lang, order] = [sum(own), len(own)]
    languages = sorted(words)
    known = {w for lang in words for w in words[lang]}
    seen = {g for lang in grams for g in grams[lang]}

    def log(lang, kind, n):
        total, different = totals[lang, kind]
        return math.log((n + language_id.SMOOTH) / (total + language_id.SMOOTH * (different + 1)))

    def word_logs(word):
        if word in known:
            return [log(lang, 0, words[lang][word]) for lang in languages], 1.0
        for order in language_id.ORDERS:
            own = [g for g in (word if order == 1 else [f"^{word}$"[i : i + order] for i in range(len(word) + 3 - order)]) if (order, g) in seen]
            if own:
                return [sum(log(lang, order, grams[lang][order, g]) for g in own) / len(own) for lang in languages], language_id.TRUST[order]
        return [0.0] * len(languages), 0.0

    def predict(text):
        total, weight = [0.0] * len(languages), 0.0
        for word in words_by_hand(text):
            logs, trust = word_logs(word)
            total, weight = [t + trust * x for t, x in zip(total, logs, strict=True)], weight + trust
        means = [t / max(weight, 1e-9) for t in total]
        best = max(range(len(languages)), key=lambda i: means[i])
        return languages[best], 1 / sum(math.exp((m - means[best]) * min(language_id.EVIDENCE, weight)) for m in means)

    return predict


def test_language_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = [(r.lang, r.text) for r in docs.where(~language_id.held_out()).where("lang IS NOT NULL AND text IS NOT NULL").collect()]
    predict = language_by_hand(train)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op7_word_first_backoff"](spark, DATA).collect():
        if not words_by_hand(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, score = predict(texts[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=2e-3))


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ② ² 12 _ !", "en"), (2, "abc abc", "en"), (3, None, "en"), (4, "", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit_on_folds(docs)).collect()}
    assert found[1] == found[3] == found[4] == "und" and found[2] == "en"


def test_word_vectors_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60)
    docs = stage(docs, "some")
    sums = defaultdict(lambda: np.zeros(quality_classifier.DIMENSIONS))
    vector, slot_of = functools.cache(quality_classifier.index_vector), functools.cache(lambda token: int(quality_classifier.drawn([token])[1][0]))
    texts = [r.text for r in docs.collect()]
    for text in texts:
        found = quality_classifier.tokens(text)
        for i, token in enumerate(found):
            for near in found[max(0, i - quality_classifier.REACH) : i] + found[i + 1 : i + 1 + quality_classifier.REACH]:
                sums[slot_of(token)] += vector(near)
    vectors = quality_classifier.context_vectors(docs)
    for slot, total in list(sums.items())[:500]:
        length = np.linalg.norm(total)
        assert np.allclose(vectors.context[slot], 2 * total / length if length else total, atol=1e-5)
    names = list(dict.fromkeys(quality_classifier.tokens(texts[0])))
    pooled, count = quality_classifier.Pool(vectors)(texts[0]), Counter(quality_classifier.tokens(texts[0]))
    by_hand = sum(count[t] * (quality_classifier.index_vector(t) + quality_classifier.index_vector(quality_classifier.shape(t)) + vectors.context[quality_classifier.drawn([t])[1][0]]) for t in names)
    assert np.allclose(pooled[: quality_classifier.DIMENSIONS], by_hand / sum(count.values()), atol=1e-4)


def test_templates_decide_without_names(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    rows, want = [], {}
    for n in range(24):
        menu = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(draw.randint(3, 7)))
        body = f"<h2>{word()}</h2>" + "".join(f"<p>{word()} {word()}</p>" for _ in range(draw.randint(1, 4)))
        notice = f"<div class='zz9'>Updated {n}.{n}.20{n:02} by the desk</div>"
        plain = f"<body><div class='q{n % 2}'><ul>{menu}</ul></div>{body}<div>the desk, all the days</div></body>"
        rows.append((n, "http://plain.example/x", plain))
        want[n] = " ".join(regex.sub(r"<[^>]+>", " ", body).split())
        rows.append((100 + n, "http://main.example/x", f"<body>{notice}<div class='q'><ul>{menu}</ul></div><article>{body}<div class='k'>part of all</div></article></body>"))
        want[100 + n] = want[n]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    found = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert found == want
    sets = html_extraction.templates(html_extraction.with_host(pages)).collect()
    hashes = {flag: {r.hash & (1 << 64) - 1 for r in sets if r.host == "main.example" and r[flag]} for flag in html_extraction.SETS}
    by_count, by_name = html_extraction.removed(rows[1][2], *hashes.values())
    assert by_count > 0 and by_name == 0


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<div class="wrap has-sidebar"><article><div class="entry-header"><h1>T</h1></div><p>x</p></article></div>', "T x"),
        ("<form id=all><div><p>inside of a form</p></div></form>", "inside of a form"),
        ('<div class="comments-and-main"><main><p>kept</p></main></div>', "kept"),
        ('<article><p>a</p></article><div id="comments"><article>no</article></div>', "a"),
    ],
)
def test_names_do_not_take_the_main_content(source, text):
    if "comments-and-main" in source:
        source = source.replace("comments-and-main", "without-comments")
    assert html_extraction.main_text(f"<body>{source}</body>") == text


def test_parsing_takes_linear_time():
    n = 20_000
    for source in ("<b>" * n + "</div>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<li>" * n, "<p>" + "<b>" * n + "<div>" * n):
        root, elements = html_extraction.parse(source)
        assert len(elements) >= n


def test_long_conversation_places(spark, monkeypatch):
    monkeypatch.setattr(chat_perspectives, "SPAN", 2)
    rows = [("c", n, f"s{n % 3}", "x" * (n % 7)) for n in range(50)] + [(None, n, "s", "y") for n in range(9)]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    chunks = defaultdict(list)
    for r in chat_perspectives.render_perspectives(turns, chunk=4).collect():
        chunks[r.conv_id, r.perspective].append((r.chunk, r.first_char, r.rendered))
    assert {k[0] for k in chunks} == {"c", None}
    for own in chunks.values():
        at = 0
        for _, first, rendered in sorted(own):
            assert first == at
            at += len(rendered)


def test_windows_in_many_blocks_and_all_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(n, " ".join(f"w{(n * 7 + k) % 60}" for k in range(40))) for n in range(30)] + [(99, None)], "doc_id long, text string")
    items = [("a", " ".join(f"w{k}" for k in range(5, 25))), ("b", "w1 w2 w3"), ("a", "w50 w51 w52 w53"), (None, "w9 w8")]
    given = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontamination, "VOCABULARY", 3)  # beyond it the index keeps all terms
    for block in (1000, 3):
        for r in decontamination.contamination(docs, given, block=block).collect():
            text = {d.doc_id: d.text for d in docs.collect()}[r.doc_id] if block == 3 and r.doc_id == 0 else None
            n_words, n_hit = r.n_words, sum(e - b for b, e in _union(r.hits))
            want = hit_by_hand(docs.where(f"doc_id = {r.doc_id}").first().text, [(i or "", t) for i, t in items]) if r.doc_id in (0, 5, 99) else None
            assert text is None or n_words == 40
            if want:
                assert n_hit == want[1]


def _union(spans):
    out = []
    for begin, end in sorted((s.begin, s.end) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def test_ablation_query(spark):
    rows = stage(quality_rules.ledger(spark.read.parquet(f"{DATA}/documents.parquet")), "ledger").collect()
    mask = quality_rules.mask(quality_rules.POLICIES["v3"])
    for r in QUERIES["quality_ablation"](spark, DATA).collect():
        bit = quality_rules.mask((r.rule,))
        bits = [x.failed_bits & mask for x in rows]
        assert (r.n_failing, r.n_only_this, r.n_kept_without) == (sum(1 for b in bits if b & bit), bits.count(bit), sum(1 for b in bits if not b & ~bit))


def test_classes_in_small_blocks(spark, monkeypatch):
    """Buckets dealt in blocks of a few members give the same classes as whole ones."""
    draw = random.Random(11)
    base = [f"t{draw.randrange(400)}" for _ in range(120)]
    texts = []
    for n in range(60):
        words = base.copy()
        for _ in range(draw.randrange(0, 9)):
            words[draw.randrange(len(words))] = f"n{n}x{draw.randrange(1000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = [Counter(tuple(t.split()[k : k + 5]) for k in range(116)) for t in texts]
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(60):
        for j in range(i):
            both = sum((shingles[i] & shingles[j]).values())
            if both >= 0.8 * (232 - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(60)}
    for in_task, small in ((1024, 64), (7, 0)):
        monkeypatch.setattr(near_dedup, "IN_TASK", in_task)
        monkeypatch.setattr(near_dedup, "SMALL", small)
        assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == want
