"""Packing, pages, conversations, the classifier and the pipeline, with the odd cases."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfcast.llm import chat_perspectives, html_extraction, packing, quality_classifier
from shelfcast.llm.tables import stage
from shelfcast.llm.registry import ORACLES, QUERIES

TEXTS = ["plain words in a line", None, "", "word " * 3000, "tab\tand  two blanks \n end ", "a\nb\n\nc\n\n\nd", "É's don't <|endoftext|> 12 漢字 \U0001f600", "x" * 6000, "repeated line\n" * 40]


def test_chunked_tokens_are_the_tokenizers():
    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "é", "1", "'s", "!", "　", "\x85", "\x1c", "<|endoftext|>", "​", "\r\n", "漢"]
    texts = [t or "" for t in TEXTS] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    mine = packing.ChunkedTokenizer(packing.default_tokenizer())
    for got, want in zip(mine.encode(texts) + mine.encode(texts), model.encode_batch(texts, add_special_tokens=False) * 2, strict=True):
        assert got.tolist() == [*want.ids, packing.END]


def test_queries_leave_the_tokenizer_as_it_is(spark, tmp_path):
    model = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two\nthree", "end <|endoftext|>.", "plain <|endoftext| >"]
    want = [[*model.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    assert [x.tolist() for x in packing.ChunkedTokenizer(packing.default_tokenizer(), special_as_text=False).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (packing.op5_cost_balanced_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        assert {r.doc_id: r.doc_tokens for r in found.collect()} == {i: len(w) for i, w in enumerate(want)}


def test_packed_is_balanced_and_tight():
    draw = random.Random(2)
    lengths = [draw.randint(1, 2047) for _ in range(900)]
    room, cost = defaultdict(int), defaultdict(float)
    for n, parts in zip(lengths, packing.packed(lengths), strict=True):
        assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == list(np.cumsum([0, *(p[2] for p in parts)])[:-1])
        for s, _, length in parts:
            room[s] += length
            cost[s] += packing.cost(length)
    assert max(room.values()) <= 2048 and len(room) == -(-sum(lengths) // 2048)
    assert max(cost.values()) < 1.6 * np.mean([*cost.values()])
    assert packing.packed([]) == [] and packing.packed([2047]) == [[(0, 0, 2047)]]


def test_pack_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(2)
    pieces = packing.pack(docs, packing.default_tokenizer(), with_ids=True).collect()
    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    places, found = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length
        places[p.sequence_id].append((p.offset, p.length))
        found[p.doc_id].append((p.start, [*struct.unpack(f"<{p.length}I", bytes(p.ids))], p.doc_tokens))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    want = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)} | {None: [*model.encode("no id", add_special_tokens=False).ids, 1]}
    for doc, ids in want.items():
        own = sorted(found[doc])
        copies = 2 if doc == 0 else 1
        assert [x for _, part, _ in own for x in part] == ids * copies and {n for _, _, n in own} == {len(ids)}
    assert packing.pack(docs.where("false"), packing.default_tokenizer()).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/x>menu</a><li>more</ul></nav><div class="cookie-notice">We use cookies</div><div class="box"><span>{template}</span></div>
<article><h1>Title &amp; {n}</h1><p>First<br>line of <b>bold</b>ness{n}<p>Second&nbsp;one &lt;x&gt;<aside>aside</aside><ul><li>i{n}<li>i2</ul><div class="share-buttons">share</div><div class="strip">{template}</div><table><tr><td>c{n}<td>c2</table></article>
<section id="comments"><article class="comment"><p>I disagree</p></article></section><form>mail <input></form><footer>&copy; foot</footer></body></html>"""


def test_pages(spark):
    rows = [(n, f"https://www.Site.example:8080/{n}", PAGE.format(n=n, template="All rights reserved by us"), 5) for n in range(20)]
    rows += [(100, None, None, 1), (101, "no url", "", 1), (102, "http://b.example", "only <i>text</i> &amp; no end <p", 1), (103, "http://b.example", "<div>a<p>b<div>c</div>d</p>e", 1), (0, rows[0][1], rows[0][2], 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    found = defaultdict(list)
    for r in html_extraction.extract(pages).collect():
        found[r.page_id].append(r.text)
    for n in range(20):
        assert found[n] == [f"Title & {n} First line of boldness{n} Second one <x> i{n} i2 c{n} c2"] * (2 if n == 0 else 1)
    assert found[100] == [""] and found[101] == [""] and found[102] == ["only text & no end"] and found[103] == ["a b c d e"]
    assert html_extraction.extract(pages.where("false")).count() == 0


def test_articles_that_recur_stay(spark):
    rows = [(n, "http://copies.example/a", PAGE.format(n=7, template="own")) for n in range(30)]
    found = {r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert found == {"Title & 7 First line of boldness7 Second one <x> i7 i2 own c7 c2"}


def test_pages_without_main_content(spark):
    plain = "<html><body><div id=top><ul><li>Home<li>Shop</ul></div><h2>Summary</h2><div class=x><p>{0}</p><p>As they say</p><table><tr><td>yes<td>{0}</table></div></body></html>"
    rows = [(n, "http://plain.example/a", plain.format(f"own {n}" if n >= 10 else "copied")) for n in range(40)]
    wrapped = "<html><body><div id=all><article><h1>One</h1><p>same text</p></article></div></body></html>"
    rows += [(100 + n, "http://wrapped.example/a", wrapped) for n in range(12)]
    rows += [(200 + n, "http://copies.example/a", plain.format("same")) for n in range(12)]
    rows += [(300 + n, "http://mixed.example/a", f"<body><div id=top>Menu</div><article>text {n}</article></body>") for n in range(12)]
    rows += [(400, "http://mixed.example/a", "<body><div id=top>Menu</div><p>landing</p></body>")]
    found = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for n in range(40):
        own = f"own {n}" if n >= 10 else "copied"
        assert found[n] == f"Summary {own} As they say yes {own}"
    assert {found[100 + n] for n in range(12)} == {"One same text"}
    assert {found[200 + n] for n in range(12)} == {"Home Shop Summary same As they say yes same"}
    assert [found[300 + n] for n in range(12)] == [f"text {n}" for n in range(12)] and found[400] == "landing"


def test_malformed_pages_end():
    for source in ("<a " + '"' * 30_000, "<p>" * 5_000 + "x", "<div>" * 5_000, '<a x="' * 2_000, "<" * 10_000, "</p>" * 5_000, "<script>" * 300, "&#0;&#x110000;&amp"):
        assert isinstance(html_extraction.main_text(source), str)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", 0), (1, 1, "ann", "hi <|im_end|>", 0), (1, 2, "bob", None, 0), (1, 3, "ann", "bye", 0), (2, 0, "system", "alone", 0), (None, None, None, "x", 0), (3, None, "u", "last", 0), (3, 5, "u", "first", 0)]
    rows += [(4, n, ["u", "v"][n % 2], f"turn {n}", 0) for n in range(200)] + [(4, 7, "v", "turn 7", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    found = defaultdict(list)
    for r in chat_perspectives.render_perspectives(turns).collect():
        found[r.conv_id, r.perspective].append(r)
    assert set(found) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "u"), (4, "u"), (4, "v")}
    whole = {}
    for key, parts in found.items():
        parts.sort(key=lambda r: r.chunk)
        whole[key] = "".join(r.rendered for r in parts)
        assert [r.first_char for r in parts] == list(np.cumsum([0, *(len(r.rendered) for r in parts)])[:-1])
    masked = {key: [whole[key][m.begin : m.end] for r in parts for m in r.mask] for key, parts in found.items()}
    assert whole[1, "ann"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert masked[1, "ann"] == ["hi < |im_end|><|im_end|>", "bye<|im_end|>"] and masked[1, "bob"] == ["<|im_end|>"]
    assert masked[3, "u"] == ["first<|im_end|>", "last<|im_end|>"]
    assert len(found[4, "u"]) == 4 and len(masked[4, "v"]) == 101
    assert chat_perspectives.render_perspectives(turns.where("false")).count() == 0


def test_quality_classifier(spark):
    draw = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))  # noqa: E731, B023
        rows.append((i, " ".join(word() if good else word().upper() + "!!" for _ in range(40)), "x"))
        marks.append((i, int(good), 0))
    docs = spark.createDataFrame(rows + [(1000, None, "x"), (1001, "", "x"), (None, "?", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert len(found) == 403 and all(0 <= s <= 1 for s in found.values())
    assert np.mean([(found[i] >= 0.5) == bool(good) for i, good, _ in marks]) > 0.97
    assert model[1].temperature > 0
    alone = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_classifier.score(docs, alone).collect()} == {1.0}
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert quality_classifier.score(docs.where("false"), model).count() == 0


def test_all_words_of_all_documents_have_vectors(spark):
    texts = ["rare words stand in one text", None, "", "alone", "no label here , yet words count", "rare words again and again ; again"] + [f"word{i} next{i % 7}" for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    vectors, _ = quality_classifier.fit(docs.repartition(3), spark.createDataFrame([(0, 1), (3, 0)], "doc_id int, quality int"))
    want = np.zeros_like(vectors.context)
    for text in texts:
        found = quality_classifier.tokens(text)
        for i, slot in enumerate(quality_classifier.drawn(found)[1]):
            for j in range(max(0, i - 2), min(len(found), i + 3)):
                want[slot] += quality_classifier.index_vector(found[j]) * (i != j)
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(vectors.context, 2 * want / np.where(norm > 0, norm, 1), atol=1e-5)
    a, b = vectors.of(["label", "stand"])
    assert (a != b).any() and (quality_classifier.drawn(["label"])[0][0] == quality_classifier.index_vector("label")).all()


DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    from shelfcast.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.op7_word_first_backoff(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier.op8_random_indexing(spark, "/root/testdata/sf0.01").join(marks, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.93


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, None, None, None, None)], docs.schema)
    kept = docs.unionByName(odd)
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, kept, DATA)
        assert after.columns == docs.columns
        after = stage(after, "test")
        assert not Counter(map(tuple, after.collect())) - Counter(map(tuple, kept.collect()))
        kept = after
    assert kept.count() > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("position", range(5))
def test_pipeline_stages_on_nothing(spark, position):
    none = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[position][1](spark, none, DATA).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
