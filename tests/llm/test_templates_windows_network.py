"""Site templates against recounts, windows that items share, and the network by hand."""

import hashlib
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import decontamination, html_extraction, language_id, quality_classifier

PAGES = "page_id int, url string, html string"


@pytest.mark.parametrize("source", ["<script>" + "</script " * 100_000, "<title>" + "</title" * 100_000, "<style>" + "</style\n" * 100_000 + ">", "<a " + '="' * 100_001, "<p class='a" * 50_000, "<textarea>" + "</textareas>" * 50_000])
def test_hostile_pages_take_linear_time(source):
    began = time.process_time()
    html_extraction.main_text(source)
    assert time.process_time() - began < 2


@pytest.mark.parametrize(("source", "text"), [("<p>a</p><script>x</scriptx> y</script ><p>b</p>", "a b"), ("<p>a</p><script>x</SCRIPT\n><p>b</p>", "a b"), ("<p>a</p><style>x</style", "a"), ("<p>a</p><script>never closed<p>b</p>", "a")])
def test_raw_elements_end_at_their_own_tag(source, text):
    assert html_extraction.main_text(source) == text


@pytest.mark.parametrize("name", ["share-price", "ad-hoc", "search-history", "login-problem", "research-header", "related-work", "social-policy", "table-header", "menu-design", "reply-letter", "has-sidebar", "no-comments"])
def test_parts_of_names_decide_nothing(name):
    page = f"<body><article><h1>T</h1><p class='{name}'>one</p><div id='{name}'>two</div><label>three</label> <span class='search-term'>four</span></article></body>"
    assert html_extraction.main_text(page) == "T one two three four"
    assert html_extraction.main_text(f"<body><div><h1>T</h1><p class='{name}'>one</p></div></body>") == "T one"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<main><h1>Big</h1><p>long body text here</p><section><article><h3>Teaser</h3><p>short</p></article></section></main>", "Big long body text here Teaser short"),
        ("<nav>n</nav><div class='content'><h1>Big</h1><p>the long body text</p></div><div class='cards'><article><h3>T</h3>short</article><article>x</article></div><footer>f</footer>", "Big the long body text"),
        ("<div>aside of some words</div><article><p>an article that is longer than what stands beside it</p></article>", "an article that is longer than what stands beside it"),
        ("<article><p>one of two</p></article><div>x</div><article><p>two of two</p></article>", "one of two two of two"),
        ("<article><p>kept</p><section class='comments'><p>gone</p></section><div class='related-posts'>gone</div><div class='share-buttons'><a>gone</a></div><div class='newsletter'>gone<form>x</form></div></article>", "kept"),
        ("<div class='cookie-banner'>gone</div><div class='site-header'>gone</div><div><p>kept</p></div><div class='sidebar-left'>gone</div>", "kept"),
    ],
)
def test_main_part_is_chosen_by_its_text(source, text):
    assert html_extraction.main_text(f"<html><body>{source}</body></html>") == text


def constructed(host, n, kind):
    for i in range(n):
        body = f"<h1>Title {host} {i}</h1><p>body text number {i} of {host} with words w{i * 7} x{i * 13}</p>"
        extra = f"<div class='promo'>today {i % 3}</div>" if kind != "plain" else "<div><b>Buy</b> now and here</div>"
        main = f"<article>{body}<div class='notice'>notice {i}</div></article>" if kind == "article" else f"<div class='c'>{body}</div>"
        yield f"https://{host}/{i}", f"<html><body><div class='top'><a href='/a'>A</a><a href='/b'>B</a><a href='/c'>C</a></div>{main}{extra}</body></html>"


def test_counts_equal_a_recount(spark):
    sites = [("one.example", 20, "article"), ("two.example", 20, "plain"), ("few.example", 5, "plain")]
    rows = [(i, *page) for i, page in enumerate(p for site in sites for p in constructed(*site))]
    rows += [(len(rows) + k, *rows[0][1:]) for k in range(3)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    found = {(r.host, r.hash & (1 << 64) - 1): r for r in html_extraction.templates(html_extraction.with_host(pages)).collect()}
    inside, beside, exact, shapes, names, total = (defaultdict(lambda: defaultdict(set)) for _ in range(6))
    for page_id, url, source in rows:
        host = url.split("/")[2]
        root, elements = html_extraction.parse(source)
        total[host]["n"].add(page_id)
        plain = all(e.main is None for e in elements)
        for e in elements:
            if e.tag not in html_extraction.BLOCK or e.tag in html_extraction.VOID:
                continue
            if e.main is not None:
                inside[host][e.hash].add((page_id, e.main.hash))
                if e.attributes and html_extraction._named_inside(e):
                    names[host][html_extraction._name_hash(e)].add(page_id)
            elif plain or not e.holds_main:
                exact[host][e.hash].add((page_id, root.hash))
                if not plain:
                    beside[host][e.loose].add((page_id, root.hash))
                if not plain or html_extraction._link_list(e):
                    shapes[host][e.shape].add(page_id)
    for host in total:
        n = len(total[host]["n"])
        of_shapes = {h for counts in (shapes, names) for h, p in counts[host].items() if len(p) >= 8 and 2 * len(p) >= n}
        assert {h for (g, h), r in found.items() if g == host and r.shape} == of_shapes
        articles = {m for seen in inside[host].values() for _, m in seen}
        strict = {h for h, seen in inside[host].items() if len({m for _, m in seen}) >= 8 and 2 * len({m for _, m in seen}) >= len(articles)}
        assert {h for (g, h), r in found.items() if g == host and r.strict} == strict
        loose = {h for h in {*beside[host], *exact[host], *inside[host]} if len({p for c in (beside, exact, inside) for p, _ in c[host].get(h, ())}) >= max(8, 0.05 * n)}
        assert {h for (g, h), r in found.items() if g == host and r.loose} >= loose - {h for h in loose if n < 8}
    texts = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    changed = sum(html_extraction.main_text(source) != texts[i] for i, _, source in rows)
    assert changed >= 40  # all pages of the two hosts with enough of them
    assert all("Buy" not in texts[i] and "notice" not in texts[i] and "A B C" not in texts[i] for i, url, _ in rows if "few" not in url)
    assert all(f"words w{int(url.rsplit('/', 1)[1]) * 7}" in texts[i] for i, url, _ in rows)


def contaminated_by_hand(text, items, size=10):
    words = lambda t: __import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    own, hit, met = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        for s in range(max(1, len(theirs) - size + 1) if theirs else 0):
            window = theirs[s : s + size]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    met.add(name)
    return len(own), len(hit), sorted(met)


def test_items_that_share_windows(spark):
    common = "the following question has exactly one right answer choose it with care"
    items = [(f"i{k}", f"{common} item {k % 7} asks about thing {k}") for k in range(120)] + [("short", "one right answer"), ("twin", f"{common} item 3 asks about thing 3")]
    texts = [f"intro {common} item 3 asks about thing 3 end", common, f"{common} item 5 asks", None, "nothing of it", "x one right answer y", f"{common} {common} item 118 asks about thing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontamination.BLOCK_WINDOWS, 9):
        rows = decontamination.contamination(docs, bench, block=block).withColumn("n_hit", decontamination.hit_words(F.col("hits"))).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows} == {i: contaminated_by_hand(t, items) for i, t in enumerate(texts)}


def test_equal_windows_are_one(spark):
    items = spark.createDataFrame([(f"i{k}", "a b c d e f g h i j k l") for k in range(50)] + [("other", "c d e f g h i j k l m n")], "item_id string, text string")
    terms = decontamination.different_items(decontamination.item_words(items)).cache()
    counts = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    own, owners = decontamination.different_windows(decontamination.test_windows(terms, counts))
    assert own.count() == 5 and owners.select("window", "item").count() == 50 * 3 + 3
    # windows 0 and 1 have the same fifty items, window 2 has all
    assert sorted(Counter(r.kin for r in owners.select("window", "kin").distinct().collect()).values()) == [1, 2, 2]


def test_candidates_come_in_pieces():
    class Lists:
        term, doc = np.array([0, 1, 0, 2]), np.array([0, 0, 1, 1])
        length, begin = np.array([2, 1, 3, 1]), np.array([0, 2, 3, 6])
        place = np.arange(7) * 10

    rarest = np.array([0, 0, 2, 0, 5])
    order = np.argsort(rarest, kind="stable")
    want = sorted((d, w, p) for t, d, n, b in zip(Lists.term, Lists.doc, Lists.length, Lists.begin, strict=True) for w, r in enumerate(rarest) if r == t for p in Lists.place[b : b + n])
    for limit in (1, 3, 1000):
        pieces = list(decontamination._candidates(Lists, rarest, order, limit))
        assert sorted((int(d), int(w), int(p)) for piece in pieces for d, w, p in zip(*piece, strict=True)) == [tuple(map(int, x)) for x in want]
        assert len(pieces) > 1 or limit == 1000


def trained_by_hand(x, y, epochs, seed=7):
    """The same network, a row and a weight at a time."""
    q = quality_classifier
    draw = np.random.default_rng(seed)
    apart = draw.random(len(y)) < q.CALIBRATION_SHARE
    own, mark = x[~apart], y[~apart]
    center, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    d = x.shape[1]
    weights = [draw.normal(0, (2 / d) ** 0.5, (d, q.HIDDEN)), np.zeros(q.HIDDEN), draw.normal(0, q.HIDDEN**-0.5, q.HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0

    def forward(row):
        z = [(row[i] - center[i]) / scale[i] for i in range(d)]
        h = [max(0.0, sum(z[i] * weights[0][i, j] for i in range(d)) + weights[1][j]) for j in range(q.HIDDEN)]
        return z, h, sum(h[j] * weights[2][j] for j in range(q.HIDDEN)) + weights[3][0]

    for _ in range(epochs):
        order = draw.permutation(len(mark))
        for at in range(0, len(order), q.BATCH):
            rows = order[at : at + q.BATCH]
            grads = [q.DECAY * weights[0], np.zeros(q.HIDDEN), q.DECAY * weights[2], np.zeros(1)]
            for r in rows:
                z, h, out = forward(own[r])
                error = (1 / (1 + math.exp(-out)) - mark[r]) / len(rows)
                for j in range(q.HIDDEN):
                    grads[2][j] += h[j] * error
                    if h[j] > 0:
                        grads[1][j] += error * weights[2][j]
                        for i in range(d):
                            grads[0][i, j] += z[i] * error * weights[2][j]
                grads[3][0] += error
            step += 1
            for k, g in enumerate(grads):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - q.RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logits = [forward(row)[2] for row in x[apart]]
    loss = lambda t: sum(math.log1p(math.exp(-v / t if m else v / t)) for v, m in zip(logits, y[apart], strict=True))
    grid = [0.25 * 32 ** (k / 60) for k in range(61)]
    return weights, min(grid, key=loss), lambda row, t: 1 / (1 + math.exp(-forward(row)[2] / t))


def test_network_and_temperature_by_hand(monkeypatch):
    monkeypatch.setattr(quality_classifier, "EPOCHS", 3)
    monkeypatch.setattr(quality_classifier, "HIDDEN", 5)
    monkeypatch.setattr(quality_classifier, "BATCH", 16)
    draw = np.random.default_rng(3)
    x = draw.standard_normal((90, 4))
    y = (x[:, 0] - x[:, 1] * x[:, 2] + 0.5 * draw.standard_normal(90) > 0).astype(int)
    model = quality_classifier.train(x, y)
    weights, temperature, score = trained_by_hand(x, y, 3)
    for own, hand in zip(model.layers, weights, strict=True):
        assert np.allclose(np.ravel(own), np.ravel(hand), atol=1e-9)
    assert model.temperature == pytest.approx(temperature, rel=1e-6)
    assert np.allclose(model.score(x[:20]), [score(row, temperature) for row in x[:20]])


def test_context_sums_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.createDataFrame([(f"word{i % 11} next{i % 7} end{i}",) for i in range(200)], "text string")
    one, many = (quality_classifier.context_vectors(docs.repartition(n)).context for n in (1, 9))
    assert np.allclose(one, many, atol=1e-6)


def test_model_of_many_languages(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda lang, k: "".join(alphabet[int(c, 16) + lang % 10] for c in hashlib.md5(f"{lang}-{k}".encode()).hexdigest()[:6])
    rows = [(i, f"l{lang:03d}", " ".join(word(lang, k) for k in range(30))) for i, lang in enumerate(range(100))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id int, lang string, text string"))
    assert len(model.languages) == 100 and len(model.seen_in) < 100 * 30 * 40
    probe = spark.createDataFrame([(lang, " ".join(word(lang, k) for k in range(0, 30, 3))) for lang in range(0, 100, 9)], "doc_id int, text string")
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in language_id.predict(probe, model).collect())


def test_model_is_halved_until_it_fits(spark):
    rows = spark.createDataFrame([(i, "en" if i % 2 else "de", " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest()[:8].translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(3))) for i in range(400)], "doc_id int, lang string, text string")
    whole, small = language_id.fit(rows), language_id.fit(rows, most=9000)
    assert 0 < len(small.seen_in) <= 9000 < len(whole.seen_in)
    assert len(language_id.fit(rows, chars=2000).seen_in) < len(whole.seen_in)
