"""Each stage of the pipeline against a brute-force version over the smallest tables, odd rows included."""

from test_text_operators import hit_by_hand, measured_by_hand, similarity, words_of

import corpus_pipeline
from shelfcast.llm.tables import stage

DATA = "/root/testdata/sf0.001"


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.where("doc_id IN (0, 3)")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, "12 34 " * 30, "en", "s", 0)], docs.schema)
    copies = some.selectExpr("doc_id + 800000 AS doc_id", "concat(text, ' end') AS text", "lang", "source", "n_chars")
    given = stage(docs.unionByName(odd).unionByName(copies), "given")
    stages = [function for _, function in corpus_pipeline.STAGES]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, kept = rows(given), stage(stages[0](spark, given, DATA), "kept")
    after = rows(kept)
    for doc_id, text in before.items():
        n_words, _, n_symbols, _, n_repeat = measured_by_hand(text)
        if n_words < 20 or 100 * n_repeat > 30 * n_words or 5 * n_symbols > n_words:
            assert doc_id not in after

    before, kept = after, stage(stages[1](spark, kept, DATA), "kept")
    after = rows(kept)
    assert all(i in after for i, t in before.items() if sum(c.isalpha() for c in t) > 200)

    before, kept = after, stage(stages[2](spark, kept, DATA), "kept")
    parent = {i: i for i in before}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words_of(t)) for i, t in before.items())}
    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if shingles[i] & shingles[j] and similarity(before[i], before[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    after = rows(kept)
    assert set(after) == {root(i) for i in ids}

    before, kept = after, stage(stages[3](spark, kept, DATA), "kept")
    after = rows(kept)
    assert set(after) == {i for i, t in before.items() if not hit_by_hand(t, items)[1]}

    pieces = stages[4](spark, kept, DATA).collect()
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert set(tokens) == set(after)
    for i in after:
        assert sum(p.length for p in pieces if p.doc_id == i) == tokens[i]
