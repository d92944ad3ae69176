"""Benchmark decontamination with a distributed positional inverted index.

``index`` keeps, for every training document, the postings of the terms that occur in the test items:
distinct terms, and the sorted positions of each. It is dealt by document, so that a document's
lists meet in one task, and written once. Spark counts how often each term occurs; for each test
window the terms are ordered from the rarest. ``matches`` takes the list of the rarest term as
candidate starts (position less the term's offset) and intersects them with the offset-adjusted list
of one rarer-first term after another until all terms of the window agree: an exact phrase. With
``slack`` above 0 it also reports proximity: the rarest terms agree within that many words.

Equal windows are one window, whatever items they are from; which items have them is joined to the finds afterwards, windows
of the same items together. The windows are taken in blocks of about ``BLOCK_WINDOWS``, each broadcast to one pass over
the index whose finds are written before the next, so neither side has to fit into memory. The index
holds the terms of the test items alone while these are at most ``VOCABULARY``, else all terms.

Defined cases: a null or empty text has no words and no hits; items without words match nothing; an
item shorter than a window is one window; equal items count once each; rows that share
an id are items of their own, reported under one name; equal rows get equal results; a null item_id is reported as an empty string; empty tables give no rows or no hits; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import words as W
from shelfcast.llm.tables import mapped, stage, table

WINDOW = 10
#: Windows of test items in one broadcast block: about 30 MB.
BLOCK_WINDOWS = 200_000
#: Different terms of the test items that are broadcast: 16 MB.
VOCABULARY = 2_000_000
RAREST = 3
#: Words by which the rarest terms of a window may be off for a match by proximity.
SLACK = 2


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, place): the words of the test items as 64-bit hashes; ``item`` is the id as text."""
    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch, "__text"):
                found = W.runs(data, offsets, W.ALNUM)
                hashed = W.hashes(data, found, W.LOWER)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.ListArray.from_arrays(found.of_text.astype(np.int32), pa.array(hashed.view(np.int64)))], names=["item", "terms"]
                )

    return mapped(source, rows, "item string, terms array<bigint>")


def different_items(item_terms: DataFrame) -> DataFrame:
    """Rows of equal id and words once, each with a ``key`` of its own (fixed once written): ids may recur."""
    return item_terms.distinct().withColumn("key", F.monotonically_increasing_id())


def vocabulary(item_terms: DataFrame) -> DataFrame:
    return item_terms.select(F.explode("terms").alias("term")).distinct()


def index(docs: DataFrame, terms: np.ndarray | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: row (a number of its own once written), doc_id, n_words, those of the given terms (none given: all) that it has, sorted, where their lists begin, and the positions."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(None if terms is None else np.sort(terms))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        row_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch, "__text"):
                found = W.runs(data, offsets, W.ALNUM)
                hashed = W.hashes(data, found, W.LOWER).view(np.int64)
                n = end - row
                wanted = np.unique(hashed) if given is None else given
                at = np.minimum(np.searchsorted(wanted, hashed), max(0, len(wanted) - 1))
                word = np.flatnonzero(wanted[at] == hashed) if len(wanted) else np.zeros(0, np.int64)
                of = np.repeat(np.arange(n), np.diff(found.of_text))[word]
                term, place = at[word], word - found.of_text[of]
                order = np.lexsort((place, term, of))
                of, term, place = of[order], term[order], place[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (term[1:] != term[:-1])
                lists, places = np.flatnonzero(new), np.searchsorted(of, np.arange(n + 1))
                own = np.searchsorted(of[lists], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row_id, row_id + n)),
                        batch.column(0).slice(row, n),
                        pa.array(np.diff(found.of_text)),
                        pa.ListArray.from_arrays(own.astype(np.int32), pa.array(wanted[term[lists]] if len(wanted) else np.zeros(0, np.int64))),
                        pa.ListArray.from_arrays(own.astype(np.int32), pa.array((lists - places[of[lists]]).astype(np.int32))),
                        pa.ListArray.from_arrays(places.astype(np.int32), pa.array(place.astype(np.int32))),
                    ],
                    names=["row", "doc_id", "n_words", "terms", "begins", "places"],
                )
                row_id += n

    return mapped(source, rows, f"row bigint, doc_id {kind}, n_words bigint, terms array<bigint>, begins array<int>, places array<int>")


def term_counts(indexed: DataFrame) -> DataFrame:
    """How often each term of the index occurs, in all documents."""
    ends = F.concat(F.slice("begins", F.lit(2), F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("places")))
    lists = indexed.where(F.size("terms") > 0).select(F.explode(F.zip_with("terms", F.zip_with(ends, "begins", lambda e, b: e - b), lambda t, n: F.struct(t.alias("term"), n.alias("n")))).alias("l"))
    return lists.groupBy("l.term").agg(F.sum("l.n").alias("n"))


def test_windows(item_terms: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, item, start, terms, offsets), rarest term first. Equal windows of an item stay apart by their number."""
    place = item_terms.select("key", "item", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    item = place.groupBy("key", "item").agg(F.array_sort(F.collect_list(F.struct("place", "term", "n"))).alias("words"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))))
    cut = item.withColumn("start", starts).select("key", "item", F.slice("words", F.col("start") + 1, size).alias("words"), "start")
    ranked = F.array_sort(F.transform("words", lambda w: F.struct(w["n"].alias("n"), (w["place"] - F.col("start")).alias("offset"), w["term"].alias("term"))))
    return cut.select("key", "item", "start", ranked.alias("words")).where(F.get("words", F.lit(0))["n"] > 0).select("key", "item", "start", F.col("words.term").alias("terms"), F.col("words.offset").alias("offsets"))


def different_windows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, terms, offsets) of the different windows, and (window, kin, item): the items of each, ``kin`` being the least window that has the same items."""
    own = stage(windows.select("terms", "offsets").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    owners = windows.join(own, ["terms", "offsets"]).select("window", "item").distinct()
    same = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b"))
    held = stage(owners.groupBy("window").agg(same.alias("same")), "window-items")
    kin = held.join(held.groupBy("same").agg(F.min("window").alias("kin")), "same").select("window", "kin")
    return own, stage(owners.join(kin, "window"), "owners")


class _Lists:
    """The posting lists of a batch: looked up by (document, term), and by (document, term, position)."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: np.ndarray) -> None:
        flat = lambda name: np.asarray(batch.column(name).flatten())
        sizes = np.asarray(pc.list_value_length(batch.column("terms")))
        spread = np.asarray(pc.list_value_length(batch.column("places")))
        self.n = batch.num_rows
        self.term = np.searchsorted(vocabulary, flat("terms"))
        self.doc = np.repeat(np.arange(self.n), sizes)
        self.place = flat("places").astype(np.int64)
        base = np.cumsum(spread) - spread
        self.begin = flat("begins") + base[self.doc]
        self.length = np.diff(np.append(self.begin, len(self.place)))
        self.many = len(vocabulary)
        self.far = int(self.place.max(initial=0)) + 1
        self.keys = (self.doc * self.many + self.term).astype(np.int64)
        self.full = np.repeat(self.keys, self.length) * self.far + self.place

    def has(self, doc: np.ndarray, term: np.ndarray, place: np.ndarray, slack: int = 0) -> np.ndarray:
        """Whether the list of that document and term has a position within ``slack`` of that one."""
        if not len(self.full):
            return np.zeros(len(doc), bool)
        key = (doc * self.many + term) * self.far
        low, high = np.maximum(place - slack, 0), np.minimum(place + slack, self.far - 1)
        at = np.searchsorted(self.full, key + low)
        return (low <= high) & (at < len(self.full)) & (self.full[np.minimum(at, len(self.full) - 1)] <= key + high)


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``sizes`` that add up to about ``limit``; a larger one is a run of its own."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def _candidates(lists: _Lists, rarest: np.ndarray, order: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, window, position of the window's rarest term) for all lists, in pieces of about ``limit``."""
    first, last = np.searchsorted(rarest[order], lists.term, "left"), np.searchsorted(rarest[order], lists.term, "right")
    some = np.flatnonzero(last > first)
    wide = (last - first)[some]
    for low, high in _pieces(wide, limit):
        many = wide[low:high]
        one = np.repeat(some[low:high], many)
        window = order[np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + first[one]]
        for at, end in _pieces(lists.length[one], limit):
            mine, long = one[at:end], lists.length[one[at:end]]
            row = np.repeat(np.arange(len(mine)), long)
            place = lists.place[np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long) + lists.begin[mine][row]]
            yield lists.doc[mine][row], window[at:end][row], place


def matches(indexed: DataFrame, windows: list, slack: int = 0) -> DataFrame:
    """For each document the windows found: (row, doc_id, n_words, found: array of (window, place, size, exact)).

    ``windows``: rows of ``different_windows``, a block of bounded size.
    """
    kind = indexed.schema["doc_id"].dataType.simpleString()
    vocabulary = np.unique(np.array([t for w in windows for t in w["terms"]], np.int64))
    terms = np.full((len(windows), WINDOW if not windows else max(len(w["terms"]) for w in windows)), -1, np.int64)
    offsets = np.zeros_like(terms)
    for i, w in enumerate(windows):
        terms[i, : len(w["terms"])], offsets[i, : len(w["terms"])] = np.searchsorted(vocabulary, w["terms"]), w["offsets"]
    numbers = np.array([w["window"] for w in windows], np.int64)
    shared = indexed.sparkSession.sparkContext.broadcast((vocabulary, terms, offsets, numbers, np.argsort(terms[:, 0], kind="stable") if windows else np.zeros(0, np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, terms, offsets, numbers, order = shared.value
        for whole in batches:
            for part in range(0, whole.num_rows, 512):
                batch = whole.slice(part, 512)
                known = _only(batch, vocabulary)
                lists = _Lists(known, vocabulary)
                hits: list[tuple[np.ndarray, ...]] = []
                for doc, window, place in _candidates(lists, terms[:, 0], order):
                    start = place - offsets[window, 0]
                    near = start >= 0
                    exact = near.copy()
                    for k in range(1, terms.shape[1]):
                        more = terms[window, k] >= 0
                        alive = np.flatnonzero(exact & more)
                        exact[alive] = lists.has(doc[alive], terms[window[alive], k], start[alive] + offsets[window[alive], k])
                        if slack and k < RAREST:
                            alive = np.flatnonzero(near & more)
                            near[alive] = lists.has(doc[alive], terms[window[alive], k], start[alive] + offsets[window[alive], k], slack)
                    keep = exact | near if slack else exact
                    hits.append((doc[keep], window[keep], start[keep], exact[keep]))
                doc, window, start, exact = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 4
                sort = np.argsort(doc, kind="stable")
                doc, window, start, exact = doc[sort], window[sort], start[sort], exact[sort].astype(bool)
                found = pa.StructArray.from_arrays(
                    [pa.array(numbers[window]), pa.array(start.astype(np.int32)), pa.array((terms[window] >= 0).sum(axis=1).astype(np.int32)), pa.array(exact)],
                    names=["window", "place", "size", "exact"],
                )
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words")), pa.ListArray.from_arrays(ends, found)], names=["row", "doc_id", "n_words", "found"])

    return mapped(indexed, rows, f"row bigint, doc_id {kind}, n_words bigint, found array<struct<window:bigint,place:int,size:int,exact:boolean>>")


def _only(batch: pa.RecordBatch, vocabulary: np.ndarray) -> pa.RecordBatch:
    """The batch with only the lists of those terms."""
    terms = np.asarray(batch.column("terms").flatten())
    if not len(terms) or not len(vocabulary):
        empty = np.zeros(batch.num_rows + 1, np.int32)
        none = pa.ListArray.from_arrays(empty, pa.array([], pa.int64()))
        small = pa.ListArray.from_arrays(empty, pa.array([], pa.int32()))
        return pa.RecordBatch.from_arrays([none, small, small], names=["terms", "begins", "places"])
    sizes = np.asarray(pc.list_value_length(batch.column("terms")))
    spread = np.asarray(pc.list_value_length(batch.column("places")))
    doc = np.repeat(np.arange(batch.num_rows), sizes)
    begin = np.asarray(batch.column("begins").flatten()) + (np.cumsum(spread) - spread)[doc]
    length = np.diff(np.append(begin, spread.sum()))
    keep = vocabulary[np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)] == terms
    places = np.asarray(batch.column("places").flatten())[np.repeat(keep, length)]
    doc, length, terms = doc[keep], length[keep], terms[keep]
    own = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
    ends = np.append(0, np.cumsum(length))[own].astype(np.int32)
    begins = (np.cumsum(length) - length - ends[:-1][doc]).astype(np.int32)
    cut = pa.ListArray.from_arrays
    return pa.RecordBatch.from_arrays([cut(own, pa.array(terms)), cut(own, pa.array(begins)), cut(ends, pa.array(places))], names=["terms", "begins", "places"])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", slack: int = SLACK, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, hits (word spans begin, end), items (with exact phrases), near_items (proximity only)."""
    item_terms = stage(different_items(item_words(items)), "items")
    terms = stage(vocabulary(item_terms), "vocabulary")
    few = terms.count() <= VOCABULARY
    indexed = stage(index(docs, np.array([r["term"] for r in terms.collect()], np.int64) if few else None, doc_id, text), "index")
    windows, owners = different_windows(stage(test_windows(item_terms, term_counts(indexed)), "test-windows"))
    many = max(1, ceil(windows.count() / block))
    part = F.pmod(F.xxhash64("window"), F.lit(many))
    # the written index has numbered its rows, so a document's finds of all blocks meet
    parts = [stage(matches(indexed, windows.where(part == k).collect(), slack).where(F.size("found") > 0).select("row", "found"), "finds") for k in range(many)]
    finds = reduce(DataFrame.unionByName, parts)
    spans = F.array_distinct(F.transform(F.filter("found", lambda f: f["exact"]), lambda f: F.struct(f["place"].alias("begin"), (f["place"] + f["size"]).alias("end"))))
    hits = finds.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(spans)))).alias("hits"))
    kin = owners.select("window", "kin").distinct()
    met = finds.select("row", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f["window"].alias("window"), f["exact"].alias("exact"))))).alias("f")).select("row", "f.window", "f.exact").join(kin, "window")
    named = owners.where("window = kin").select("kin", "item")
    by_item = met.groupBy("row", "kin").agg(F.max("exact").alias("exact")).join(named, "kin").groupBy("row", "item").agg(F.max("exact").alias("exact"))
    listed = by_item.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_list(F.when(~F.col("exact"), F.col("item")))).alias("near_items"))
    none = {"hits": "array<struct<begin:int,end:int>>", "items": "array<string>", "near_items": "array<string>"}
    found = indexed.select("row", "doc_id", "n_words").join(hits.join(listed, "row"), "row", "left")
    return found.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()))


def hit_words(hits: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(h["end"] - F.greatest(a["end"], h["begin"]), F.lit(0))).alias("n"), F.greatest(a["end"], h["end"]).alias("end"))
    return F.aggregate(hits, start, step, lambda a: a["n"])


#: Hashes of contaminated texts that may be broadcast: 32 MB.
BROADCAST_ROWS = 4_000_000


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, any others) in which no window of an item occurs."""
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.col("text").cast("string")))
    found = contamination(hashed.select(F.col("__text_hash").alias("doc_id"), "text"), items, slack=0)
    gone = stage(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("__text_hash")).distinct(), "contaminated")
    small = gone.count() <= BROADCAST_ROWS
    return hashed.join(F.broadcast(gone) if small else gone, "__text_hash", "left_anti").drop("__text_hash")


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join(F.array_sort("near_items"), ","), 256).alias("near_items_sha256"),
    )


SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(ws[s + 1 : s + size], ' ') AS gram FROM (SELECT item, ws, least(10, len(ws)) AS size, unnest(range(0, greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0)),
dw AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
sizes AS (SELECT DISTINCT size FROM win),
g AS (SELECT k, i, size, array_to_string(d.ws[i : i + size - 1], ' ') AS gram FROM dw JOIN d USING (k), sizes WHERE i + size - 1 <= len(d.ws)),
m AS (SELECT k, i, size, item FROM g JOIN win USING (size, gram)),
h AS (SELECT k, count(DISTINCT i + o) AS n_hit FROM m, range(10) AS r(o) WHERE o < size GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM m) GROUP BY k),
bn AS (SELECT row_number() OVER () AS q, item, ws FROM (SELECT DISTINCT item, ws FROM b WHERE len(ws) > 0)),
cnt AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
wo AS (SELECT q, item, s, o, ws[s + o + 1] AS w FROM (SELECT q, item, ws, s, unnest(range(0, least(10, len(ws)))) AS o FROM (SELECT q, item, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS s FROM bn))),
rk AS (SELECT q, item, s, o, w, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY q, s ORDER BY coalesce(n, 0), o) AS r FROM wo LEFT JOIN cnt USING (w)),
tri AS (SELECT DISTINCT item, w1, o1, w2, o2 - o1 AS d2, w3, o3 - o1 AS d3 FROM (SELECT item, max(w) FILTER (WHERE r = 1) AS w1, max(o) FILTER (WHERE r = 1) AS o1, max(w) FILTER (WHERE r = 2) AS w2, max(o) FILTER (WHERE r = 2) AS o2,
  max(w) FILTER (WHERE r = 3) AS w3, max(o) FILTER (WHERE r = 3) AS o3 FROM rk GROUP BY q, item, s HAVING min(n) > 0)),
c1 AS (SELECT k, i, item, w2, d2, w3, d3 FROM tri JOIN dw ON w = w1 WHERE i - 1 >= o1),
c2 AS (SELECT * FROM c1 WHERE w2 IS NULL UNION ALL SELECT c1.* FROM c1 SEMI JOIN (SELECT k, w, i + o AS i FROM dw, (VALUES (-2), (-1), (0), (1), (2)) AS v(o)) AS e ON e.k = c1.k AND e.w = c1.w2 AND e.i = c1.i + c1.d2),
c3 AS (SELECT * FROM c2 WHERE w3 IS NULL UNION ALL SELECT c2.* FROM c2 SEMI JOIN (SELECT k, w, i + o AS i FROM dw, (VALUES (-2), (-1), (0), (1), (2)) AS v(o)) AS e ON e.k = c2.k AND e.w = c2.w3 AND e.i = c2.i + c2.d3),
nr AS (SELECT k, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_names FROM (SELECT DISTINCT k, item FROM c3 ANTI JOIN m USING (k, item)) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near_names, '')) AS near_items_sha256
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k) LEFT JOIN nr USING (k)"""
