"""Spelling variants of words by pivotal grams.

Words are near if one inserted, deleted or replaced code point makes them equal. Bigrams are ordered from
the rarest among the words. A word's prefix is its three rarest bigrams; within it dynamic programming over their positions
chooses two disjoint ones of the smallest total frequency, its pivots. One edit cannot touch both, hence of two
near words one whose prefix does not end later has a pivot that the other one has in its prefix, shifted just as the lengths say.

The pivots are an index, which the prefixes look up. What the position of an edit leaves alone is part of the key: the edit
is before both pivots (all from the first one on is equal), behind both (all up to the end of the second one), between
them (both), or it touches one of them (all but that one; the other one is still there). A common bigram at a common place is
so no hot key, and what meets grows with the words rather than with the square of a bigram's words. ``levenshtein`` verifies
what is found. Nothing is capped: each near pair is found. Keys are 64-bit hashes from running hashes of the words' prefixes and suffixes, so long words take
linear time; words over ``INLINE`` code points travel by a hash of their own and are looked up to be verified.

Words are counted by Spark over all texts before any of this, so what is joined grows with the different
words. The table of bigrams that goes to the driver has at most 90 * 90 rows (26 letters and 64 code points).

A word's form is its near word of largest count if that is ``DOMINANCE`` times its own or more; counts grow tenfold
along the forms, so pointer doubling reaches every root within a few rounds.

Defined cases: a null or empty text has no words; a null id counts as the empty string; repeated rows count
as often as they occur; ties of the largest count go to the first word in code-point order; texts without words of that
length and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.tables import mapped, stage, table

LEAST_CHARS, LEAST_COUNT, DOMINANCE = 7, 2, 10
GRAM, EDITS = 2, 1
TYPO_EVERY = 31
#: Code points of words that travel with their keys, and keys of a batch.
INLINE, BATCH_KEYS = 40, 1 << 16
BEFORE, BETWEEN, BEHIND, TOUCHED = range(4)
_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A24C6E81
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters in lower case, one in 31 without one of its code points, by its document and a hash."""
    letters = f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_CHARS},}}"  # greedy, so these are whole runs; shorter ones make no word
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(letters), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    typo = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % TYPO_EVERY == 0, typo).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def disjoint(grams: list[tuple[int, int]], costs: list[int], many: int, width: int = GRAM) -> list[int]:
    """Indices of ``many`` grams (rank, position) of the smallest total cost whose places do not overlap, by dynamic programming over positions."""
    order = sorted(range(len(grams)), key=lambda i: grams[i][1])
    best: list[tuple[int, list[int]] | None] = [None] * len(order)  # the cheapest choice that ends with that gram
    for chosen in range(many):
        now: list[tuple[int, list[int]] | None] = []
        for i, gram in enumerate(order):
            if not chosen:
                now.append((costs[gram], [gram]))
                continue
            before = [b for k, b in enumerate(best[:i]) if b is not None and grams[order[k]][1] + width <= grams[gram][1]]
            cheapest = min(before, default=None)
            now.append(None if cheapest is None else (cheapest[0] + costs[gram], [*cheapest[1], gram]))
        best = now
    found = min((b for b in best if b is not None), default=None)
    return [] if found is None else found[1]


def pivotal(word: str, frequency: dict[str, int], edits: int = EDITS) -> tuple[list[tuple[str, int]], list[tuple[str, int]], tuple[int, str]]:
    """The word's pivots and its prefix, as (bigram, position), and the last bigram of the prefix as (frequency, bigram)."""
    grams = sorted((frequency.get(word[i : i + GRAM], 0), word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1))
    size = min(GRAM * edits + 1, len(grams))
    last = grams[size - 1][:2]
    for _ in range(GRAM * edits):  # repeats of the last one; an edit makes at most so many new grams that could come before a pivot's
        size += size < len(grams) and grams[size][:2] == last
    prefix = grams[:size]
    chosen = disjoint([(k, g[2]) for k, g in enumerate(prefix)], [g[0] for g in prefix], edits + 1)
    return [prefix[k][1:] for k in chosen], [g[1:] for g in prefix], last


def running(codes: list[int]) -> list[int]:
    """Hashes of all beginnings, from none to whole."""
    out = [0]
    for c in codes:
        out.append((out[-1] * _BASE + c + 1) % _MODULUS)
    return out


def _key(case: int, one: int, two: int, chars: int) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<BQQq", case, one, two, chars)) - (1 << 63)


def filed_under(word: str, pivots: list[tuple[str, int]]) -> list[int]:
    """The keys of its pivots."""
    codes, n = [*map(ord, word)], len(word)
    to, back = running(codes), running(codes[::-1])[::-1]  # of word[:i] and of word[i:]
    one, two = sorted(place for _, place in pivots)
    return [_key(BEFORE, 0, back[one], n), _key(BETWEEN, to[one + GRAM], back[two], n), _key(BEHIND, to[two + GRAM], 0, n), *(_key(TOUCHED, to[p], back[p + GRAM], 0) for p in (one, two))]


def looked_up(word: str, prefix: list[tuple[str, int]]) -> list[int]:
    """The keys under which near words can be filed, if their pivots are in its prefix."""
    codes, n = [*map(ord, word)], len(word)
    to, back = running(codes), running(codes[::-1])[::-1]
    places = sorted(place for _, place in prefix)
    seen = set()
    for chars in (n - 1, n, n + 1):
        for p in places:
            seen |= {_key(BEFORE, 0, back[p], chars), _key(BEHIND, to[p + GRAM], 0, chars)}
            seen.update(_key(BETWEEN, to[p + GRAM], back[q], chars) for q in places if q >= p + GRAM)
    for at in range(n):  # a touched gram is one code point less, as many, or one more
        for width in range(GRAM - 1, GRAM + 2):
            if at + width <= n and (places[-1] >= at + width or places[0] + GRAM <= at):
                seen.add(_key(TOUCHED, to[at], back[at + width], 0))
    return [*seen]


def signatures(words: DataFrame, frequency: dict[str, int], filed: bool) -> DataFrame:
    """(key, word) for what each word is filed under, or for what it looks up; long words by ``named``."""
    shared = words.sparkSession.sparkContext.broadcast(frequency)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[int] = []
        names: list[str] = []
        for batch in batches:
            for word in batch.column("word").to_pylist():
                pivots, prefix, _ = pivotal(word, shared.value)
                own = filed_under(word, pivots) if filed else looked_up(word, prefix)
                found += own
                names += [named(word)] * len(own)
                if len(found) > BATCH_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(names, pa.string())], names=["key", "word"])
                    found, names = [], []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(names, pa.string())], names=["key", "word"])

    return mapped(words.select("word"), rows, "key bigint, word string")


def named(word: str) -> str:
    """A word as it travels with its keys: a long one as its hash, marked by a sign that no word has."""
    return word if len(word) <= INLINE else f"#{xxhash.xxh3_128_hexdigest(word.encode())}"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), each pair of near words once. ``words`` (word, n) is written, as it is read several times."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)), lambda i: F.col("word").substr(i, F.lit(GRAM))))
    frequency = {r["gram"]: r["n"] for r in words.select(gram.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 90 * 90
    filed, seen = (signatures(words, frequency, way).select("key", F.col("word").alias(c)) for way, c in ((True, "a"), (False, "b")))
    long = F.col("a").startswith("#") | F.col("b").startswith("#")
    near = F.levenshtein("a", "b", EDITS) == 1
    met = filed.join(seen, "key").where((F.col("a") != F.col("b")) & (long | near)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), long.alias("long")).distinct()
    met = stage(met, "met")
    whole = mapped(words.where(F.char_length("word") > INLINE).select("word"), _renamed, "name string, word string")
    texts = lambda c: whole.select(F.col("name").alias(c), F.col("word").alias(f"{c}_word"))
    spelt = met.where("long").join(texts("a"), "a", "left").join(texts("b"), "b", "left").select(F.coalesce("a_word", "a").alias("a"), F.coalesce("b_word", "b").alias("b"))
    return met.where("NOT long").select("a", "b").unionByName(spelt.where(near))


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([named(w) for w in batch.column("word").to_pylist()], pa.string()), batch.column("word")], names=["name", "word"])


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near) for each word."""
    counts = lambda name: words.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    counted = pairs.join(counts("a"), "a").join(counts("b"), "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))))
    most = counted.select(ends.alias("e")).groupBy("e.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("e.other_n")).alias("less"), F.col("e.other").alias("other"))).alias("most"))
    takes = -F.col("most.less") >= DOMINANCE * F.col("n")
    return words.join(most, "word", "left").select("word", "n", F.when(takes, F.col("most.other")).alias("form"), F.when(takes, -F.col("most.less")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def rooted(formed: DataFrame) -> DataFrame:
    """``formed`` with root: where following forms ends. Each round doubles how far a word looks."""
    up = stage(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = stage(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return formed.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, form, form_n, n_near, root) for each word of the texts."""
    words = stage(word_counts(docs, doc_id, text), "words")
    return rooted(stage(forms(words, near_pairs(words)), "formed"))


def groups(found: DataFrame) -> DataFrame:
    """(root, n_words, n, most): of each root its variants, their occurrences, and its most frequent variant besides itself."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("word") == F.col("root"), F.desc("n"), "word"))
    own = found.withColumn("rank", rank)
    return own.groupBy("root").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n"), F.max(F.when((F.col("rank") == 1) & (F.col("word") != F.col("root")), F.col("word"))).alias("most"))


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
