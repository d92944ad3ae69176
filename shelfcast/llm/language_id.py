"""Language identification with word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, marked at the word's ends: the longest order of which any is known decides, down
to single characters. A document's language is the best by the mean over its words.

Word and n-gram counts are Spark aggregates over a bounded, documented sample of the labelled rows
(about ``SAMPLE_ROWS`` and ``SAMPLE_CHARS``, drawn by a hash of the row); n-grams are counted on the different words.
Nothing counted is dropped: if the counts are more than ``MODEL_COUNTS``, the sample is halved. The model keeps them
as sorted hashes with, for each, only the languages in which it was seen, so it does not grow with the
number of languages alone. Every whole text is scored.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned;
equal texts get equal results; ties go to the language first in order; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.tables import mapped, stage, table

SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 100_000_000
#: Counts of a word or n-gram in a language that the model may hold: about 320 MB.
MODEL_COUNTS = 20_000_000
ORDERS = (5, 4, 3, 2, 1)
#: Weight of a word that is scored by n-grams of these orders, against a known one.
TRUST = {5: 0.8, 4: 0.7, 3: 0.5, 2: 0.3, 1: 0.1}
SMOOTH = 0.5
#: Words that count as independent in the score.
EVIDENCE = 12
#: Log frequencies kept for words that were met, in all languages together.
KEPT_LOGS = 2_000_000
#: Different words counted in Python before Spark adds them up.
COUNTED_WORDS = 50_000
UNKNOWN = "und"
#: Letters with their marks; numerals such as ½ are none.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


@dataclass
class Model:
    """Sorted hashes of known words and n-grams; of each the languages in which it was seen, with the log frequencies there."""

    languages: list[str]
    items: np.ndarray
    begins: np.ndarray  # of each item's entries, then their number
    seen_in: np.ndarray
    logs: np.ndarray
    unseen: np.ndarray  # log frequency of what was not seen, by kind and language

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The items of those hashes; -1 if there is none."""
        if not len(self.items):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.items, hashes), len(self.items) - 1)
        return np.where(self.items[at] == hashes, at, -1)

    def frequencies(self, kind: int, at: np.ndarray) -> np.ndarray:
        """Log frequencies of these items, a column for each language."""
        out = np.repeat(self.unseen[kind][None], len(at), axis=0)
        many = self.begins[at + 1] - self.begins[at]
        row = np.repeat(np.arange(len(at)), many)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.begins[at][row]
        out[row, self.seen_in[entry]] = self.logs[entry]
        return out


def hashed(items: Iterable[str], kind: int) -> np.ndarray:
    seed = kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF  # small seeds would let short items of two kinds collide
    return np.array([xxhash.xxh3_64_intdigest(i.encode("utf-8", "replace"), seed) for i in items], np.uint64).view(np.int64)


def marked(word: str, order: int) -> list[str]:
    """The n-grams of a word with marks at its ends; single characters without them."""
    if order == 1:
        return [*word]
    word = f"^{word}$"
    return [word[i : i + order] for i in range(len(word) - order + 1)]


def _counted_words(sample: DataFrame) -> DataFrame:
    """(lang, word, n), counted in batches before Spark sums them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in words.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall((text.as_py() or "").lower()))
            if sum(map(len, words.values())) > COUNTED_WORDS:
                yield from flush()
        yield from flush()

    return mapped(sample.select("lang", "text"), rows, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(words: DataFrame) -> DataFrame:
    """(lang, kind, item, n) of words (kind 0) and n-grams (their order), as hashes, from (lang, word, n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], Counter] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                found.setdefault((lang, 0), Counter())[word] += n
                for order in ORDERS:
                    own = found.setdefault((lang, order), Counter())
                    for gram in marked(word, order):
                        own[gram] += n
            for (lang, kind), items in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array([kind] * len(items), pa.int32()), pa.array(hashed(items, kind)), pa.array(items.values(), pa.int64())], names=["lang", "kind", "item", "n"])

    return mapped(words, rows, "lang string, kind int, item bigint, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def drawn(total: int, bound: int, *by: str) -> Column:
    """Whether a row is among about ``bound`` of ``total`` rows, by a hash of these columns."""
    return F.lit(True) if total <= bound else F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(bound / total * (1 << 30))


def fit(rows: DataFrame, bound: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, most: int = MODEL_COUNTS) -> Model:
    """From (lang, text) and what else tells rows apart when they are drawn; about ``bound`` rows and ``chars`` characters, so that at most ``most`` counts come to the driver."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    total, long = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    bound = min(bound, total, max(1, total * chars // max(long, 1)))
    while True:
        counts = stage(_counted(stage(_counted_words(known.where(drawn(total, bound, *known.columns))), "language-words")), "language-counts")
        if counts.count() <= most or bound <= 1:
            break
        bound //= 2
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()
    languages = sorted({r["lang"] for r in totals})
    number = {lang: i for i, lang in enumerate(languages)}
    sums = np.zeros((1 + max(ORDERS), len(languages)))
    for r in totals:
        sums[r["kind"], number[r["lang"]]] = r["n"] + SMOOTH * (r["d"] + 1)
    unseen = np.log(SMOOTH / np.where(sums > 0, sums, SMOOTH))
    numbers = F.array_position(F.array(*map(F.lit, languages)) if languages else F.array().cast("array<string>"), F.col("lang")) - 1
    table_ = counts.select(numbers.cast("int").alias("lang"), "kind", "item", "n").toArrow()
    lang, kind, item, n = (np.asarray(table_.column(c)) for c in ("lang", "kind", "item", "n"))
    order = np.lexsort((lang, item))
    lang, kind, item, n = lang[order], kind[order], item[order], n[order]
    begins = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    logs = np.log((n + SMOOTH) / sums[kind, lang]) if len(item) else np.zeros(0)
    return Model(languages, item[begins], np.append(begins, len(item)), lang.astype(np.int32), logs.astype(np.float32), unseen.astype(np.float32))


class _Scorer:
    """Scores texts; remembers the rows (log frequencies times weight, weight) of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1), np.float32)

    def _learn(self, new: list[str]) -> None:
        first, model, place = len(self.place), self.model, self.place
        if first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((first + len(new) + len(self.table), self.table.shape[1]), np.float32)])
        for word in new:
            place[word] = len(place)
        left = np.arange(len(new))  # words that nothing has scored yet
        for kind in (0, *ORDERS):
            if not len(left):
                return
            items = [[new[i]] if kind == 0 else marked(new[i], kind) for i in left]
            at = model.place(hashed(chain.from_iterable(items), kind))
            word = np.repeat(np.arange(len(left)), [len(own) for own in items])[at >= 0]
            at = at[at >= 0]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            if len(at):
                scored, trust = word[starts], TRUST.get(kind, 1.0)
                means = np.add.reduceat(model.frequencies(kind, at), starts) / np.diff(np.append(starts, len(at)))[:, None]
                self.table[first + left[scored], :-1], self.table[first + left[scored], -1] = means * trust, trust
                left = np.delete(left, scored)

    def score(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_LETTERS.findall((text or "").lower()))
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.place) * len(self.model.languages) > KEPT_LOGS:
            self.forget()
        if new := [word for word in counts if word not in self.place]:
            self._learn(new)
        n = np.fromiter(counts.values(), np.float64, len(counts))
        total = n @ self.table[np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))]
        weight = max(total[-1], 1e-9)
        logs = total[:-1] / weight
        best = int(np.argmax(logs))
        return self.model.languages[best], float(1 / np.exp((logs - logs[best]) * min(EVIDENCE, weight)).sum())


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score, for each row."""
    column = text if text in keep else "__text"
    source = docs.select(*keep, *([] if text in keep else [F.col(text).alias("__text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"] + ["lang_pred string", "score double"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return mapped(source, rows, schema)


def fit_on_folds(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select("doc_id", "lang", "text"))


def op7_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_on_folds(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
