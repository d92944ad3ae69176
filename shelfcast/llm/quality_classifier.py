"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Each token has a sparse ternary index vector drawn from its hash. A token's vector is its index vector,
that of its shape (its case, digits or punctuation) and the sum of its neighbours' index vectors in all
documents, gathered by Spark in ``SLOTS`` hashed slots, which tokens may share. A document is the mean of
its tokens' vectors, plain and with damped counts, and a few measures of length and repetition. A
network with one hidden layer is trained in NumPy on the driver, on about ``SAMPLE_ROWS`` labelled
rows, and its probabilities are calibrated by a temperature found on rows kept apart from training.

Defined cases: a null or empty text is the vector of a text without tokens and gets a score like any
other; documents labelled twice take part with their mean label, rounded; without labels of both
kinds the score is the share of label 1 (0.5 if there are none); ties and equal rows get equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import language_id
from shelfcast.llm.tables import mapped, stage, table

SAMPLE_ROWS = 6_000
#: Slots of context sums, slots in one row of the shuffle, and tokens summed at once.
SLOTS, SLOT_BLOCK, CHUNK = 1 << 16, 64, 1 << 16
DIMENSIONS, NONZERO, REACH = 64, 4, 2
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 40, 3e-3, 1e-4, 128
CALIBRATION_SHARE = 0.2
THRESHOLD = 0.3
KEPT_TOKENS = 200_000
MEASURES = 5
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text or "")


def shape(token: str) -> str:
    """The class of a token by its look, with a leading blank so that no token equals it."""
    if token.isupper():
        return " X" if len(token) > 1 else " X1"
    if token.islower():
        return " x"
    if token.istitle():
        return " Xx"
    if token.isdigit():
        return " 9"
    return " w" if token[:1].isalnum() else f" {token[:1]}{min(len(token), 4)}"


def index_vector(token: str, dimensions: int = DIMENSIONS, nonzero: int = NONZERO) -> np.ndarray:
    out = np.zeros(dimensions, np.float32)
    draw = xxhash.xxh3_128_intdigest(token.encode("utf-8", "replace"))
    for _ in range(nonzero):
        draw, at = divmod(draw, 2 * dimensions)
        out[at >> 1] += 1 if at & 1 else -1
    return out


def drawn(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The index vectors of tokens, as ``index_vector`` has them, and their slots."""
    digest = np.array([xxhash.xxh3_128_intdigest(t.encode("utf-8", "replace")) & (1 << 60) - 1 for t in names], np.int64)
    out, row, bits = np.zeros((len(names), DIMENSIONS), np.int8), np.arange(len(names)), (2 * DIMENSIONS).bit_length() - 1
    for k in range(NONZERO):
        at = digest >> bits * k & 2 * DIMENSIONS - 1
        out[row, at >> 1] += np.where(at & 1, 1, -1).astype(np.int8)
    return out, (digest >> bits * NONZERO) % SLOTS


@dataclass
class Vectors:
    """Vectors of all tokens."""

    context: np.ndarray  # by slot
    shapes: dict[str, np.ndarray] = field(default_factory=dict)

    def of(self, names: list[str]) -> np.ndarray:
        own, slot = drawn(names)
        looks = [shape(t) for t in names]
        for look in set(looks) - self.shapes.keys():
            self.shapes[look] = index_vector(look)
        return own + np.array([self.shapes[look] for look in looks], np.float32) + self.context[slot]


class _Numbers(dict):
    """Numbers tokens in order of arrival; ``new`` are those not looked at yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.new.append(token)
        return number


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array``, or a larger copy, with ``more`` from row ``used`` on."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros((used + 2 * len(more), *array.shape[1:]), array.dtype)])
    array[used : used + len(more)] = more
    return array


class Pool:
    """Document vectors; remembers the place of each token's vector."""

    def __init__(self, vectors: Vectors) -> None:
        self.vectors = vectors
        self._forget()

    def _forget(self) -> None:
        self.place = _Numbers()
        self.table = np.zeros((0, DIMENSIONS), np.float32)

    def __call__(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        counts = Counter(found)
        out = np.zeros(2 * DIMENSIONS + MEASURES, np.float32)
        out[-1] = np.log1p(len(found)) / 10
        if not counts:
            return out
        if len(self.place) > KEPT_TOKENS:
            self._forget()
        n = np.fromiter(counts.values(), np.float32, len(counts))
        at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
        if new := self.place.new:
            self.table = _grown(self.table, len(self.place) - len(new), self.vectors.of(new))
            self.place.new = []
        small = np.log1p(n)
        rows = self.table[at]
        out[:DIMENSIONS], out[DIMENSIONS : 2 * DIMENSIONS] = n @ rows / n.sum(), small @ rows / small.sum()
        same = sum(map(str.__eq__, found, found[1:]))
        lines = [line for line in (text or "").split("\n") if line]
        out[-5:-1] = len(counts) / len(found), n.max() / len(found), same / len(found), 1 - len(set(lines)) / max(1, len(lines))
        return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]  # weights and biases of both layers
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.center) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(0), np.zeros(0), (), 1.0, float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(seed)
    apart = draw.random(len(y)) < CALIBRATION_SHARE
    if not apart.any() or apart.all() or y[~apart].min() == y[~apart].max():
        apart = np.zeros(len(y), bool)
    own, mark = x[~apart], y[~apart].astype(np.float32)
    center, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    own = (own - center) / scale
    params = [draw.normal(0, (2 / own.shape[1]) ** 0.5, (own.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(mark))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            a, t = own[rows], mark[rows]
            h = np.maximum(a @ params[0] + params[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - t) / len(rows)
            back = np.outer(error, params[2]) * (h > 0)
            step += 1
            for k, g in enumerate((a.T @ back + DECAY * params[0], back.sum(axis=0), h.T @ error + DECAY * params[2], error.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Network(center, scale, tuple(params), 1.0)
    if apart.any():
        logits, t = model.logits(x[apart]), y[apart]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(t == 1, -logits, logits) / g).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(text, quality) of about ``bound`` labelled documents, or all if there are fewer, outside of the held-out fold."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    total = docs.select("doc_id").join(marks, "doc_id").count()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(language_id.drawn(total, bound, "doc_id", "text"))
    return rows.join(marks, "doc_id").select("text", "quality")


class _Contexts:
    """Sums of the neighbours' index vectors by slot."""

    def __init__(self) -> None:
        self.sums = np.zeros((SLOTS, DIMENSIONS), np.int32)
        self._forget()

    def _forget(self) -> None:
        self.place = _Numbers()
        self.place[""] = 0  # between texts
        self.index, self.slot = np.zeros((1, DIMENSIONS), np.int8), np.zeros(1, np.int64)

    def add(self, ids: list[int]) -> None:
        """Numbers of tokens, with ``REACH`` zeros before, between and after texts."""
        if new := self.place.new:
            used = len(self.place) - len(new)
            index, slot = drawn(new)
            self.index, self.slot = _grown(self.index, used, index), _grown(self.slot, used, slot)
            self.place.new = []
        whole = np.array(ids, np.int64)
        for low in range(0, len(whole) - 2 * REACH, CHUNK):
            part = whole[low : low + CHUNK + 2 * REACH]
            n = len(part) - 2 * REACH
            vectors, mine = self.index[part], part[REACH : REACH + n]
            near = sum(vectors[k : k + n] for k in range(2 * REACH + 1) if k != REACH)
            real = np.flatnonzero(mine)
            order = real[np.argsort(self.slot[mine[real]], kind="stable")]
            slot = self.slot[mine[order]]
            starts = np.flatnonzero(np.diff(slot, prepend=-1))
            if len(starts):
                self.sums[slot[starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int32)
        if len(self.place) > KEPT_TOKENS:
            self._forget()


def context_vectors(docs: DataFrame) -> Vectors:
    """Context sums of all tokens of all documents, by slot."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, gap = _Contexts(), [0] * REACH
        ids = gap.copy()
        for batch in batches:
            for text in batch.column("text"):
                ids.extend(map(contexts.place.__getitem__, tokens(text.as_py())))
                ids += gap
                if len(ids) > CHUNK:
                    contexts.add(ids)
                    ids = gap.copy()
        contexts.add(ids)
        some = np.flatnonzero(contexts.sums.any(axis=1))
        blocks, begins = np.unique(some // SLOT_BLOCK, return_index=True)
        ends = np.append(begins, len(some))[1:]
        slots = [(some[low:high] % SLOT_BLOCK).astype(np.uint8).tobytes() for low, high in zip(begins, ends, strict=True)]
        sums = [contexts.sums[some[low:high]].tobytes() for low, high in zip(begins, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(slots, pa.binary()), pa.array(sums, pa.binary())], names=["block", "slots", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, slots, sums in zip(*(batch.column(c).to_pylist() for c in ("block", "slots", "sums")), strict=True):
                if block not in total:
                    total[block] = np.zeros((SLOT_BLOCK, DIMENSIONS), np.int64)
                total[block][np.frombuffer(slots, np.uint8)] += np.frombuffer(sums, np.int32).reshape(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    parts = mapped(docs.select(F.col("text").cast("string").alias("text")), gathered, "block bigint, slots binary, sums binary")
    context = np.zeros((SLOTS, DIMENSIONS), np.float32)
    for r in mapped(parts.repartition("block"), added, "block bigint, sums binary").collect():  # at most SLOTS vectors: 16 MB; as many tasks as there are shuffle partitions, up to one for each block
        context[r["block"] * SLOT_BLOCK : (r["block"] + 1) * SLOT_BLOCK] = np.frombuffer(r["sums"], np.float32).reshape(SLOT_BLOCK, DIMENSIONS)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return Vectors(2 * context / np.where(length > 0, length, 1))


def _pooled(batches: Iterator[pa.RecordBatch], vectors: Vectors) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    pool = Pool(vectors)
    for batch in batches:
        for part in range(0, batch.num_rows, 1024):
            rows = batch.slice(part, 1024)
            yield rows, np.array([pool(t.as_py()) for t in rows.column("text")], np.float32).reshape(rows.num_rows, 2 * DIMENSIONS + MEASURES)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> tuple[Vectors, Network]:
    sample = stage(labelled_sample(docs, labels, bound).repartition(8), "labelled")
    vectors = context_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pooled(batches, shared.value):
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], names=["quality", "vector"])

    found = sorted((bytes(r["vector"]), r["quality"]) for r in mapped(sample, rows, "quality int, vector binary").collect())  # bounded
    x = np.array([np.frombuffer(v, np.float32) for v, _ in found], np.float64).reshape(len(found), 2 * DIMENSIONS + MEASURES)
    return vectors, train(x, np.array([q for _, q in found]))


def score(docs: DataFrame, model: tuple[Vectors, Network], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the score, for each row."""
    source = docs.select(*keep, F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + ["score double"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for part, x in _pooled(batches, vectors):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(network.score(x.astype(np.float64)).astype(np.float64))], names=[*keep, "score"])

    return mapped(source, rows, schema)


def op8_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
