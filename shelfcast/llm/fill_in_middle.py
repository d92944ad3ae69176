"""Fill-in-the-middle transformation by displacement scatter.

A text is cut into lines, and two cuts between lines make prefix, middle and suffix, which are put in
another order with sentinels between. Nothing is sliced or joined text by text: the bytes of a whole slice
of an Arrow batch are one array. A difference array holds at each part's first byte by how much its
displacement differs from that of the part before; the cumulative sum is the displacement of every byte, and
one scatter writes all outputs of the slice. ``restored`` finds the sentinels in the outputs, builds
the displacements the other way round and gathers the original bytes.

Cuts and forms come from the SHA-256 of the seed and the document's id, so they do not depend on how rows are
dealt. Memory is bounded by a slice (256 kB, or one longer text).

Defined cases: a null text is empty; an empty text, one that contains a sentinel, and those outside of ``rate``
stay plain (output = text, no middle); a text without line end is one line; a null id counts as the empty
string; equal rows get equal results; an empty table gives no rows; other columns are ignored. ``restored``
gives null for an output that lacks a sentinel of its form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import words as W
from shelfcast.llm.tables import mapped, table

SEED = 7
#: Percent of the documents that are transformed, and of these that put the suffix first.
RATE, SPM_RATE = 100, 50
#: Three-byte sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WIDTH = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of sentinels that lie in one text, their middle letters and their texts."""
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) >= WIDTH else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + WIDTH <= offsets[text + 1]
    return at[inside], data[at[inside] + 1], text[inside]


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin, followed by the text's end, for all texts in one array; and the first entry of each text in it."""
    starts, ends = offsets[:-1], offsets[1:]
    after = np.flatnonzero(data == 0x0A) + 1
    inner = after[~np.isin(after, ends)]  # a line end at the end of its text begins no line
    filled = np.flatnonzero(ends > starts)
    text = np.concatenate([filled, np.searchsorted(offsets, inner, "right") - 1, np.arange(len(starts))])
    place = np.concatenate([starts[filled], inner, ends])
    kind = np.repeat([0, 0, 1], [len(filled), len(inner), len(starts)])
    order = np.lexsort((kind, place, text))
    return place[order], np.searchsorted(text[order], np.arange(len(starts) + 1))


def spread(size: int, begins: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The displacement of every byte: parts begin at ``begins`` (ascending, empty parts too) with these displacements."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:size])


def scattered(data: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs; ``low`` and ``high`` are the cuts' places in ``data``."""
    start, end, moved = offsets[:-1], offsets[1:], form != PLAIN
    length = end - start + 3 * WIDTH * moved
    base = np.concatenate([[0], np.cumsum(length)])
    first, middle, last = low - start, high - low, end - high
    psm = form == PSM
    prefix_at = base[:-1] + np.where(psm, WIDTH, 2 * WIDTH + last) * moved
    suffix_at = base[:-1] + np.where(psm, 2 * WIDTH + first, WIDTH)
    middle_at = base[:-1] + 3 * WIDTH + first + last
    shifts = np.stack([prefix_at - start, np.where(moved, middle_at - low, prefix_at - start), np.where(moved, suffix_at - high, prefix_at - start)], axis=1)
    out = np.zeros(int(base[-1]), np.uint8)
    out[np.arange(len(data)) + spread(len(data), np.stack([start, low, high], axis=1).ravel(), shifts.ravel())] = data
    for at, mark in ((prefix_at, PREFIX), (suffix_at, SUFFIX), (middle_at, MIDDLE)):
        out[(at[moved] - WIDTH)[:, None] + np.arange(WIDTH)] = np.frombuffer(mark, np.uint8)
    return out, base


def gathered(out: np.ndarray, base: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts again: bytes, offsets, and which outputs lack a sentinel (these come back empty)."""
    start, end, moved = base[:-1], base[1:], form != PLAIN
    found, letter, text = sentinels(out, base)
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        place[mark] = np.full(len(start), -1, np.int64)
        own = letter == mark[1]
        place[mark][text[own][::-1]] = found[own][::-1]  # the first one of a text
    psm = form == PSM
    p, s, m = (place[k] for k in (PREFIX, SUFFIX, MIDDLE))
    good = ~moved | (np.where(psm, p, s) == start) & (np.where(psm, s > p, p > s) & (m > np.where(psm, s, p)))
    use = moved & good
    first = np.where(use, np.where(psm, s, m) - p - WIDTH, 0)
    last = np.where(use, np.where(psm, m, p) - s - WIDTH, 0)
    middle = np.where(use, end - m - WIDTH, 0)
    whole = np.where(use, first + middle + last, np.where(good, end - start, 0))
    offsets = np.concatenate([[0], np.cumsum(whole)])
    at = offsets[:-1]
    begins = np.stack([at, at + first, at + first + middle], axis=1)
    own = start - at
    shifts = np.stack([np.where(use, p + WIDTH - at, own), np.where(use, m + WIDTH - at - first, own), np.where(use, s + WIDTH - at - first - middle, own)], axis=1)
    size = int(offsets[-1])
    return out[np.arange(size) + spread(size, begins.ravel(), shifts.ravel())], offsets, ~good


def _strings(data: np.ndarray, offsets: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    made = made.cast(pa.string())
    return made if none is None or not none.any() else pa.array([None if x else v for v, x in zip(made.to_pylist(), none, strict=True)], pa.string())


def _code_points(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return total[high] - total[low]


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in W.text_slices(batch, "__text"):
                ids = batch.column("doc_id").slice(row, stop - row)
                drawn = np.array([draws(seed, i) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
                bounds, first = line_bounds(data, offsets)
                n = np.diff(first) - 1
                cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1) + first[:-1, None]
                form = np.where(drawn[:, 3] % 100 < spm_rate, SPM, PSM)
                form[(n == 0) | (drawn[:, 2] % 100 >= rate)] = PLAIN
                form[sentinels(data, offsets)[2]] = PLAIN
                low, high = bounds[cuts[:, 0]], bounds[cuts[:, 1]]
                plain = form == PLAIN
                out, base = scattered(data, offsets, low, high, form)
                prefix, middle = (pa.array(_code_points(data, a, b), pa.int64(), mask=plain) for a, b in ((offsets[:-1], low), (low, high)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(FORMS).take(pa.array(form)), prefix, middle, _strings(out, base)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return mapped(source, rows, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(found: DataFrame, keep: tuple[str, ...] = ("doc_id",), form: str = "form", output: str = "output") -> DataFrame:
    """``keep`` columns and restored, the text that each output was made of; a null or unknown form is plain."""
    source = found.select(*keep, F.coalesce(F.array_position(F.array(*map(F.lit, FORMS)), F.col(form)) - 1, F.lit(-1)).cast("int").alias("__form"), F.col(output).cast("string").alias("__output"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + ["restored string"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = np.maximum(np.asarray(batch.column("__form")), 0)
            for row, stop, data, offsets in W.text_slices(batch, "__output"):
                text, ends, bad = gathered(data, offsets, forms[row:stop])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, stop - row) for i in range(len(keep))), _strings(text, ends, bad)], names=[*keep, "restored"])

    return mapped(source, rows, schema)


def op12_displacement_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return restored(made, columns).select(*columns, F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


#: The text is restored in SQL from the three parts, not from the output.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls FROM documents),
h AS (SELECT doc_id, text, ls, len(ls) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, ls, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(ls[1 : lo], ''), '') AS a, coalesce(array_to_string(ls[lo + 1 : hi], ''), '') AS b, coalesce(array_to_string(ls[hi + 1 : n], ''), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(a || b || z) AS restored_sha256 FROM p"""
