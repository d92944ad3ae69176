"""Words of an Arrow text column as NumPy arrays: boundaries and 64-bit hashes, without a Python loop over words.

Texts are handled as UTF-8 bytes in slices of some hundred kilobytes, so that memory is bounded by the
slice and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are in lower case: digits, letters and all beyond ASCII.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_NEWLINE = ~byte_set((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF))


def uniform(x: np.ndarray) -> np.ndarray:
    """Values above 0 and below 1 from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS = np.ones(1 << 12, np.uint64)
_POWERS[1:] = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    more = np.full(n, 0xD6E8FEB86659FD93, np.uint64)
    more[0] = 1
    return np.cumprod(more, dtype=np.uint64)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of ``batch``; a null text has no bytes."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and ends[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


@dataclass
class Runs:
    """Maximal runs of the bytes of a set, none across two texts."""

    starts: np.ndarray
    ends: np.ndarray
    of_text: np.ndarray  # for each text its first run, then their number


def runs(data: np.ndarray, offsets: np.ndarray, among: np.ndarray) -> Runs:
    inside = among[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Runs(starts, ends, np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, found: Runs, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, after ``fold``."""
    if not len(found.starts):
        return np.zeros(0, np.uint64)
    lengths = found.ends - found.starts
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    at = place + np.repeat(found.starts, lengths)
    value = _BYTE_CODE[fold[data[at]]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _ODD)


def windows(words: np.ndarray, of_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``size`` words that lie in one text."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        value = value * np.uint64(0xD1342543DE82EF95) + words[k : k + len(value)]
    text_end = np.repeat(of_text[1:], np.diff(of_text))[: len(value)]
    start = np.flatnonzero(np.arange(len(value)) + size <= text_end)
    return start, mix(value[start])


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])
