"""Cost-balanced packing of tokenized documents into sequences of bounded length.

A document is tokenized whole and cut into full sequences and a remainder. Remainders are packed in
blocks: the block's sequences are as many as its tokens need; remainders are taken by descending
cost (a linear term and a quadratic one for attention) and each goes to the sequence of lowest cost
that has room for it. One that fits nowhere whole is cut over the sequences with room, lowest cost
first, so that only the last sequence of a block is padded.

A block holds the remainders of consecutive rows of a Spark partition, up to ``BLOCK`` of them, so
that memory is bounded and no shuffle is needed. Sequence ids carry the partition and a counter; they
are stable as long as the input's partitions are, as with files or a written table.

Defined cases: a null or empty text is the end token alone; equal rows are packed as often as they
occur; ties of cost keep the order of arrival; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm.tables import mapped, table

CAPACITY = 2048
END = 1
#: Remainders packed together.
BLOCK = 8192
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Bytes of texts tokenized at once; bytes of chunks that a worker keeps with their ids, with what an entry takes besides.
TEXT_BYTES, KEPT_BYTES, ENTRY_BYTES = 4 << 20, 64 << 20, 200
#: Longer chunks are tokenized anew each time; so many new chunks are tokenized as one text.
LONGEST_KEPT, TOGETHER = 64, 1024

#: Marks that end a chunk of letters and begin another; none is a letter, digit or white space.
_MARKS = b".,;:!?$%&*#|()[]<>"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BYTES = np.arange(256)
_IS_LETTER = (_BYTES < 128) & np.array([chr(b).isalpha() for b in range(256)])
_IS_MARK, _IS_GAP = np.isin(_BYTES, list(_MARKS)), np.isin(_BYTES, list(b" \n"))


class ChunkedTokenizer:
    """Ids of whole texts, exactly as the tokenizer gives them for the text, from ids of its chunks.

    The vocabulary's pattern begins a new piece at each blank between two visible characters, and a
    line end before a visible character is a piece of its own; so does a mark after a letter. So a
    text's ids are those of its chunks between them, each with its leading blank. The different chunks
    of the texts are found first; recurring ones are looked up, new ones tokenized many at a time.
    Texts with other white space are tokenized whole. What is kept between calls is bounded by
    ``KEPT_BYTES``; texts tokenized whole and long chunks are not kept.
    """

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        #: Texts with an added token are tokenized whole, unless it is read as text.
        self.added = re.compile("|".join(added)) if added and not special_as_text else None
        self.newline = self.model.encode("\n", add_special_tokens=False).ids
        vocabulary = self.model.get_vocab()
        #: Bytes of text of each id: a character of a byte-level vocabulary is a byte.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self._forget()

    def _forget(self) -> None:
        #: Number of each chunk after a blank, and of each that begins a line or follows a letter.
        self.after_blank: dict[str, int] = {}
        self.first: dict[str, int] = {"": 2}
        self.passing: list[str] = []
        self.kept_bytes = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        #: Where the ids of each number begin, how many they are and how often the number has occurred; first those of the end, a line end and an empty line.
        self.begins, self.lengths = np.array([0, 1, 1], np.int64), np.array([1, len(self.newline), 0], np.int64)
        self.uses = np.zeros(3, np.int64)
        self.end, self.line_end = 0, 1
        self._append(np.array([END, *self.newline], np.uint32))

    def _make_room(self) -> None:
        """Chunks that have not come again go, most of which occur once in a corpus; all go if the others fill more than half of the room. Uses count from 0 again."""
        uses = self.uses.tolist()
        kept = [{c: n for c, n in known.items() if c and uses[n] > 1} for known in (self.after_blank, self.first)]
        ids, begins, lengths = self.ids, self.begins, self.lengths
        self._forget()
        if sum(sum(map(len, part)) + ENTRY_BYTES * len(part) for part in kept) * 2 > KEPT_BYTES:
            return
        for known, part in zip((self.after_blank, self.first), kept, strict=True):
            self._keep(known, list(part))
        numbers = np.array([n for part in kept for n in part.values()], np.int64)
        self._add(_slices(ids, begins[numbers], lengths[numbers]), lengths[numbers])

    def _append(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the next numbers."""
        self.begins = np.concatenate([self.begins, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self._append(ids)

    def _given(self) -> int:
        """How many numbers are given to what is kept."""
        return 2 + len(self.after_blank) + len(self.first)

    def _keep(self, known: dict[str, int], chunks: list[str]) -> None:
        """Give different new chunks the next numbers."""
        known.update(zip(chunks, range(self._given(), self._given() + len(chunks)), strict=True))
        self.kept_bytes += sum(map(len, chunks)) + ENTRY_BYTES * len(chunks)

    def _passing(self, text: str) -> int:
        """A negative number for a text whose ids are not kept."""
        self.passing.append(text)
        return -len(self.passing)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each tokenized by itself, and how many they are of each."""
        found = [np.array(e.ids, np.uint32) for text in texts for e in self.model.encode_batch_fast([text], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _together(self, chunks: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks, each with a blank or line end before it: many are one text, and the bytes of its ids tell where a chunk ends."""
        ids, _ = self._whole([lead + lead.join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)])
        ends, wanted = np.cumsum(self.widths[ids]), np.cumsum([1 + len(c.encode()) for c in chunks], dtype=np.int64)
        last = np.minimum(np.searchsorted(ends, wanted), len(ids) - 1)
        if len(chunks) and (not len(ids) or last[-1] != len(ids) - 1 or (ends[last] != wanted).any()):  # another kind of vocabulary
            return self._whole([lead + c for c in chunks])
        return ids, np.diff(last, prepend=-1)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of different chunks, each with its blank or line end before it if it has one."""
        numbers = np.empty(len(chunks), np.int64)
        spaced = np.fromiter((c[0] == " " for c in chunks), bool, len(chunks))
        for known, lead, at in ((self.after_blank, " ", np.flatnonzero(spaced)), (self.first, "\n", np.flatnonzero(~spaced))):
            bare = [chunks[i].removeprefix(lead) for i in at.tolist()]
            found = list(map(known.get, bare))
            missing = [i for i, n in enumerate(found) if n is None]
            new = list(dict.fromkeys([bare[i] for i in missing]))
            kept = [c for c in new if len(c) <= LONGEST_KEPT]
            passing = {c: self._passing(lead.strip("\n") + c) for c in new if len(c) > LONGEST_KEPT}
            self._keep(known, kept)
            for i in missing:
                found[i] = known[bare[i]] if bare[i] in known else passing[bare[i]]
            numbers[at] = found
            ids, lengths = self._together(kept, lead)
            dropped = len(self.newline) if lead == "\n" else 0
            self._add(ids, lengths)
            self.begins[len(self.begins) - len(kept) :] += dropped
            self.lengths[len(self.begins) - len(kept) :] -= dropped
        return numbers

    def _is_odd(self, text: str) -> bool:
        return bool("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[:1].isspace() or text[-1:].isspace() or _OTHER_SPACE.search(text) or (self.added and self.added.search(text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end token."""
        if not texts:
            return []
        if self.kept_bytes > KEPT_BYTES:
            self._make_room()
        whole = [self._is_odd(text) for text in texts]
        plain = ["" if odd else text for text, odd in zip(texts, whole, strict=True)]
        joined = "".join(["\n" + text for text in plain]).encode()
        at = np.frombuffer(joined, np.uint8)
        cut = _IS_GAP[at]
        cut[1:] |= _IS_MARK[at[1:]] & _IS_LETTER[at[:-1]]
        starts = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(at))), pa.py_buffer(joined)).dictionary_encode()
        numbers = self._numbers(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())[chunks.indices.to_numpy()]
        lines = at[starts] == ord("\n")
        begins = np.flatnonzero(lines)[np.cumsum([0, *(text.count("\n") + 1 for text in plain[:-1])])]
        numbers[begins[whole]] = [self._passing(text) for text, odd in zip(texts, whole, strict=True) if odd]
        numbers[numbers < 0] = self._given() - 1 - numbers[numbers < 0]
        self._add(*self._whole(self.passing))
        # before each line a line end, before each text instead the end of the one before, and the end of the last
        places = np.cumsum(1 + lines) - 1
        order = np.full(places[-1] + 2, self.line_end)
        order[places] = numbers
        order[[*(places[begins] - 1), -1]] = self.end
        seen = np.bincount(order, minlength=self._given())[: self._given()]
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        length = self.lengths[order]
        ids = _slices(self.ids, self.begins[order], length)
        self.used -= int(self.lengths[self._given() :].sum())
        self.begins, self.lengths, self.passing = self.begins[: self._given()], self.lengths[: self._given()], []
        return np.split(ids, np.cumsum(length)[places[begins] - 1])[1:]


def _slices(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of ``ids`` one after the other."""
    ends = np.cumsum(lengths)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lengths, lengths)]


_TOKENIZERS: dict[tuple[str, bool], ChunkedTokenizer] = {}


def tokenizer(path: str, special_as_text: bool = True) -> ChunkedTokenizer:
    """One for each Python worker, of bounded size, so that tasks profit from chunks of earlier ones."""
    if (path, special_as_text) not in _TOKENIZERS:
        _TOKENIZERS[path, special_as_text] = ChunkedTokenizer(path, special_as_text)
    return _TOKENIZERS[path, special_as_text]


def cost(tokens: float) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """For each item its pieces (sequence, start within the item, length); sequences are numbered from 0."""
    many = -(-sum(lengths) // capacity)
    room, burden = np.full(many, capacity), np.zeros(many)
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    for item in sorted(range(len(lengths)), key=lambda i: (-cost(lengths[i]), i)):
        left, start = lengths[item], 0
        while left:
            fits = room >= left
            if not fits.any():  # nowhere whole: cut it
                fits = room > 0
            s = int(np.argmin(np.where(fits, burden, np.inf)))
            take = min(left, int(room[s]))
            out[item].append((s, start, take))
            room[s] -= take
            burden[s] += cost(take)
            start, left = start + take, left - take
    return out


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, special_as_text: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path, special_as_text).encode
        base = TaskContext.get().partitionId() << 36
        used = 0
        waiting: list[tuple[object, np.ndarray, int]] = []  # doc, ids of the remainder, its start

        def table_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [()] * (len(numbers) + 2)
            arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:-1])]
            arrays += [pa.array([ids.astype("<u4").tobytes() for ids in columns[-1]], pa.binary())] if with_ids else []
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *numbers, *(["ids"] if with_ids else [])])

        def piece(doc: object, ids: np.ndarray, start: int, whole: int, sequence: int, offset: int) -> tuple:
            return doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), whole, base + sequence, offset, ids

        def flush() -> list[tuple]:
            nonlocal used
            lengths = [len(ids) for _, ids, _ in waiting]
            filled: dict[int, int] = {}
            pieces = []
            for (doc, ids, before), parts in zip(waiting, packed(lengths, capacity), strict=True):
                for s, start, length in parts:
                    pieces.append(piece(doc, ids[start : start + length], before + start, before + len(ids), used + s, filled.get(s, 0)))
                    filled[s] = filled.get(s, 0) + length
            used += len(filled)
            waiting.clear()
            return pieces

        doc_type = None
        for batch in batches:
            doc_type = batch.column(0).type
            sizes = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_BYTES, prepend=0))
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                pieces = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    full = len(ids) // capacity * capacity
                    for start in range(0, full, capacity):
                        pieces.append(piece(doc, ids[start : start + capacity], start, len(ids), used, 0))
                        used += 1
                    if full < len(ids):
                        waiting.append((doc, ids[full:].copy(), full))
                    if len(waiting) == BLOCK:
                        pieces += flush()
                if pieces:
                    yield table_of(pieces)
        if waiting:
            yield table_of(flush())

    columns = [f"`{n}` bigint" for n in numbers] + (["ids binary"] if with_ids else [])
    return mapped(source, rows, f"doc_id {kind}, {', '.join(columns)}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), special_as_text=False)
