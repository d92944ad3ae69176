"""DartMinHash near-duplicate classes of documents.

A document is the weighted set of its word shingles (five words; fewer words make one shingle), each
weighing as often as it occurs. Darts of unit density are thrown at (element, weight, rank): an
element's region of weight is cut into unit cells and ranks into doubling steps, the hash of cell
and step says how many darts fall there and where. The dart of lowest rank of each coordinate is
the signature: two documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Only about ``k ln k`` darts are looked at for a document, however long it is.

Bands of coordinates are joined by hash; of buckets with the same members one is kept. Then

1. every member is compared with one hub, the most connected one of its buckets' hubs. The links point
   from less to more connected members, so they are trees; following them gives classes;
2. buckets whose members are all of one class are done. In the others, members of different classes are
   compared among themselves if these are at most ``SMALL`` pairs for a member or fit into a task; else two pivots of each
   bucket (the most connected member, and one by hash) are compared with all others, ``ROUNDS`` times in all;
3. what is left then (large groups just below the threshold) is compared across classes as well, so that
   no link is given up. Buckets are dealt in blocks bounded by rows and bytes: whoever is not in the
   bucket's largest class visits all blocks of members.

Signatures decide clear cases; near the threshold the exact shingles do, which are looked up for such
members alone. Links join classes, not members: only the few edges between different classes are
contracted, by alternating large and small stars.

Defined cases: equal word sequences are one class however many rows they have; a null text or one
without words has no shingle and forms a class of its own row id; equal doc_ids of different texts
are rows of their own texts' classes; the class id is the smallest doc_id of the class (null only
if all are null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import words as W
from shelfcast.llm.tables import mapped, stage, table

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares a band with probability 0.9994, one of 0.9 with 1 - 1e-10, one of 0.5 with 0.15.
BANDS, ROWS = 40, 8
K = BANDS * ROWS
#: Estimates outside of this range, nearly four standard errors off the threshold, need no exact check.
UNSURE = (0.715, 0.885)
#: Pairs for a member that a bucket may list, and how often pivots are elected before.
SMALL, ROUNDS = 64, 4
#: Members, and bytes of their shingles, in one block of a bucket; two blocks meet in a task.
IN_TASK, TASK_BYTES = 1024, 8 << 20
#: Hashes of texts for the exact check that may be broadcast: 8 MB.
BROADCAST_ROWS = 1_000_000
_EDGES = np.array([0.0, 2.0**-8, 2.0**-6, 2.0**-4, 2.0**-2, *(2.0**p for p in range(14))])


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulated probabilities of the Poisson law, far enough into its tail."""
    n = np.arange(int(mean + 12 * mean**0.5 + 30))
    steps = np.log(np.maximum(n, 1))
    return np.cumsum(np.exp(n * np.log(mean) - mean - np.cumsum(steps)))


_COUNTS = [_poisson_table(high - low) for low, high in zip(_EDGES[:-1], _EDGES[1:], strict=True)]


def dart_signatures(cells: np.ndarray, share: np.ndarray, text: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """Signatures (n, k) of texts that have any cell, 0 for the others.

    ``cells``: hashes of the unit cells of weight; ``share``: the part of a cell that the weight
    covers, from its lower end; ``text``: whose cell it is.
    """
    best = np.zeros((n, k), np.uint64)
    weight = np.bincount(text, share, n)
    todo = weight > 0
    reach = np.where(todo, (k * np.log(k) + 2 * k) / np.maximum(weight, 1e-300), 0)
    while todo.any():
        mine = todo[text]
        cell, part, of = cells[mine], share[mine], text[mine]
        ranks, darts, slots = [], [], []
        for step, (low, high) in enumerate(zip(_EDGES[:-1], _EDGES[1:], strict=True)):
            near = reach[of] > low
            if not near.any():
                break
            thrown = np.searchsorted(_COUNTS[step], W.uniform(W.salted(cell[near], 100 + step)))
            at = np.repeat(np.flatnonzero(near), thrown)
            first = np.repeat(np.cumsum(thrown) - thrown, thrown)
            dart = W.salted(cell[at] + W.mix((np.arange(len(at)) - first).astype(np.uint64) + np.uint64(1)), 200 + step)
            hit = W.uniform(W.salted(dart, 1)) < part[at]
            at, dart = at[hit], dart[hit]
            ranks.append(low + (high - low) * W.uniform(W.salted(dart, 2)))
            darts.append(dart)
            slots.append(of[at] * k + (W.salted(dart, 3) % np.uint64(k)).astype(np.int64))
        rank, dart, slot = np.concatenate(ranks), np.concatenate(darts), np.concatenate(slots)
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        lead = np.ones(len(slot), bool)
        lead[1:] = slot[1:] != slot[:-1]
        flat = best.reshape(-1)
        flat[slot[lead]] = dart[lead] | np.uint64(1)
        todo &= (best == 0).any(axis=1)
        reach *= 2
        if todo.any():
            if (reach[todo] > 2 * _EDGES[-1]).any():  # a weight far below one cell: all steps are thrown
                break
            best[todo] = 0
    return best


def shingle_cells(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, their texts, hash of each text's words, number of words). The m-th occurrence of a shingle is a cell of its own."""
    n = len(offsets) - 1
    found = W.runs(data, offsets, W.ALNUM)
    hashed = W.hashes(data, found, W.LOWER)
    count = np.diff(found.of_text)
    text_of_word = np.repeat(np.arange(n), count)
    place = (np.arange(len(hashed)) - found.of_text[text_of_word]).astype(np.uint64)
    whole = np.zeros(n, np.uint64)
    if len(hashed):
        some = np.flatnonzero(count)
        whole[some] = W.mix(np.add.reduceat(W.mix(hashed + W.salted(place, 7)), found.of_text[some]) + count[some].astype(np.uint64))
    start, value = W.windows(hashed, found.of_text, size)
    text = text_of_word[start] if len(start) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    text, value = np.concatenate([text, short]), np.concatenate([value, whole[short]])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    times = np.arange(len(value)) - np.repeat(run, np.diff(np.append(run, len(value))))
    return W.mix(value + W.salted(times.astype(np.uint64), 9)), text, whole, count


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, text_hash, key (hash of its words; null without words), number of cells, signature (a byte for each coordinate), band hashes."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch, "__text"):
                cells, of, whole, count = shingle_cells(data, offsets)
                signature = dart_signatures(cells, np.ones(len(cells)), of, end - row)
                bands = np.zeros((end - row, BANDS), np.uint64)
                for b in range(BANDS):
                    for r in range(ROWS):
                        bands[:, b] = W.salted(bands[:, b] + signature[:, b * ROWS + r], 300 + b)
                none = count == 0
                packed = (signature >> np.uint64(20)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        batch.column(1).slice(row, end - row),
                        pa.array(whole.view(np.int64), mask=none),
                        pa.array(np.bincount(of, minlength=end - row).astype(np.int64)),
                        pa.array([x.tobytes() for x in packed], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "key", "size", "signature", "bands"],
                )

    return mapped(source, rows, f"doc_id {kind}, text_hash bigint, key bigint, size bigint, signature binary, bands array<bigint>")


def _agreement(pairs: DataFrame) -> DataFrame:
    """(a, b, estimate) from the signatures of both; one of 256 other coordinates agrees by chance."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, K) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(((one == two).mean(axis=1) - 1 / 256) * 256 / 255)], names=["a", "b", "estimate"])

    return mapped(pairs, rows, "a bigint, b bigint, estimate double")


def _with_cells(docs: DataFrame) -> DataFrame:
    """(key, cells) with sorted 32-bit cells, for the exact check."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch, "text"):
                cells, of, whole, _ = shingle_cells(data, offsets)
                small = (cells >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((small, of))
                ends = np.searchsorted(of, np.arange(end - row + 1))
                small = small[order]
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([small[ends[i] : ends[i + 1]].tobytes() for i in range(end - row)], pa.binary())], names=["key", "cells"])

    return mapped(docs, rows, "key bigint, cells binary")


def _exact(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) from the cells of both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for i, (one, two) in enumerate(zip(batch.column("ca"), batch.column("cb"), strict=True)):
                one, two = np.frombuffer(one.as_buffer(), np.uint32), np.frombuffer(two.as_buffer(), np.uint32)
                both = len(np.intersect1d(one, two, assume_unique=True))
                found[i] = both / max(1, len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])

    return mapped(pairs, rows, "a bigint, b bigint, similarity double")


def _followed(up: DataFrame) -> DataFrame:
    """(key, root) from links to parents (key, up) that form trees."""
    while True:
        above = up.select(F.col("key").alias("up"), F.col("up").alias("above"))
        jumped = stage(up.join(above, "up", "left").select("key", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "roots")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return up.withColumnRenamed("up", "root")


def _contracted(edges: DataFrame) -> DataFrame:
    """(key, root) of the connected components of ``edges`` (u > v): alternating large and small stars until all are stars."""
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stage(small, "edges")
        n, keys = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == keys and edges.join(edges.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").isEmpty():
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame, key: str = "key", root: str = "root") -> DataFrame:
    """``rows`` with the root of that key; a key of no class is its own."""
    return rows.join(roots.select(F.col("key").alias(key), F.col("root").alias(root)), key, "left").withColumn(root, F.coalesce(root, key))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` once ``links`` (a, b) have joined classes."""
    ends = _rooted(_rooted(links, roots, "a", "ra"), roots, "b", "rb")
    edges = stage(ends.where("ra <> rb").select(F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return roots
    stars = _contracted(edges)
    moved = roots.join(stars.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
    return stage(moved.unionByName(stars), "roots")


def _linked_pairs(pairs: DataFrame, signatures: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` that reach the threshold, by signatures and, where these leave it open, by shingles."""
    one, two = (signatures.select(F.col("key").alias(k), F.col("signature").alias(f"s{k}")) for k in ("a", "b"))
    judged = _agreement(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")).where(F.col("estimate") >= UNSURE[0])
    judged = stage(judged, "judged")
    one, two = (cells.select(F.col("key").alias(k), F.col("cells").alias(f"c{k}")) for k in ("a", "b"))
    unsure = judged.where(F.col("estimate") < UNSURE[1]).join(one, "a").join(two, "b").select("a", "b", "ca", "cb")
    exact = _exact(unsure).where(F.col("similarity") >= threshold)
    return stage(judged.where(F.col("estimate") >= UNSURE[1]).select("a", "b").unionByName(exact.select("a", "b")), "links")


def linked(docs: DataFrame, rows: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, root) of the classes of linked keys, but not of the roots; ``rows`` is what ``signed`` gives for ``docs``."""
    worded = rows.where("key IS NOT NULL")
    reps = worded.groupBy("key").agg(F.min("bands").alias("bands"))
    members = reps.select("key", F.posexplode("bands").alias("band", "hash")).select("key", F.xxhash64("band", "hash").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("set")).where("n > 1")
    alike = sizes.groupBy("n", "set").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    crowded = stage(members.join(alike, "bucket").select("bucket", "key", "n", "times"), "members")
    met = crowded.groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("met"))
    kept = worded.groupBy("key").agg(F.min("signature").alias("signature"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"))
    kept = stage(kept.join(met, "key"), "signatures")
    signatures, hashes = kept.select("key", "signature"), kept.select("text_hash").distinct()
    small = kept.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(hashes) if small else hashes, "text_hash", "left_semi").select("text")
    cells = stage(_with_cells(texts).groupBy("key").agg(F.min("cells").alias("cells")).join(signatures, "key"), "cells")
    active = stage(crowded.select("bucket", "key").join(kept.select("key", "met", "size"), "key"), "active")

    heads = active.groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("hub"))
    hubs = active.join(heads, "bucket").groupBy("key").agg(F.max("hub").alias("hub")).where("hub.key <> key")
    tried = stage(hubs.select(F.col("key").alias("a"), F.col("hub.key").alias("b")), "tried")
    roots = _followed(_linked_pairs(tried, signatures, cells, threshold).select(F.col("a").alias("key"), F.col("b").alias("up")))

    few = active.where("false")
    for turn in range(ROUNDS + 1):
        active = stage(_rooted(active.drop("root"), roots), "active")
        counts = _mixed(active)
        light = F.col("across") <= F.greatest(SMALL * F.col("n"), F.lit(IN_TASK * IN_TASK))
        few = few.unionByName(active.drop("root").join(counts.where(light), "bucket", "left_semi"))
        active = stage(active.join(counts.where(~light), "bucket", "left_semi"), "active")
        if turn == ROUNDS or active.isEmpty():
            break
        order = F.xxhash64(F.lit(turn))
        ends = active.groupBy("bucket").agg(F.max(F.struct("met", "key", "root")).alias("hub"), F.min(F.struct(F.col("key").bitwiseXOR(order).alias("draw"), "key", "root")).alias("low"))
        pivots = ends.select("bucket", F.explode(F.array_distinct(F.array(F.struct("hub.key", "hub.root"), F.struct("low.key", "low.root")))).alias("pivot")).select("bucket", F.col("pivot.key").alias("pivot"), F.col("pivot.root").alias("pivot_root"))
        pivots = stage(pivots, "pivots")
        pairs = active.join(pivots, "bucket").where("root <> pivot_root").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        roots = _merged(roots, _linked_pairs(pairs, signatures, cells, threshold))
        active = active.join(pivots.select("bucket", F.col("pivot").alias("key")), ["bucket", "key"], "left_anti")
    left = stage(_rooted(few.unionByName(active.drop("root")), roots), "left")
    mixed = _mixed(left)
    # the pair of a bucket of two is judged as such, unless it was before
    two = left.join(mixed.where("n = 2"), "bucket", "left_semi").groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b")).select("a", "b").distinct()
    before = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = _merged(roots, _linked_pairs(two.join(before, ["a", "b"], "left_anti"), signatures, cells, threshold))
    left = stage(_rooted(left.join(mixed.where("n > 2"), "bucket", "left_semi").drop("root"), roots), "left")
    found = stage(_across(_dealt(left).join(signatures, "key"), threshold), "across")
    roots = _merged(roots, found.where("b IS NOT NULL").select("a", "b"))
    unsure = _rooted(found.where("b IS NULL").select("bucket", "chunk", "block", F.col("a").alias("key"), "home", "visits"), roots)
    return _merged(roots, _across(unsure.join(cells, "key"), threshold).where("b IS NOT NULL").select("a", "b"))


def _mixed(members: DataFrame) -> DataFrame:
    """(bucket, n, across) of the buckets (bucket, key, root) of different classes: members, and pairs of different classes."""
    by_class = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
    counts = by_class.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return counts.select("bucket", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("across"))


def _dealt(members: DataFrame) -> DataFrame:
    """(bucket, chunk, block, key, root, home, visits) for members (bucket, key, root, size) of mixed buckets.

    A member is at home in its chunk, once for each block of visitors; those outside of the largest class visit all chunks in their block.
    """
    by_class = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(4 * F.col("size") + K).alias("bytes"))
    shape = by_class.groupBy("bucket").agg(F.max(F.struct("c", "root", "bytes")).alias("largest"), F.sum("c").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / IN_TASK), F.ceil(size / TASK_BYTES)).cast("int")
    shape = shape.select("bucket", F.col("largest.root").alias("most"), parts(F.col("n"), F.col("bytes")).alias("chunks"), parts(F.col("n") - F.col("largest.c"), F.col("bytes") - F.col("largest.bytes")).alias("blocks"))
    both = members.join(shape, "bucket").withColumn("own_chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("own_block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    visitor = F.col("root") != F.col("most")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_home = F.transform(each("blocks"), lambda b: F.struct(F.col("own_chunk").alias("chunk"), b.alias("block"), F.lit(True).alias("home"), (visitor & (b == F.col("own_block"))).alias("visits")))
    away = F.transform(F.filter(each("chunks"), lambda c: visitor & (c != F.col("own_chunk"))), lambda c: F.struct(c.alias("chunk"), F.col("own_block").alias("block"), F.lit(False).alias("home"), F.lit(True).alias("visits")))
    return both.select("bucket", "key", "root", F.explode(F.concat(at_home, away)).alias("at")).select("bucket", "at.chunk", "at.block", "key", "root", "at.home", "at.visits")


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between visitors and members of other classes of a bucket's chunk, one for a visitor and a class at most.

    Without a column ``cells``, signatures decide; who needs cells comes as (a, null). With it, shingles decide what signatures leave open.
    """
    exact = "cells" in members.columns

    def rows(key: tuple, group: pa.Table) -> pa.Table:
        keys, roots = (group.column(c).to_numpy() for c in ("key", "root"))
        at_home, visits = (np.array(group.column(c).to_pylist(), bool) for c in ("home", "visits"))
        signed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(keys), K)
        cells = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("cells")] if exact else []
        home = np.flatnonzero(at_home)
        links, stays, comes = [], set(), set()
        for v in np.flatnonzero(visits):
            other = home[roots[home] != roots[v]]
            estimate = ((signed[other] == signed[v]).mean(axis=1) - 1 / 256) * 256 / 255
            near = estimate >= UNSURE[0]
            other, estimate = other[near], estimate[near]
            joined: set[int] = set()
            for at in np.argsort(-estimate, kind="stable"):
                m = other[at]
                if roots[m] in joined:
                    continue
                if estimate[at] >= UNSURE[1]:
                    links.append((keys[v], keys[m]))
                    joined.add(roots[m])
                elif exact:
                    both = len(np.intersect1d(cells[v], cells[m], assume_unique=True))
                    if both >= threshold * (len(cells[v]) + len(cells[m]) - both):
                        links.append((keys[v], keys[m]))
                        joined.add(roots[m])
                else:
                    comes.add(v)
                    stays.add(m)
        wanted = sorted(comes | stays)
        a = [x[0] for x in links] + [keys[i] for i in wanted]
        b = [x[1] for x in links] + [None] * len(wanted)
        none = [False] * len(links)
        bucket, chunk, block = (pa.array([x.as_py()] * len(a), x.type) for x in key)
        roles = (pa.array(none + [i in role for i in wanted], pa.bool_()) for role in (stays, comes))
        return pa.table([bucket, chunk, block, pa.array(a, pa.int64()), pa.array(b, pa.int64()), *roles], names=["bucket", "chunk", "block", "a", "b", "home", "visits"])

    columns = ["bucket", "chunk", "block", "key", "root", "home", "visits", "signature", *(["cells"] if exact else [])]
    return members.select(*columns).groupBy("bucket", "chunk", "block").applyInArrow(rows, "bucket bigint, chunk int, block int, a bigint, b bigint, home boolean, visits boolean")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, root, class_id) for each row of ``docs``.

    ``root`` is null without words, else the same for the whole class; class_id is its smallest doc_id.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stage(signed(source), "signed")
    roots = linked(source, rows)
    least = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    # written, so that Spark may split the rows of a class that holds a large part of them
    lowest = stage(_rooted(least, roots).groupBy("root").agg(F.min("least").alias("class_id")), "lowest")
    placed = _rooted(rows.select("doc_id", "text_hash", "key"), roots).drop("key")
    return placed.join(lowest, "root", "left").select("doc_id", "text_hash", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) with one row of each class: that of the smallest doc_id. Rows without words stay."""
    placed = stage(classes(docs), "classes")
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    wordless = placed.where("root IS NULL").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.col("text").cast("string")))
    here = (F.col("__text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return hashed.join(first, here, "left_semi").dropDuplicates(["doc_id", "__text_hash"]).unionByName(hashed.join(wordless, here, "left_semi")).drop("__text_hash")


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") != F.col("class_id")).alias("is_copy"))
