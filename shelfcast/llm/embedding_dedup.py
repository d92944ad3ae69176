"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are one row with a count. ``TREES`` trees split the rows: a node projects them on a random
direction (drawn from the node's number, so it is stored nowhere) and parts them at the median. Rows closer
to the cut than the ``SPILL`` of what a link at the threshold typically differs by go to both sides. Medians
come from a bounded sample of each node's rows (``SAMPLE`` a leaf and round); all rows are routed. Trees grow by
rounds: leaves over ``LEAF`` rows are split again, each by a subtree that one task fits to that leaf's sample,
so depth follows the input and no tree passes through the driver. A node whose rows differ by no
more than links do is not cut (``DENSE``): what lies there are near copies of one another.

Rows of a leaf are compared in double precision, in groups of at most 2 * ``BLOCK`` rows: a larger leaf is dealt out as
pairs of blocks, so its size is not limited. Before that, dense leaves of the first tree give balls: rows within half of the link's
angle of a centre are all linked to each other, so their links are counted without comparing them, and in large leaves only
rows outside of the ball meet others.

Links go into sums and unions inside of the task, never into lists of pairs: a pair that meets in several leaves counts in
the smallest leaf they share, and each connected part of a group gives one edge a row, to its first member. The edges are contracted by
alternating stars.

Found links are exact (cosine of at least the threshold); a link may be missed if every tree parts it. On the given tables none is; the
README has the recall next to the threshold, where it is lowest.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, vectors of
different lengths not with each other; repeated rows are rows of their own and linked; a null id is no smallest one, but
a row with it is counted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, cos, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.near_dedup import _contracted
from shelfcast.llm.tables import mapped, stage, table

THRESHOLD = 0.9
TREES, LEAF, LEVELS = 8, 512, 8
#: Rows of a leaf to which its subtree is fitted, and fewest of them in a node that is cut.
SAMPLE, LEAST_SAMPLE = 4096, 16
#: Share of a full leaf that the subtrees aim at, as sizes are estimates.
FILLED = 0.75
#: Half the width of the band around a cut whose rows go both ways, and of one that holds half of the rows if these are near copies.
SPILL, DENSE = 0.25, 0.5
BLOCK = 1024


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; lengths of large and small components neither overflow nor vanish."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def direction(leaf: int, node: int, size: int) -> np.ndarray:
    drawn = np.random.Generator(np.random.Philox(key=[leaf & 0xFFFFFFFFFFFFFFFF, node])).standard_normal(size)
    return drawn / np.linalg.norm(drawn)


def margin(size: int, threshold: float, times: float = SPILL) -> float:
    """So many times what the ends of a link at the threshold differ by on a random direction (standard deviation)."""
    return times * sqrt(2 * max(0.0, 1 - threshold) / size)


def fitted(rows: np.ndarray, leaf: int, goal: float, threshold: float, levels: int = LEVELS) -> list[float]:
    """Cuts of a subtree's nodes, by number (children of k: 2k + 1, 2k + 2); not a number where a node is a leaf. ``goal``: rows of the sample in a leaf."""
    cuts = [float("nan")] * ((1 << levels) - 1)
    band, todo = margin(rows.shape[1], threshold), [(0, rows)]
    while todo:
        node, own = todo.pop()
        if node >= len(cuts) or len(own) < max(LEAST_SAMPLE, goal):
            continue
        at = own @ direction(leaf, node, rows.shape[1])
        cut = float(np.median(at))
        if np.median(np.abs(at - cut)) <= margin(rows.shape[1], threshold, DENSE):
            continue
        cuts[node] = cut
        todo += [(2 * node + 1, own[at <= cut + band]), (2 * node + 2, own[at >= cut - band])]
    return cuts


def routed(rows: np.ndarray, leaf: int, cuts: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows that end there), for all ends of the subtree."""
    band, todo = margin(rows.shape[1], threshold), [(0, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node >= len(cuts) or np.isnan(cuts[node]):
            yield node, own
            continue
        at = rows[own] @ direction(leaf, node, rows.shape[1])
        todo += [(2 * node + 1, own[at <= cuts[node] + band]), (2 * node + 2, own[at >= cuts[node] - band])]


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(len(vectors), -1)


def different(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(values, copies, first_id) of each different vector that can be linked, with a ``key`` of its own once written, and its unit ``vector``."""
    values = F.col(embedding).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(values, lambda x: x != 0)
    same = vectors.where(fine).select(F.col(vec_id).alias("id"), values.alias("values")).groupBy("values").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    kind = same.schema["first_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            sizes = np.diff(np.asarray(lists.offsets))
            flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(sizes)])
            made: list[bytes] = [b""] * len(sizes)
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                for i, row in zip(own, unit(flat[ends[own][:, None] + np.arange(size)]), strict=True):
                    made[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("values", "copies", "first_id")), pa.array(sizes.astype(np.int32)), pa.array(made, pa.binary())], names=["values", "copies", "first_id", "size", "vector"])

    return mapped(same, rows, f"values array<double>, copies bigint, first_id {kind}, size int, vector binary").withColumn("key", F.monotonically_increasing_id())


def _sizes(placed: DataFrame) -> DataFrame:
    """(leaf, rows), written: as many as there are leaves."""
    return stage(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")), "leaves")


def forest(rows: DataFrame, trees: int = TREES, threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """(key, tree, leaf) for all leaves of all trees that hold a row of ``rows`` (key, size, vector)."""

    def fit(group: pa.Table) -> pa.Table:
        own = group.column("leaf")[0].as_py()
        cuts = fitted(_matrix(group.column("vector")), own, FILLED * leaf * group.column("share")[0].as_py(), threshold)
        return pa.table({"leaf": pa.array([own], pa.int64()), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, keys = np.asarray(batch.column("leaf")), np.asarray(batch.column("key"))
            rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for one in np.unique(leaves):
                own = np.flatnonzero(leaves == one)
                cuts = np.asarray(batch.column("cuts")[int(own[0])].values)
                for node, found in routed(_matrix(batch.column("vector").take(pa.array(own))), int(one), cuts, threshold):
                    rows.append(own[found])
                    nodes.append(np.full(len(found), node, np.int32))
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), batch.column("tree").take(pa.array(at)), pa.array(leaves[at]), pa.array(np.concatenate(nodes))], names=["key", "tree", "above", "node"])

    placed = rows.select("key", "size", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("key", "tree", F.xxhash64("tree", "size").alias("leaf"))
    done = []
    while True:
        sizes = _sizes(placed)
        large = sizes.where(F.col("rows") > leaf)
        if large.isEmpty():
            break
        done.append(placed.join(sizes.where(F.col("rows") <= leaf), "leaf", "left_semi").select("key", "tree", "leaf"))
        here = placed.join(large, "leaf").join(rows.select("key", "vector"), "key")
        share = F.least(F.lit(1.0), SAMPLE / F.col("rows"))
        drawn = F.pmod(F.xxhash64("key", "leaf"), F.lit(1 << 30)) < share * (1 << 30)
        sample = here.withColumn("share", share).where(drawn).select("leaf", "share", "vector")
        subtrees = stage(sample.groupBy("leaf").applyInArrow(fit, "leaf bigint, cuts array<double>"), "subtrees")
        uncut = F.isnan(F.get("cuts", F.lit(0)))
        done.append(placed.join(subtrees.where(uncut), "leaf", "left_semi").select("key", "tree", "leaf"))
        parts = mapped(here.join(subtrees.where(~uncut), "leaf").select("key", "tree", "leaf", "vector", "cuts"), route, "key bigint, tree int, above bigint, node int")
        placed = stage(parts.select("key", "tree", F.xxhash64("above", "node").alias("leaf")), "placed")
    for one in done:
        placed = placed.unionByName(one)
    return placed


def balls(rows: DataFrame, placed: DataFrame, threshold: float = THRESHOLD, least: int = 2 * BLOCK) -> DataFrame | None:
    """(key, ball) for rows near the centre of a large dense leaf, at most one ball for a row; null without such leaves.

    A leaf's pivot is one of its rows; the centre is the mean of those linked to it. Rows within half of the link's angle of the centre are all linked.
    """
    sizes = _sizes(placed)
    large = sizes.where(F.col("rows") > least)
    if large.isEmpty():
        return None
    inside = stage(placed.join(large, "leaf").join(rows.select("key", "vector"), "key").select("key", "leaf", "vector"), "dense")
    pivots = inside.groupBy("leaf").agg(F.min_by("vector", F.xxhash64("key")).alias("pivot"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, own = np.asarray(batch.column("leaf")), batch.column("pivot").to_pylist()
            values = _matrix(batch.column("vector")) if batch.num_rows else np.zeros((0, 1))
            found = [(int(one), values[at][values[at] @ np.frombuffer(own[at[0]], np.float64) >= threshold].sum(axis=0)) for one in np.unique(leaves) for at in [np.flatnonzero(leaves == one)]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["leaf", "sums"])

    parts = mapped(inside.join(pivots, "leaf"), sums, "leaf bigint, sums array<double>").select("leaf", F.posexplode("sums").alias("place", "value"))
    centres = parts.groupBy("leaf", "place").agg(F.sum("value").alias("value")).groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("centre"))
    half = cos(acos(threshold) / 2) + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, values = np.asarray(batch.column("leaf")), _matrix(batch.column("vector"))
            keep = np.zeros(len(values), bool)
            for one in np.unique(leaves):
                at = np.flatnonzero(leaves == one)
                keep[at] = values[at] @ unit(np.asarray(batch.column("centre")[int(at[0])].values)[None])[0] >= half
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("key", "leaf")], names=["key", "leaf"])

    found = mapped(inside.join(centres, "leaf"), near, "key bigint, leaf bigint")
    return stage(found.groupBy("key").agg(F.min("leaf").alias("ball")), "balls")


def dealt(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(leaf, one, two, home, key): groups of a leaf's rows to be compared. A leaf of up to two blocks is one group; others are pairs of blocks.

    ``placed``: (key, leaf, ball). Rows of a leaf's most frequent ball have blocks of their own, which do not meet one another.
    """
    most = placed.where("ball IS NOT NULL").groupBy("leaf", "ball").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(F.max_by("ball", F.struct("n", "ball")).alias("main"))
    total = placed.join(most, "leaf", "left").withColumn("core", F.coalesce(F.col("ball") == F.col("main"), F.lit(False)))
    counts = total.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("n_core"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    known = total.join(counts, "leaf").withColumn("large", F.col("n") > 2 * block)
    small = known.where("NOT large").select("leaf", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("home"), "key")
    # blocks 0 .. k - 1 hold the rows outside of the core, those below 0 the core
    loose, core = blocks(F.col("n") - F.col("n_core")), blocks(F.col("n_core"))
    home = F.pmod(F.xxhash64("key"), F.greatest(F.when(F.col("core"), core).otherwise(loose), F.lit(1))).cast("int")
    at = known.where("large").select("leaf", "key", F.when(F.col("core"), -1 - home).otherwise(home).alias("home"), loose.alias("loose"), core.alias("core"))
    others = F.when(F.col("home") < 0, F.sequence(F.lit(0), F.col("loose") - 1)).otherwise(F.sequence(-F.col("core"), F.col("loose") - 1))
    met = at.where("loose > 0").select("leaf", "key", "home", F.explode(others).alias("other"))
    return small.unionByName(met.select("leaf", F.least("home", "other").alias("one"), F.greatest("home", "other").alias("two"), "home", "key"))


def _parts(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's connected part."""
    first = np.arange(len(linked))
    open_ = linked.any(axis=1)
    for i in range(len(linked)):
        if open_[i]:
            part = np.zeros(len(linked), bool)
            front = np.array([i])
            part[i] = True
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & ~part)
                part[front] = True
            first[part], open_[part] = i, False
    return first


def _shared_before(leaves: list[np.ndarray], one: np.ndarray, two: np.ndarray, leaf: int, chunk: int = 1 << 15) -> np.ndarray:
    """Whether those pairs of rows share a leaf below ``leaf``: pair by pair, or for many pairs of like rows by one product over the shared leaves."""
    lower = [own[own < leaf] for own in leaves]
    ids, place, n = np.unique(np.concatenate([np.zeros(0, np.int64), *lower]), return_inverse=True, return_counts=True)
    shared, row = n > 1, np.repeat(np.arange(len(lower)), [len(own) for own in lower])
    wide = max(map(len, lower), default=0)
    if len(one) * wide * wide > len(leaves) ** 2 * int(shared.sum()) // 8:
        held = np.zeros((len(leaves), int(shared.sum())), np.float32)
        keep = shared[place]
        held[row[keep], (np.cumsum(shared) - 1)[place[keep]]] = 1
        return (held @ held.T > 0)[one, two]
    padded = np.full((len(leaves), wide), leaf, np.int64)
    for i, own in enumerate(lower):
        padded[i, : len(own)] = own
    out = np.zeros(len(one), bool)
    for at in range(0, len(one), chunk):
        a, b = padded[one[at : at + chunk]], padded[two[at : at + chunk]]
        out[at : at + chunk] = ((a[:, :, None] == b[:, None, :]) & (a < leaf)[:, :, None]).any(axis=(1, 2))
    return out


def compared(group: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """(key, links, root) of the linked rows of a group (leaf, one, two, home, key, copies, ball, leaves, vector)."""
    leaf, apart = group.column("leaf")[0].as_py(), group.column("one")[0].as_py() != group.column("two")[0].as_py()
    keys, copies = np.asarray(group.column("key")), np.asarray(group.column("copies"))
    order = np.argsort(keys, kind="stable")
    keys, copies, values = keys[order], copies[order], _matrix(group.column("vector"))[order]
    near = values @ values.T >= threshold
    np.fill_diagonal(near, False)
    if apart:
        home = np.asarray(group.column("home"))[order]
        near &= home[:, None] != home[None, :]
    first = _parts(near)
    rows = np.flatnonzero(near.any(axis=1))
    one, two = np.nonzero(np.triu(near[np.ix_(rows, rows)]))
    ball = np.asarray(group.column("ball").fill_null(-1) if group.column("ball").null_count else group.column("ball"))[order][rows]
    lists = group.column("leaves").take(pa.array(order[rows])).to_pylist()
    known = (ball[one] == ball[two]) & (ball[one] != -1)
    one, two = one[~known], two[~known]
    again = _shared_before([np.array(x, np.int64) for x in lists], one, two, leaf)
    one, two = rows[one[~again]], rows[two[~again]]
    links = np.bincount(one, copies[two], len(keys)) + np.bincount(two, copies[one], len(keys))
    return pa.table({"key": pa.array(keys[rows]), "links": pa.array(links[rows].astype(np.int64)), "root": pa.array(keys[first[rows]])})


def linked(rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, links) of rows (key, size, copies, vector) with links to others, and (key, root) of those that are no root."""
    placed = stage(forest(rows, trees, threshold, leaf), "forest")
    dense = balls(rows, placed.where("tree = 0").select("key", "leaf"), threshold, 2 * block)
    none = F.lit(None).cast("bigint")
    placed = placed.select("key", "leaf")
    marked = placed.withColumn("ball", none) if dense is None else placed.join(dense, "key", "left")
    own = placed.groupBy("key").agg(F.collect_list("leaf").alias("leaves"))  # trees times spill: bounded by the forest's shape
    whole = rows.select("key", "copies", "vector").join(own, "key")
    whole = whole.withColumn("ball", none) if dense is None else whole.join(dense, "key", "left")
    groups = dealt(stage(marked, "marked"), block).join(whole, "key")
    schema = "key bigint, links bigint, root bigint"
    found = stage(groups.groupBy("leaf", "one", "two").applyInArrow(lambda g: compared(g, threshold), schema), "found")
    links, edges = found.select("key", "links"), found.select("key", "root").where("key <> root")
    if dense is not None:
        sizes = dense.join(rows.select("key", "copies"), "key")
        total = sizes.groupBy("ball").agg(F.sum("copies").alias("total"), F.min("key").alias("root"))
        links = links.unionByName(sizes.join(total, "ball").select("key", (F.col("total") - F.col("copies")).alias("links")))
        edges = edges.unionByName(dense.join(total, "ball").select("key", "root").where("key <> root"))
    edges = stage(edges.select(F.greatest("key", "root").alias("u"), F.least("key", "root").alias("v")).distinct(), "edges")
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    return counted, edges if edges.isEmpty() else _contracted(edges)


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of ``vectors``."""
    rows = stage(different(vectors, vec_id, embedding), "vectors")
    links, roots = linked(rows.select("key", "size", "copies", "vector"), threshold, trees, leaf, block)
    roots = roots.toDF("key", "root")
    rooted = rows.select("values", "key", "copies", "first_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(links, "key", "left").join(smallest, "root").select("values", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("values"))
    return given.join(known, "values", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op13_random_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
