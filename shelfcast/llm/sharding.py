"""Rendezvous hashing of stable record keys over weighted shards.

Each shard draws for a key the waiting time ``-ln(u) / weight`` with ``u`` hashed from key and shard;
the shortest wait wins. Only the key, the weights and the number of shards decide, and one more
shard takes rows only into itself, as the other waits stay as they were.

Defined cases: a null key is a key of its own (all its rows share a shard); equal rows share a
shard and get slots next to each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.tables import stage, table

SHARDS = 24
#: Parts of a shard when its rows are numbered; shards times parts rows are the bound of what is broadcast.
PARTS = 4096
RUN = 1 << 16


def waits(key: Column, weights: list[float]) -> Column:
    """For each shard (wait, shard), as an array in the order of shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    given = F.array(*[F.lit(float(w)) for w in weights])

    def wait(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), shard), 11)
        return F.struct((-F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.get(given, shard)).alias("wait"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), wait)


def assign(df: DataFrame, key: str, weights: list[float], out: str = "shard", grown: str | None = None, next_weight: float = 1.0) -> DataFrame:
    """``df`` with its shard, and with the shard that it has once another one of ``next_weight`` is added."""
    n = len(weights)
    drawn = df.withColumn("__waits", waits(F.col(key), [*weights, next_weight]))
    drawn = drawn.withColumn("__best", F.array_min(F.slice("__waits", 1, n)))
    found = drawn.withColumn(out, F.col("__best.shard"))
    if grown:
        found = found.withColumn(grown, F.when(F.get("__waits", F.lit(n))["wait"] < F.col("__best.wait"), F.lit(n)).otherwise(F.col(out)))
    return found.drop("__waits", "__best")


def numbered(df: DataFrame, group: str, slot: str = "slot", parts: int = PARTS) -> DataFrame:
    """``df`` with gapless numbers from 0 within each value of ``group``, of which there are few.

    Equal rows are counted first. Then each group is cut by a hash of the whole row into parts that
    are numbered alone and start after the rows of the parts before, so no task sees a whole group.
    """
    columns = df.columns
    counted = df.groupBy(*columns, F.pmod(F.xxhash64(*columns), F.lit(parts)).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    counted = stage(counted, "numbered")
    sizes = counted.groupBy(group, "__part").agg(F.sum("__n").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__part")) - F.col("__size")
    starts = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), before.alias("__start"))
    inside = F.sum("__n").over(Window.partitionBy(group, "__part").orderBy(*[F.col(c) for c in columns if c != group]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    placed = counted.withColumn("__inside", inside).join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    runs = placed.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN))))
    rows = runs.withColumn("__copy", F.explode(F.sequence(F.col("__run") * RUN, F.least(F.col("__n"), (F.col("__run") + 1) * RUN) - 1)))
    return rows.select(*columns, (F.col("__start") + F.col("__inside") + F.col("__copy")).alias(slot))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    placed = assign(sized, "doc_id", [1.0] * SHARDS, "shard", "grown_shard")
    return numbered(placed, "shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
