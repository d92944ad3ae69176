"""Deterministic samples: membership depends on keys alone, never on the order or place of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S

#: Sampling rates by demand bucket.
RATES = {"0": 0.05, "1": 0.2, "2-5": 0.4, "5-20": 0.8, "20+": 1.0}


def uniform(horizon: str, seed: int) -> Column:
    return S.hash_uniform(F.col("month"), F.col("site_no"), F.col("item_id"), horizon, str(seed))


def by_bucket(rates: dict[str, float], target: str) -> Column:
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(rate, S.demand_bucket(F.col(target))), F.lit(0.0))


def stratified(rows: DataFrame, target: str, rates: dict[str, float], horizon: str = "1m", seed: int = 42) -> DataFrame:
    """Rows kept at their bucket's rate, weighing its inverse."""
    rate = by_bucket(rates, target)
    return rows.withColumn("sampling_probability", rate).where(uniform(horizon, seed) < F.col("sampling_probability")).withColumn("sample_weight", 1 / F.col("sampling_probability"))


def sample_weight(target: str, rates: dict[str, float], horizon: str = "1m", seed: int = 42) -> Column:
    """What a row of all rows weighs in the stratified sample: 0 outside of it."""
    rate = by_bucket(rates, target)
    return F.when(uniform(horizon, seed) < rate, 1 / rate).otherwise(0.0)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Rows by split, horizon and bucket of the target, where the target is known; both horizons in one pass."""
    both = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"future_qty_{h}").alias("target")) for h in ("1m", "2m")]))
    long = rows.select("split", both.alias("h")).select("split", "h.*").where("target IS NOT NULL")
    return long.groupBy("split", "horizon", S.demand_bucket(F.col("target")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def scaled_rates(rows: DataFrame, target: str, rates: dict[str, float], wanted: int) -> DataFrame:
    """(bucket, n, rate): rates times one factor, at most 1, that give the wanted number of rows; all rows if there are fewer.

    The expected number of rows is piecewise linear in the factor, with a break where a bucket's rate reaches 1. Over the buckets in that
    order the rows of full buckets are cumulated, each segment is solved, and the first solution inside its segment is the factor.
    """
    counts = rows.groupBy(S.demand_bucket(F.col(target)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.withColumn("own", F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("bucket"))).where("own > 0")
    order = Window.orderBy(F.desc("own"), "bucket")  # a row for each bucket
    full = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("n") * F.col("own")).over(order.rowsBetween(0, Window.unboundedFollowing))
    solved = known.withColumn("x", (wanted - full) / rest)
    begins = F.coalesce(1 / F.lag("own").over(order), F.lit(0.0))
    factor = F.min(F.when(F.col("x").between(F.col("begins") - 1e-12, 1 / F.col("own") + 1e-12), F.col("x"))).over(Window.partitionBy())
    return solved.withColumn("begins", begins).select("bucket", "n", F.round(F.least(F.lit(1.0), F.coalesce(F.col("own") * factor, F.lit(1.0))), 9).alias("rate"))


def stratified_to(rows: DataFrame, target: str, rates: dict[str, float], wanted: int, horizon: str = "1m", seed: int = 42) -> DataFrame:
    """About the wanted number of rows, kept at their bucket's scaled rate and weighing its inverse."""
    scaled = scaled_rates(rows, target, rates, wanted).select("bucket", F.col("rate").alias("sampling_probability"))
    found = rows.withColumn("bucket", S.demand_bucket(F.col(target))).join(F.broadcast(scaled), "bucket")  # five rows
    return found.where(uniform(horizon, seed) < F.col("sampling_probability")).withColumn("sample_weight", 1 / F.col("sampling_probability"))


def distribution(sample: DataFrame, target: str, by: str) -> DataFrame:
    """Weighted rows, mean and selling share of a sample by group, and the group's share of all weight."""
    found = sample.groupBy(by).agg(F.sum("sample_weight").alias("w"), F.sum(F.col("sample_weight") * F.col(target)).alias("s"), F.sum(F.when(F.col(target) > 0, F.col("sample_weight")).otherwise(0.0)).alias("p"))
    return found.withColumn("all_w", F.sum("w").over(Window.partitionBy())).select(by, S.r6(F.col("w")).alias("weighted_rows"), S.r6(F.col("s") / F.col("w")).alias("mean"), S.r6(F.col("p") / F.col("w")).alias("nonzero_rate"), S.r6(F.col("w") / F.col("all_w")).alias("share"))  # over a row for each group


def first_by_hash(rows: DataFrame, group: list[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows of smallest hash of each group: a fixed sample of bounded size."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(uniform("sample", seed), "month", "site_no", "item_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def audit_mix(rows: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Random rows, random rows of each level and the worst errors, each row once with all its reasons."""
    u = uniform("audit", seed)
    error = F.abs(F.col("prediction") - F.col("target"))
    tie = ["month", "site_no", "item_id"]
    parts = [
        rows.withColumn("__r", F.row_number().over(Window.partitionBy("split").orderBy(u, *tie))).withColumn("reason", F.lit("random")),
        rows.withColumn("__r", F.row_number().over(Window.partitionBy("split", S.level(F.col("target"))).orderBy(u, *tie))).withColumn("reason", F.lit("level")),
        rows.withColumn("__r", F.row_number().over(Window.partitionBy("split").orderBy(F.desc(error), *tie))).withColumn("reason", F.lit("worst")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("__r") <= n)
    return union.groupBy("month", "site_no", "item_id", "split").agg(F.first("target").alias("target"), F.first("prediction").alias("prediction"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def time_folds(rows: DataFrame, folds: list[tuple[str, str, str]]) -> DataFrame:
    """Each row once for every fold that has it: train up to a month, valid from the next given to another (all 'yyyy-MM')."""
    entries = []
    for k, (train_end, start, end) in enumerate(folds, 1):
        kind = F.when(F.col("month") <= train_end, "train").when(F.col("month").between(start, end), "valid")
        entries.append(F.when(kind.isNotNull(), F.struct(F.lit(k).alias("fold"), kind.alias("kind"))))
    return rows.select("*", F.explode(F.array_compact(F.array(*entries))).alias("f")).select("*", "f.fold", "f.kind").drop("f")


def many_kinds(rows: DataFrame, target: str, kinds: dict[str, dict[str, float]], seed: int = 42) -> DataFrame:
    """Several samples of their own rates from one scan."""
    entries = F.array(*[F.struct(F.lit(k).alias("sample_kind"), by_bucket(r, target).alias("sampling_probability"), uniform(k, seed).alias("u")) for k, r in kinds.items()])
    return rows.select("*", F.explode(entries).alias("k")).select("*", "k.*").drop("k").where("u < sampling_probability").drop("u").withColumn("sample_weight", 1 / F.col("sampling_probability"))
