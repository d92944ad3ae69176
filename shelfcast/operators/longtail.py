"""How demand is spread: buckets, quantiles, top shares, categories and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S
from shelfcast.operators import quantiles


def buckets(rows: DataFrame) -> DataFrame:
    """Rows and their share in each bucket, also in empty ones."""
    counts = rows.groupBy(S.longtail_bucket(F.col("total_qty")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    listed = rows.sparkSession.createDataFrame([(b,) for b in S.BUCKETS], "bucket string")
    found = listed.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select("bucket", "n", S.r6(S.ratio(F.col("n"), F.sum("n").over(Window.partitionBy()))).alias("ratio"))  # over five rows


def describe(rows: DataFrame) -> DataFrame:
    q = F.col("total_qty")
    sums = rows.agg(F.count(q).alias("count"), S.r6(F.avg(q)).alias("mean"), S.r6(F.stddev_samp(q)).alias("std"), F.min(q).alias("low"), F.max(q).alias("high"))
    found = quantiles.wide(rows.withColumn("one", F.lit(1)), ["one"], {f"p{p}": (q, p / 100) for p in (50, 75, 90, 95, 99)})
    return sums.withColumn("one", F.lit(1)).join(found, "one", "left").select("count", "mean", "std", "low", *[S.r6(F.col(f"p{p}")).alias(f"p{p}") for p in (50, 75, 90, 95, 99)], "high")  # a row each


def top_share(rows: DataFrame, shares: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    """Share of all quantity that the largest rows hold: max(1, floor(N p)) of them.

    Rows of equal quantity are counted first, so the window runs over distinct quantities.
    """
    counts = rows.groupBy("total_qty").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("one").orderBy(F.desc("total_qty")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("one", F.lit(1)).withColumn("upto", F.sum("n").over(order)).withColumn("all_n", F.sum("n").over(Window.partitionBy("one")))
    each = ranked.withColumn("p", F.explode(F.array(*map(F.lit, shares)))).withColumn("take", F.greatest(F.lit(1), F.floor(F.round(F.col("all_n") * F.col("p"), 6))))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - (F.col("upto") - F.col("n"))))
    return each.groupBy("p").agg(S.r6(S.ratio(F.sum(taken * F.col("total_qty")), F.sum(F.col("n") * F.col("total_qty")))).alias("share"))


def categories(rows: DataFrame, n: int = 30) -> DataFrame:
    q = F.col("total_qty")
    found = rows.groupBy("gds_ctgry_3_lvel").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(q).alias("qty"), S.r6(F.avg(F.when(q <= 0, 1.0).otherwise(0.0))).alias("share_not_sold"))
    found = found.join(quantiles.wide(rows, ["gds_ctgry_3_lvel"], {"median_qty": (q, 0.5)}), "gds_ctgry_3_lvel", "left")
    return found.orderBy(F.desc("qty"), "gds_ctgry_3_lvel").limit(n)


def channels(rows: DataFrame) -> DataFrame:
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_qty").alias("q")) for c in ("offline", "online", "unknown_channel")])).alias("c")).select("c.*")
    found = long.groupBy("channel").agg(F.sum("q").alias("qty"), F.count_if(F.col("q") > 0).alias("rows_sold"))
    return found.select("channel", "qty", "rows_sold", S.r6(S.ratio(F.col("qty"), F.sum("qty").over(Window.partitionBy()))).alias("share"))  # over three rows


def core_ratios(rows: DataFrame) -> DataFrame:
    q = F.col("total_qty")
    return rows.agg(S.r6(F.avg(F.when(q <= 0, 1.0).otherwise(0.0))).alias("ratio_not_sold"), S.r6(F.avg(F.when((q > 0) & (q <= 5), 1.0).otherwise(0.0))).alias("ratio_up_to_5"))
