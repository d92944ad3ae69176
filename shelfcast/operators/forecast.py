"""Formula forecasts, gates, calibration and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S


def historical_mean(months: int = 1) -> Column:
    return S.clip_target(F.col("qty_mean_last_3m")) * months


def weighted_average(months: int = 1, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    lags = [S.finite(F.col(f"qty_lag_{n}m")) * w for n, w in zip((1, 2, 3), weights, strict=True)]
    return F.greatest(lags[0] + lags[1] + lags[2], F.lit(0.0)) * months


def two_stage(p: Column, q: Column) -> Column:
    return F.least(S.clip_target(p), F.lit(1.0)) * S.clip_target(q)


def gate_a(p: Column, q: Column, threshold: float) -> Column:
    return F.when(p < threshold, 0.0).otherwise(p * q)


def gate_b(p: Column, q: Column, threshold: float) -> Column:
    return F.when(p < threshold, 0.0).otherwise(q)


def calibrated(rows: DataFrame, target: str, prediction: str, by: list[str]) -> DataFrame:
    """Predictions scaled so that each group's sums agree; a group without predictions keeps its own."""
    factor = rows.groupBy(*by).agg(F.coalesce(S.ratio(F.sum(target), F.sum(prediction)), F.lit(1.0)).alias("factor"))
    return rows.join(factor, by).withColumn("calibrated", F.greatest(F.col(prediction) * F.col("factor"), F.lit(0.0)))


def top_threshold(rows: DataFrame, score: str, fraction: float, by: list[str]) -> DataFrame:
    """The score at rank ceil((n - 1) * (1 - fraction)) of each group, counted from 0 upwards.

    Equal scores are counted first, so the window runs over distinct scores.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.where(F.col("upto") > F.ceil(F.round((F.col("total") - 1) * (1 - fraction), 9))).groupBy(*by).agg(F.min(score).alias("threshold"))


def weighted_threshold(rows: DataFrame, score: str, weight: str, fraction: float, by: list[str]) -> DataFrame:
    """The first score, from the highest, at which the cumulated weight reaches the fraction of all weight."""
    sums = rows.where((F.col(weight) > 0) & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumn("upto", F.sum("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy(*by)))
    return ranked.where(F.round(F.col("upto"), 6) >= F.round(fraction * F.col("total"), 6)).groupBy(*by).agg(F.max(score).alias("threshold"))


def multiplier(rows: DataFrame, target: str, prediction: str, weight: Column, by: list[str], highest: float = 1.5) -> DataFrame:
    raw = F.sqrt(S.ratio(F.sum(weight * F.col(target)), F.sum(weight * F.col(prediction))))
    return rows.groupBy(*by).agg(F.least(F.greatest(F.coalesce(raw, F.lit(1.0)), F.lit(1.0)), F.lit(highest)).alias("multiplier"))


def compensated(prediction: Column, s5: Column, s20: Column, medium: tuple[float, float], high: tuple[float, float]) -> Column:
    """Prediction times the multiplier of the level that the scores reach; ``medium`` and ``high`` are (threshold, multiplier)."""
    s20 = F.least(s20, s5)
    return prediction * F.when(s20 >= high[0], high[1]).when(s5 >= medium[0], medium[1]).otherwise(1.0)


def postprocessed(rows: DataFrame, prediction: str, months: int = 1) -> DataFrame:
    raw = S.clip_target(F.col(prediction))
    return rows.withColumns({"pred_qty_raw": raw, "pred_qty_int": S.half_up(raw), "pred_mc": S.level(raw, months)})
