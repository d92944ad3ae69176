"""Queries over stored predictions (model_id, site_no, item_id, p_sale, pred_qty_raw, pred_qty_int, pred_mc)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S


def top_books(predictions: DataFrame, n: int = 100) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("pred_qty_int"), F.desc("pred_qty_raw"), "site_no", "item_id"))
    return predictions.withColumn("rank", rank).where(F.col("rank") <= n)


def store_summary(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model_id", "site_no").agg(F.sum("pred_qty_int").alias("total_qty"), F.count_if(F.col("pred_qty_int") > 0).alias("nonzero_count"), F.count_if(F.col("pred_qty_int") >= 20).alias("head_count"))


def model_summary(predictions: DataFrame, levels: dict[int, int] = S.LEVELS) -> DataFrame:
    return predictions.groupBy("model_id").agg(
        F.sum("pred_qty_int").alias("total_qty"), F.count_if(F.col("pred_qty_int") > 0).alias("nonzero_count"), *[F.count_if(F.col("pred_mc") == c).alias(f"mc{c}_count") for c in levels.values()],
        F.count_if(F.col("pred_qty_int") >= 20).alias("head_count"), F.count_distinct("site_no").alias("stores"), F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("n_rows"),
    )


def page(predictions: DataFrame, where: Column, sort: str = "pred_qty_int", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page of the filtered rows, ties by store and item."""
    if sort not in ("pred_qty_int", "p_sale", "item_id"):
        raise ValueError(f"cannot sort by {sort}")
    first = F.desc(sort) if descending else F.asc(sort)
    return predictions.where(where).orderBy(first, "site_no", "item_id", "model_id").offset((number - 1) * size).limit(size)


def store_detail(predictions: DataFrame, site_no: str) -> DataFrame:
    q, mc = F.col("pred_qty_int"), F.col("pred_mc")
    return predictions.where(F.col("site_no") == site_no).groupBy("model_id").agg(F.sum(q).alias("total_qty"), F.count_if(q > 0).alias("nonzero_count"), F.count_if(mc == 3).alias("mc3_count"), F.count_if(mc == 4).alias("mc4_count"), F.count(F.lit(1)).alias("n_rows"))


def history_series(monthly_rows: DataFrame, predictions: DataFrame, target_month: str) -> DataFrame:
    """Actual monthly totals of each store and the forecast month after them, by model."""
    actual = monthly_rows.groupBy("site_no", "month").agg(F.sum("total_qty").alias("qty")).withColumn("kind", F.lit("actual"))
    ahead = predictions.groupBy("site_no", "model_id").agg(F.sum("pred_qty_int").cast("double").alias("qty"))
    return actual.unionByName(ahead.select("site_no", F.lit(target_month).alias("month"), "qty", F.col("model_id").alias("kind")))


def difficult(rows: DataFrame) -> DataFrame:
    """Absolute and stable errors and how hard each row is."""
    a, p = F.col("target"), F.col("prediction")
    return rows.withColumns({"abs_error": F.abs(p - a), "stable_error": S.stable_error(a, p), "difficulty": S.difficulty(a, p)})


def difficult_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    hard = F.col("difficulty").isin("hard", "medium")
    return difficult(rows).groupBy(*by).agg(
        F.count_if(hard).alias("difficult_count"), S.r6(F.avg(F.when(hard, 1.0).otherwise(0.0))).alias("difficult_ratio"), F.count_distinct(F.when(hard, F.col("site_no"))).alias("stores"), S.r6(F.avg(F.when(hard, F.col("abs_error")))).alias("mean_error"), F.count_if(F.col("difficulty") == "hard").alias("hard_count"),
    )
