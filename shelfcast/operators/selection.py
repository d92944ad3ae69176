"""Choice among candidates, in every group at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S


def _order(metrics: list[tuple[str, str]], ids: list[str]) -> list[Column]:
    out = []
    for name, kind in metrics:
        c = F.col(name)
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        out.append(F.when(bad, float("inf")).otherwise({"min": c, "max": -c, "abs_min": F.abs(c)}[kind]))
    return [*out, *map(F.col, ids)]


def best(candidates: DataFrame, by: list[str], metrics: list[tuple[str, str]], ids: list[str], n: int = 1) -> DataFrame:
    """The first n of each group by the metrics in order ('min', 'max' or 'abs_min'); what is not finite is worst, ties go to the smaller ids."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(metrics, ids)))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= n)


def winners(candidates: DataFrame, by: list[str], metrics: list[tuple[str, str]], ids: list[str], most: int) -> DataFrame:
    """Candidates that are best by any one metric, at most ``most`` of each group, with how many metrics they lead."""
    marked = candidates
    for i, metric in enumerate(metrics):
        marked = marked.withColumn(f"__{i}", F.row_number().over(Window.partitionBy(*by).orderBy(*_order([metric], ids))))
    leads = sum((F.when(F.col(f"__{i}") == 1, 1).otherwise(0) for i in range(len(metrics))), F.lit(0))
    marked = marked.withColumn("n_best", leads).drop(*[f"__{i}" for i in range(len(metrics))]).where("n_best > 0")
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_best"), *map(F.col, ids)))).where(F.col("rank") <= most)


def business(candidates: DataFrame, by: list[str], ids: list[str], base_mae: str = "base_mae", mae_growth: float = 0.35) -> DataFrame:
    """Ranks candidates that keep the guardrails before all others: no false positives on zeros, MAE within the growth; then by bias, nonzero and head WAPE."""
    reasons = F.array_compact(F.array(F.when(F.col("zero_gt_1_rate") > 0, "zero_false_positives"), F.when(F.col("mae") > F.col(base_mae) * (1 + mae_growth), "mae")))
    found = candidates.withColumn("reasons", F.array_join(reasons, ",")).withColumn("accepted", F.size(reasons) == 0)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("accepted"), *_order([("total_bias_rate", "abs_min"), ("nonzero_wape", "min"), ("ge_20_wape", "min")], ids)))
    return found.withColumn("rank", rank)


def gate(sweep: DataFrame, by: list[str], wape: str, least_recall: float) -> DataFrame:
    """The threshold of lowest WAPE in each group whose two head recalls stay at or above ``least_recall``."""
    kept = sweep.where((F.col("recall_5_20") >= least_recall) & (F.col("recall_20plus") >= least_recall))
    return best(kept, by, [(wape, "min")], ["threshold"])


def gate_protected(sweep: DataFrame, by: list[str], wape: str, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """The best threshold of each group at each level of protection."""
    each = sweep.withColumn("protection", F.explode(F.array(*map(F.lit, levels)))).where((F.col("recall_5_20") >= F.col("protection")) & (F.col("recall_20plus") >= F.col("protection")))
    return best(each, [*by, "protection"], [(wape, "min")], ["threshold"])


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which half of the group's weight is reached."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cumulated = sums.withColumn("upto", F.sum("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy(*by)))
    return cumulated.where(2 * F.col("upto") >= F.col("total")).groupBy(*by).agg(F.min(value).alias("weighted_median"))
