"""Category codes and scaling learned from training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def category_map(rows: DataFrame, train: Column, columns: list[str], first: int = 0) -> DataFrame:
    """(field, value, code): the distinct training values of each column in order, null as 'unknown'."""
    long = rows.where(train).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])).alias("v")).select("v.*")
    return long.distinct().withColumn("code", F.row_number().over(Window.partitionBy("field").orderBy("value")) - 1 + first)


def apply_map(rows: DataFrame, codes: DataFrame, columns: list[str], unseen: int = -1) -> DataFrame:
    """``rows`` with ``<column>_code``. The map joins by value; Spark broadcasts it when it is small."""
    for c in columns:
        own = codes.where(F.col("field") == c).select(F.col("value").alias("__value"), F.col("code").alias(f"{c}_code"))
        rows = rows.join(own, F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == F.col("__value"), "left").drop("__value").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(unseen)))
    return rows


def fold_seen(rows: DataFrame, code: str) -> DataFrame:
    """``rows`` (fold, kind) with codes that the fold's training rows have not seen set to -1."""
    seen = rows.where("kind = 'train'").select("fold", code).distinct().withColumn("__seen", F.lit(True))
    return rows.join(seen, ["fold", code], "left").withColumn(f"{code}_fold", F.when(F.col("__seen"), F.col(code)).otherwise(F.lit(-1).cast(dict(rows.dtypes)[code]))).drop("__seen")


def scaled(rows: DataFrame, train: Column, columns: list[str], fill_mean: bool = False) -> DataFrame:
    """``<column>_scaled`` by the training mean and population deviation (0 counts as 1); nulls are 0 before, or the mean."""
    value = {c: F.col(c).cast("double") if fill_mean else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = rows.where(train).agg(*[x for c, v in value.items() for x in (F.avg(v).alias(f"__m_{c}"), F.stddev_pop(v).alias(f"__s_{c}"))])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    deviation = {c: F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    out = {f"{c}_scaled": (F.coalesce(v, F.col(f"__m_{c}")) - F.col(f"__m_{c}")) / deviation[c] for c, v in value.items()}
    return joined.withColumns(out).drop(*[f"__{k}_{c}" for k in "ms" for c in columns])
