"""Quantiles and ranks from counts of distinct values: nothing holds all rows of a group, and several values and quantiles share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def long(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, name, value, n): how often each finite value occurs."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()]))
    found = rows.select(*by, each.alias("v")).select(*by, "v.*").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('inf')")
    return found.groupBy(*by, "name", "value").agg(F.count(F.lit(1)).alias("n"))


def of_counts(counts: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by, name, quantiles): linear interpolation between the values at the places around (count - 1) * q."""
    up = Window.partitionBy(*by, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(up), "places": F.sum("n").over(Window.partitionBy(*by, "name")) - 1})
    value = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    ends = []
    for name, q in quantiles.items():
        at = F.col("places") * q
        ends += [value(F.floor(at)).alias(f"{name}_low"), value(F.ceil(at)).alias(f"{name}_high")]
    found = placed.groupBy(*by, "name", "places").agg(*ends)
    between = lambda n, q: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (F.col("places") * q - F.floor(F.col("places") * q))
    return found.select(*by, "name", *[between(n, q).alias(n) for n, q in quantiles.items()])


def wide(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """(by, wanted): quantiles by column name, as (value, quantile); values that are asked for more than once are counted once."""
    values, names = {}, {}
    for column, (value, q) in wanted.items():
        text = str(value)
        values.setdefault(text, (f"v{len(values)}", value))
        names[column] = (values[text][0], f"q{round(q * 10_000)}")
    found = of_counts(long(rows, by, {n: c for n, c in values.values()}), by, {f"q{round(q * 10_000)}": q for _, q in wanted.values()})
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col(q))).alias(c) for c, (n, q) in names.items()])


def shares_up_to(asked: DataFrame, counts: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """(by, keep, value, share): for each asked value the share of the counted values that are at most as large, null if there are none.

    Asked and counted values are united and ordered once; the cumulated count is read off, so nothing is joined by range.
    """
    none = F.lit(None)
    both = asked.select(*by, "value", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"), *keep).unionByName(counts.select(*by, "value", F.col("n").cast("long").alias("n"), F.lit(False).alias("asked"), *[none.cast(asked.schema[k].dataType).alias(k) for k in keep]))
    up = Window.partitionBy(*by).orderBy("value", "asked").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*by))})
    return seen.where("asked").select(*by, *keep, "value", F.try_divide(F.col("upto"), F.col("all")).alias("share"))
