"""Profiles, contracts and comparisons of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S
from shelfcast.sources.staging import staged


def missing(c: str) -> Column:
    """Null or blank."""
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def file_profile(rows: DataFrame, source: str, fields: list[str], numbers: list[str], date: str) -> DataFrame:
    """By source and over all: rows, missing values, failed conversions, first and last date, negative quantities."""
    failed = [F.count_if(~missing(c) & F.col(c).cast("string").try_cast("double").isNull()).alias(f"failed_{c}") for c in numbers]
    found = rows.rollup(source).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(missing(c)).alias(f"missing_{c}") for c in fields], *failed, F.min(F.col(date).cast("string")).alias("first_date"), F.max(F.col(date).cast("string")).alias("last_date"),
        F.count_if(F.col("qty").cast("string").try_cast("double") < 0).alias("negative_qty"),
    )
    return found.withColumn(source, F.coalesce(F.col(source), F.lit("all")))


def top_values(rows: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """The n most frequent trimmed values of each column, from one scan."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("v")).select("v.*")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, null rate and distinct values of each column in one scan."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(columns) for x in (F.count(c).alias(f"c{i}"), F.count_distinct(c).alias(f"d{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), S.r6(S.ratio(F.col("n") - F.col(f"c{i}"), F.col("n"))).alias("null_rate"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(columns)]))
    return sums.select(each.alias("p")).select("p.*")


def numeric_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, mean, sample deviation and maximum of each column in one scan."""
    value = [F.col(c).cast("double") for c in columns]
    sums = rows.agg(*[x for i, v in enumerate(value) for x in (F.min(v).alias(f"a{i}"), F.avg(v).alias(f"b{i}"), F.stddev_samp(v).alias(f"c{i}"), F.max(v).alias(f"d{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), S.r6(F.col(f"a{i}")).alias("low"), S.r6(F.col(f"b{i}")).alias("mean"), S.r6(F.col(f"c{i}")).alias("std"), S.r6(F.col(f"d{i}")).alias("high")) for i, c in enumerate(columns)]))
    return sums.select(each.alias("p")).select("p.*")


def date_range(rows: DataFrame, date: str, by: list[str]) -> DataFrame:
    months = F.array_join(F.array_sort(F.collect_set(F.date_format(date, "yyyy-MM"))), ",")  # as many as there are months
    return rows.groupBy(*by).agg(F.min(date).cast("string").alias("first_date"), F.max(date).cast("string").alias("last_date"), months.alias("months"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def panel_row_count(monthly_rows: DataFrame, activity: DataFrame) -> DataFrame:
    """Rows that the full and the active panel must have, from first months alone."""
    series = monthly_rows.groupBy("site_no", "item_id").agg(F.min("month_idx").alias("first_idx"))
    end = activity.agg(F.max("last_idx").alias("end_idx"))
    joined = series.join(activity.select("site_no", "last_idx"), "site_no").crossJoin(F.broadcast(end))  # one row
    return joined.agg(F.sum(F.col("end_idx") - F.col("first_idx") + 1).cast("long").alias("panel_rows"), F.sum(F.col("last_idx") - F.col("first_idx") + 1).cast("long").alias("active_rows"), F.count(F.lit(1)).alias("series"))


def horizon_violations(dataset: DataFrame) -> DataFrame:
    """Counts that must be 0: the second horizon known without the first, levels out of range, levels that do not follow from the quantity."""
    wrong = lambda n: (F.col(f"target_available_{n}m") == 1) & (F.col(f"target_mc_{n}m") != S.level(F.col(f"future_qty_{n}m"), n))
    return dataset.agg(
        F.count_if((F.col("target_available_2m") == 1) & (F.col("target_available_1m") != 1)).alias("second_without_first"), F.count_if(~F.col("target_mc_2m").isin(-1, *S.LEVELS.values())).alias("unknown_level"),
        F.count_if(wrong(1)).alias("wrong_level_1m"), F.count_if(wrong(2)).alias("wrong_level_2m"), F.count_if((F.col("target_available_2m") == 0) & (F.col("target_mc_2m") != -1)).alias("level_without_target"),
        F.count_if(F.col("month_idx") + 1 > F.col("last_idx")).alias("after_close"),
    )


def alignment(a: DataFrame, b: DataFrame, key: list[str], target: str, prediction: str) -> DataFrame:
    """Two prediction tables against each other: keys of one side only, largest difference of targets, predictions that are not finite or negative."""
    one, two = (df.select(*key, F.col(target).alias(f"t{i}"), F.col(prediction).alias(f"p{i}"), F.lit(1).alias(f"here{i}")) for i, df in ((1, a), (2, b)))
    joined = one.join(two, key, "full_outer")
    bad = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) < 0))
    return joined.agg(
        F.count_if(F.col("here2").isNull()).alias("only_first"), F.count_if(F.col("here1").isNull()).alias("only_second"), F.coalesce(F.max(F.abs(F.col("t1") - F.col("t2"))), F.lit(0.0)).alias("max_target_difference"),
        F.count_if(bad("p1") | bad("p2")).alias("bad_predictions"), F.count_if(F.col("here1").isNotNull() & F.col("here2").isNotNull()).alias("common"),
    )


def unknown_rates(rows: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Share of rows outside of training whose category training has not seen, by column. Categories are few; rows are not joined."""
    long = rows.select(train.alias("is_train"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns])).alias("v")).select("is_train", "v.*")
    values = long.groupBy("field", "value").agg(F.count_if("is_train").alias("in_train"), F.count_if(~F.col("is_train")).alias("outside"))
    return values.groupBy("field").agg(S.r6(S.ratio(F.sum(F.when(F.col("in_train") == 0, F.col("outside")).otherwise(0)), F.sum("outside"))).alias("unknown_rate"))


def fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows and a hash of a set of rows that no order changes: the sum of 12 hexadecimal digits of each row's digest."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def compare_metrics(actual: DataFrame, expected: DataFrame, by: list[str], strict: float = 1e-9, equivalent: float = 1e-3) -> DataFrame:
    """Long metric tables (by, metric, value) against each other within two tolerances."""
    joined = actual.withColumnRenamed("value", "actual").join(expected.withColumnRenamed("value", "expected"), [*by, "metric"], "full_outer")
    d = F.abs(F.col("actual") - F.col("expected"))
    return joined.withColumn("verdict", F.when(F.col("actual").isNull() & F.col("expected").isNull(), "same").when(d.isNull(), "missing").when(d <= strict, "same").when(d <= equivalent, "equivalent").otherwise("different"))


def long_metrics(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(*by, "m.*")


def distribution_shift(rows: DataFrame, sample: DataFrame, fields: list[str], most: float = 0.02) -> DataFrame:
    """Largest difference of shares between all rows and the weighted sample, by field."""
    of = lambda df, a, b: df.select(*fields, a.alias("__all"), b.alias("__sample"))
    both = of(rows, F.lit(1.0), F.lit(0.0)).unionByName(of(sample, F.lit(0.0), F.col("sample_weight").cast("double")))
    return weight_shift(both, F.col("__all"), F.col("__sample"), fields, most)


def weight_shift(rows: DataFrame, first: Column, second: Column, fields: list[str], most: float = 0.02) -> DataFrame:
    """Largest difference of shares between the same rows under two weights, by field, in one pass; the sums by value are written once."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields]))
    long = rows.select(first.alias("a"), second.alias("b"), each.alias("v")).select("a", "b", "v.*")
    sums = staged(long.groupBy("field", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "shares")
    total = sums.groupBy("field").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    share = lambda c: F.coalesce(S.ratio(F.col(c), F.col(f"all_{c}")), F.lit(0.0))
    found = sums.join(F.broadcast(total), "field").groupBy("field")  # a row for each field
    return found.agg(S.r6(F.max(F.abs(share("a") - share("b")))).alias("max_share_difference")).withColumn("fails", F.col("max_share_difference") > most)


def refuse_leaks(columns: list[str], prefixes: tuple[str, ...] = ("future_qty", "future_has_sales", "target_qty", "target_mc"), excluded: tuple[str, ...] = ("month", "site_no", "item_id", "split")) -> None:
    """Raise if a feature list has a target, an id or another excluded field."""
    if bad := [c for c in columns if c in excluded or c.startswith(prefixes)]:
        raise ValueError(f"not allowed as features: {', '.join(bad)}")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
