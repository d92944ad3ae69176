"""From the raw ledger to cleaned lines, daily and monthly tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S

#: Personal fields that never leave the raw ledger, and return marks that say "no return".
PRIVATE = ("cust_no", "cust_name", "clphn_no", "crd_no", "2_lvel_cust_code")
NORMAL_RETURN_MARKS = ("", "0", "n", "normal", "正常")
MEASURES = ("total_qty", "offline_qty", "online_qty", "unknown_channel_qty", "total_tlp", "total_tsp", "sales_count", "return_count", "return_qty")


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def clean(ledger: DataFrame, observe: Observation | None = None) -> DataFrame:
    """Typed lines with item, channel and return mark; lines without date, item or store go.

    ``observe`` counts input, output and dropped lines in the same pass.
    """
    dated = F.col("period") if dict(ledger.dtypes)["period"] == "date" else F.to_date(F.try_to_timestamp(F.col("period").cast("string")))
    lines = ledger.drop(*PRIVATE).select(
        dated.alias("period"), _filled("site_no").alias("site_no"), F.coalesce(_filled("blt_site_no"), F.lit("unknown")).alias("blt_site_no"), F.coalesce(_filled("isbn"), _filled("gds_no")).alias("item_id"),
        _filled("isbn").alias("isbn"), _filled("gds_no").alias("gds_no"), _filled("gds_ctgry_3_lvel").alias("gds_ctgry_3_lvel"), F.col("price").try_cast("double").alias("price"), S.numeric(F.col("qty")).alias("qty"),
        F.coalesce(F.col("tlp").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias("tlp"), F.coalesce(F.col("tsp").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias("tsp"),
        S.channel(F.col("oln_or_ofln")).alias("channel_type"), (~F.lower(F.trim(F.coalesce(F.col("rtn_flag"), F.lit("")))).isin(*NORMAL_RETURN_MARKS)).alias("marked"),
    )
    kept = F.col("period").isNotNull() & F.col("item_id").isNotNull() & F.col("site_no").isNotNull()
    if observe is not None:
        lines = lines.observe(observe, F.count(F.lit(1)).alias("input_rows"), F.count_if(kept).alias("output_rows"), F.count_if(~kept).alias("dropped_rows"))
    returned = (F.col("qty") < 0) | F.col("marked")
    return lines.where(kept).withColumn("is_return", returned).withColumn("return_qty_component", F.when(returned, F.abs("qty")).otherwise(0.0)).drop("marked")


def daily(lines: DataFrame) -> DataFrame:
    """One row for each day, store and item. Descriptors are the largest of the day.

    Series come first in the grouping, here and by month: the aggregates sort, and windows over a series then find its rows in order.
    """
    of = lambda name: F.sum(F.when(F.col("channel_type") == name, F.col("qty")).otherwise(0.0))
    found = lines.groupBy("site_no", "item_id", "period").agg(
        F.sum("qty").alias("total_qty"), of("offline").alias("offline_qty"), of("online").alias("online_qty"), of("unknown").alias("unknown_channel_qty"), F.sum("tlp").alias("total_tlp"), F.sum("tsp").alias("total_tsp"),
        F.count(F.lit(1)).alias("sales_count"), F.count_if("is_return").alias("return_count"), F.sum("return_qty_component").alias("return_qty"), F.max("gds_ctgry_3_lvel").alias("gds_ctgry_3_lvel"), F.max("price").alias("price"),
        F.max("blt_site_no").alias("blt_site_no"),
    )
    return found.select("period", "site_no", "item_id", *found.columns[3:])


def monthly(days: DataFrame) -> DataFrame:
    """One row for each month, store and item from ``daily``, which has one a day. Descriptors are the latest that are known."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period"))).alias(c)
    summed = days.groupBy("site_no", "item_id", S.month_index(F.col("period")).alias("month_idx")).agg(
        *[F.sum(c).alias(c) for c in MEASURES], F.count("period").alias("sales_days"), latest("gds_ctgry_3_lvel"), latest("price"), latest("blt_site_no")
    )
    return summed.select("month_idx", "site_no", "item_id", *summed.columns[3:]).withColumns({
        "month": S.month_text(F.col("month_idx")),
        "total_tlp": F.col("total_tlp").cast("double"),
        "total_tsp": F.col("total_tsp").cast("double"),
        "avg_real_price": S.ratio(F.col("total_tsp").cast("double"), F.col("total_qty")),
        "discount_rate": S.ratio(F.col("total_tsp").cast("double"), F.col("total_tlp").cast("double")),
    })


def store_activity(monthly_rows: DataFrame) -> DataFrame:
    """First and last month of each store, active months, their span and the gaps in it. Any flow counts."""
    found = monthly_rows.groupBy("site_no").agg(F.min("month_idx").alias("first_idx"), F.max("month_idx").alias("last_idx"), F.count_distinct("month_idx").alias("active_months"))
    return found.withColumn("span_months", F.col("last_idx") - F.col("first_idx") + 1).withColumn("gap_months", F.col("span_months") - F.col("active_months"))


def closures(activity: DataFrame) -> DataFrame:
    """Stores whose last month is before the last of all; they close in the month after it."""
    end = activity.agg(F.max("last_idx").alias("end_idx"))
    return activity.crossJoin(F.broadcast(end)).where("last_idx < end_idx").select("site_no", "last_idx", (F.col("last_idx") + 1).alias("closure_idx"))  # one row is broadcast


def closure_differences(configured: DataFrame, found: DataFrame) -> DataFrame:
    """Closures of only one side, and stores configured twice; empty if the configuration is right."""
    a, b = (df.select("site_no", "closure_idx") for df in (configured, found))
    twice = a.groupBy("site_no").count().where("count > 1").select("site_no", F.lit(None).cast("int").alias("closure_idx"), F.lit("configured twice").alias("problem"))
    return a.exceptAll(b).withColumn("problem", F.lit("not found")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("not configured"))).unionByName(twice)


def cross_store(monthly_rows: DataFrame) -> DataFrame:
    """Positive quantity of each item and month over all stores, and how many stores have any."""
    return monthly_rows.groupBy("month_idx", "item_id").agg(F.sum(F.greatest("total_qty", F.lit(0.0))).alias("group_positive_qty"), F.count_if(F.col("total_qty") > 0).alias("group_positive_sites"))
