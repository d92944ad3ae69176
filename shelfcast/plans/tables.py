"""The tables that queries start from, as DataFrames, and the same as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import cleaning, forecast, panel
from shelfcast.sources.ledger import retail_ledger
from shelfcast.sources.staging import staged

TRAIN_UNTIL, VALID_UNTIL = "1999-12", "2000-12"
#: Ledger lines of a task; with all months filled in they are some 500,000 rows.
TASK_LINES = 150_000


#: Stores whose activity is broadcast: some 100 MB; beyond them it is joined.
BROADCAST_STORES = 1_000_000


def parts(spark: SparkSession, d: str) -> int | None:
    """As many tasks as the lines need, so that none grows with the input; none if Spark's own number is enough."""
    needed = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // TASK_LINES)  # from the files' footers
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(spark: SparkSession, d: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by these keys over as many tasks as the lines need; small inputs are left to Spark."""
    many = parts(spark, d)
    return rows.repartition(many, *keys) if many else rows


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return retail_ledger(spark, d, parts(spark, d))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(ledger(spark, d))


def days(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by series once: days, months, panel and history all keep that partitioning and need no other shuffle."""
    many = parts(spark, d)
    return cleaning.daily(lines(spark, d).repartition(*([many] if many else []), *panel.KEY))


def months(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.monthly(days(spark, d))


def last_month(spark: SparkSession, d: str) -> int | None:
    """The last month of all. Lines of the latest day's month are looked at first; all lines only if none of these is kept."""
    of = lambda rows: cleaning.clean(rows).agg(F.max(S.month_index(F.col("period")))).first()[0]
    latest = spark.read.parquet(f"{d}/lineitem.parquet").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    found = of(retail_ledger(spark, d).where(F.col("period") >= F.lit(latest.replace(day=1)))) if latest else None
    return of(ledger(spark, d)) if found is None else found


def full_panel(spark: SparkSession, d: str) -> DataFrame:
    """All months of each series up to the last of all, which is known beforehand, so that the months are computed once."""
    return panel.expand(months(spark, d), last=last_month(spark, d))


def activity(spark: SparkSession, d: str) -> DataFrame:
    """From lines, as these have the stores and months of the monthly rows: no shuffle by series."""
    return cleaning.store_activity(lines(spark, d).select("site_no", S.month_index(F.col("period")).alias("month_idx")))


def stores(spark: SparkSession, d: str) -> DataFrame:
    """The activity of each store, written once; it is broadcast unless stores are very many, so that rows dealt by series stay where they are."""
    found = staged(activity(spark, d), "stores")
    return F.broadcast(found) if found.count() <= BROADCAST_STORES else found


def history(spark: SparkSession, d: str) -> DataFrame:
    return panel.history(full_panel(spark, d))


def dataset(spark: SparkSession, d: str) -> DataFrame:
    return panel.targets(history(spark, d), TRAIN_UNTIL, VALID_UNTIL)


def active(spark: SparkSession, d: str) -> DataFrame:
    act = stores(spark, d)
    return panel.active_dataset(panel.expand(months(spark, d), act), act, TRAIN_UNTIL, VALID_UNTIL)


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the next month with the formula forecasts, and a probability and a quantity for the gates."""
    p, q = F.col("active_months_last_6m") / 6.0, F.col("qty_mean_last_6m")
    return dataset(spark, d).select(
        "month", "month_idx", "site_no", "item_id", "gds_ctgry_3_lvel", "split", F.col("total_qty").alias("current"), S.clip_target(F.col("future_qty_1m")).alias("target"), "qty_lag_1m", "qty_lag_2m", "qty_lag_3m", "months_since_last_sale",
        "qty_sum_last_3m", "qty_mean_last_3m", "active_months_last_6m", p.alias("p"), S.clip_target(q).alias("q"), forecast.historical_mean().alias("hist"), forecast.weighted_average().alias("wma"), forecast.two_stage(p, q).alias("two"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Stored predictions of two models for the last month that has targets: two before the last of all, which every series that has a month with targets reaches."""
    last = last_month(spark, d)
    rows = forecasts(spark, d).where(F.col("month_idx") == F.lit(None if last is None else last - 2))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(m).alias("pred")) for m in ("hist", "two")]))
    long = rows.select("month", "site_no", "item_id", F.col("p").alias("p_sale"), "target", models.alias("m")).select("*", "m.*").drop("m")
    return forecast.postprocessed(long, "pred").drop("pred")


_QTY = "greatest(1, floor(l_quantity * l_quantity / 100))"
LED = f"""led AS (SELECT CAST(l_shipdate AS DATE) AS period, CAST(l_suppkey AS VARCHAR) AS site_no, p_brand AS item_id, p_type AS gds_ctgry_3_lvel, p_retailprice AS price, qty, tlp, CAST(qty * p_retailprice * (1 - l_discount) AS DECIMAL(18,4)) AS tsp,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'online' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'offline' END AS channel_type, qty < 0 AS is_return
  FROM (SELECT *, CAST(qty * p_retailprice AS DECIMAL(18,4)) AS tlp FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -{_QTY} ELSE {_QTY} END AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)))"""
DAY = f"""{LED},
day AS (SELECT period, site_no, item_id, sum(qty) AS total_qty, coalesce(sum(qty) FILTER (WHERE channel_type = 'offline'), 0) AS offline_qty, coalesce(sum(qty) FILTER (WHERE channel_type = 'online'), 0) AS online_qty, coalesce(sum(qty) FILTER (WHERE channel_type = 'unknown'), 0) AS unknown_channel_qty,
  sum(tlp) AS total_tlp, sum(tsp) AS total_tsp, count(*) AS sales_count, count(*) FILTER (WHERE is_return) AS return_count, coalesce(sum(-qty) FILTER (WHERE is_return), 0) AS return_qty, max(gds_ctgry_3_lvel) AS gds_ctgry_3_lvel, max(price) AS price FROM led GROUP BY 1, 2, 3)"""
MON = f"""{DAY},
mon AS (SELECT year(period) * 12 + month(period) - 1 AS month_idx, strftime(min(period), '%Y-%m') AS month, site_no, item_id, sum(total_qty) AS total_qty, sum(offline_qty) AS offline_qty, sum(online_qty) AS online_qty, sum(unknown_channel_qty) AS unknown_channel_qty,
  CAST(sum(total_tlp) AS DOUBLE) AS total_tlp, CAST(sum(total_tsp) AS DOUBLE) AS total_tsp, CAST(sum(sales_count) AS BIGINT) AS sales_count, CAST(sum(return_count) AS BIGINT) AS return_count, sum(return_qty) AS return_qty, count(DISTINCT period) AS sales_days,
  max_by(gds_ctgry_3_lvel, period) AS gds_ctgry_3_lvel, max_by(price, period) AS price FROM day GROUP BY year(period) * 12 + month(period) - 1, site_no, item_id)"""
ACT = f"""{MON},
act AS (SELECT *, last_idx - first_idx + 1 AS span_months, last_idx - first_idx + 1 - active_months AS gap_months FROM (SELECT site_no, min(month_idx) AS first_idx, max(month_idx) AS last_idx, count(DISTINCT month_idx) AS active_months FROM mon GROUP BY site_no))"""


def _panel(name: str, end: str) -> str:
    text = "printf('%04d-%02d', s.m // 12, s.m % 12 + 1)"
    filled = ", ".join(f"coalesce(mon.{c}, 0) AS {c}" for c in panel.FILLED)
    return f"""{name} AS (SELECT s.site_no, s.item_id, s.m AS month_idx, {text} AS month, {filled}, last_value(mon.gds_ctgry_3_lvel IGNORE NULLS) OVER (PARTITION BY s.site_no, s.item_id ORDER BY s.m ROWS UNBOUNDED PRECEDING) AS gds_ctgry_3_lvel
  FROM (SELECT site_no, item_id, unnest(range(f, {end} + 1)) AS m FROM (SELECT mon.site_no, item_id, min(month_idx) AS f, any_value(last_idx) AS last_idx FROM mon JOIN act USING (site_no) GROUP BY 1, 2)) s
  LEFT JOIN mon ON mon.site_no = s.site_no AND mon.item_id = s.item_id AND mon.month_idx = s.m)"""


PAN = f"{ACT},\n{_panel('pan', '(SELECT max(month_idx) FROM mon)')}"


def _rolled(n: int) -> str:
    w = f"OVER w{n}"
    return ", ".join([
        f"coalesce(sum(total_qty) {w}, 0) AS qty_sum_last_{n}m", f"coalesce(sum(total_qty) {w} / count(*) {w}, 0) AS qty_mean_last_{n}m", f"coalesce(max(total_qty) {w}, 0) AS qty_max_last_{n}m",
        f"CASE WHEN count(*) {w} >= 2 THEN sqrt(greatest((sum(total_qty * total_qty) {w} - sum(total_qty) {w} * sum(total_qty) {w} / count(*) {w}) / (count(*) {w} - 1), 0)) ELSE 0 END AS qty_std_last_{n}m",
        f"coalesce(sum(offline_qty) {w}, 0) AS offline_qty_sum_last_{n}m", f"coalesce(sum(online_qty) {w}, 0) AS online_qty_sum_last_{n}m",
        f"coalesce(sum(offline_qty) {w} / nullif(sum(total_qty) {w}, 0), 0) AS offline_ratio_last_{n}m", f"coalesce(sum(online_qty) {w} / nullif(sum(total_qty) {w}, 0), 0) AS online_ratio_last_{n}m",
        f"CAST(coalesce(sum(sales_days) {w}, 0) AS BIGINT) AS sales_days_sum_last_{n}m", f"CAST(coalesce(sum(CASE WHEN total_qty > 0 THEN 1 ELSE 0 END) {w}, 0) AS BIGINT) AS active_months_last_{n}m",
        f"CAST(count(*) {w} - coalesce(sum(CASE WHEN total_qty > 0 THEN 1 ELSE 0 END) {w}, 0) AS BIGINT) AS zero_sales_months_last_{n}m", f"coalesce(max(CASE WHEN total_qty > 0 THEN 1 ELSE 0 END) {w}, 0) AS is_sold_last_{n}m",
        f"round(coalesce(sum(total_tsp) {w}, 0), 6) AS tsp_sum_last_{n}m", f"round(coalesce(sum(total_tlp) {w}, 0), 6) AS tlp_sum_last_{n}m",
        f"CASE WHEN abs(coalesce(sum(total_tlp) {w}, 0)) < 1e-9 THEN 0 ELSE round(sum(total_tsp) {w} / sum(total_tlp) {w}, 6) END AS discount_rate_last_{n}m",
    ])


_LAGS = ", ".join([f"coalesce(lag(total_qty, {n}) OVER o, 0) AS qty_lag_{n}m" for n in (1, 2, 3, 6)] + [f"coalesce(lag({c}) OVER o, 0) AS {c}_lag_1m" for c in ("offline_qty", "online_qty", "sales_days")])
HIS = f"""{PAN},
his AS (SELECT pan.*, {_LAGS}, {_rolled(3)}, {_rolled(6)}, coalesce(max(CASE WHEN total_qty > 0 THEN 1 ELSE 0 END) OVER w1, 0) AS is_sold_last_1m,
  coalesce(month_idx - max(CASE WHEN total_qty > 0 THEN month_idx END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS months_since_last_sale, lead(total_qty) OVER o AS future_qty_1m, lead(total_qty) OVER o + lead(total_qty, 2) OVER o AS future_qty_2m,
  CASE WHEN month <= '{TRAIN_UNTIL}' THEN 'train' WHEN month <= '{VALID_UNTIL}' THEN 'valid' ELSE 'test' END AS split
  FROM pan WINDOW o AS (PARTITION BY site_no, item_id ORDER BY month_idx), w1 AS (PARTITION BY site_no, item_id ORDER BY month_idx ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY site_no, item_id ORDER BY month_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w6 AS (PARTITION BY site_no, item_id ORDER BY month_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
ds AS (SELECT *, CASE WHEN future_qty_1m > 0 THEN 1 ELSE 0 END AS future_has_sales_1m, CASE WHEN future_qty_2m > 0 THEN 1 ELSE 0 END AS future_has_sales_2m FROM his WHERE future_qty_2m IS NOT NULL)"""
FOR = f"""{HIS},
fc AS (SELECT month, month_idx, site_no, item_id, gds_ctgry_3_lvel, split, total_qty AS current, greatest(future_qty_1m, 0) AS target, qty_lag_1m, qty_lag_2m, qty_lag_3m, months_since_last_sale, qty_sum_last_3m, qty_mean_last_3m, active_months_last_6m,
  active_months_last_6m / 6.0 AS p, greatest(qty_mean_last_6m, 0) AS q, greatest(qty_mean_last_3m, 0) AS hist, greatest(qty_lag_1m * 0.5::DOUBLE + qty_lag_2m * 0.3::DOUBLE + qty_lag_3m * 0.2::DOUBLE, 0) AS wma,
  least(CAST(active_months_last_6m AS DOUBLE) / 6, 1) * greatest(qty_mean_last_6m, 0) AS two FROM ds)"""


def level_sql(x: str, n: int = 1) -> str:
    whole = f"floor(greatest({x} / {n}.0::DOUBLE, 0) + 0.5)"
    return f"(CASE WHEN {whole} >= 20 THEN 4 WHEN {whole} >= 5 THEN 3 WHEN {whole} >= 2 THEN 2 WHEN {whole} >= 1 THEN 1 ELSE 0 END)"


ADS = f"""{ACT},
{_panel('apan', 'last_idx')},
ads AS (SELECT x.*, CASE WHEN known THEN two END AS future_qty_2m, 1 AS target_available_1m, CASE WHEN known THEN 1 ELSE 0 END AS target_available_2m, CASE WHEN future_qty_1m > 0 THEN 1 ELSE 0 END AS future_has_sales_1m, CASE WHEN known THEN CASE WHEN two > 0 THEN 1 ELSE 0 END END AS future_has_sales_2m,
  {level_sql("future_qty_1m")} AS target_mc_1m, CASE WHEN known THEN {level_sql("two", 2)} ELSE -1 END AS target_mc_2m
  FROM (SELECT a.*, first_idx, last_idx, month_idx + 2 <= last_idx AND two IS NOT NULL AS known FROM (SELECT *, lead(total_qty) OVER o AS future_qty_1m, lead(total_qty) OVER o + lead(total_qty, 2) OVER o AS two, CASE WHEN month <= '{TRAIN_UNTIL}' THEN 'train' WHEN month <= '{VALID_UNTIL}' THEN 'valid' ELSE 'test' END AS split
    FROM apan WINDOW o AS (PARTITION BY site_no, item_id ORDER BY month_idx)) a JOIN act USING (site_no)) x WHERE month_idx + 1 <= last_idx AND future_qty_1m IS NOT NULL)"""
PRE = f"""{FOR},
pre AS (SELECT month, site_no, item_id, p AS p_sale, target, model_id, pred AS pred_qty_raw, CAST(floor(pred + 0.5) AS BIGINT) AS pred_qty_int, {level_sql("pred")} AS pred_mc
  FROM (SELECT *, 'hist' AS model_id, hist AS pred FROM fc UNION ALL SELECT *, 'two', two FROM fc) WHERE month_idx = (SELECT max(month_idx) FROM fc))"""
