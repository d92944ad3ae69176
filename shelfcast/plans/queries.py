"""Every operator as a query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import checks, cleaning, encoding, forecast, longtail, metrics, panel, sampling, selection, serving
from shelfcast.plans import tables as T
from shelfcast.sources import archives
from shelfcast.sources import ledger as sources
from shelfcast.sources.staging import shared_folder, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def add(name: str, function: Query, sql: str | None = None) -> None:
    query(name, sql)(function)


# cleaning and aggregation

add("cl_clean", lambda s, d: T.lines(s, d).groupBy("channel_type", "is_return").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum("return_qty_component").alias("return_qty"), F.sum("tsp").cast("double").alias("tsp")),
    f"WITH {T.LED} SELECT channel_type, is_return, count(*) AS n, sum(qty) AS qty, sum(CASE WHEN is_return THEN abs(qty) ELSE 0 END) AS return_qty, CAST(sum(tsp) AS DOUBLE) AS tsp FROM led GROUP BY 1, 2")
add("agg_daily", lambda s, d: T.days(s, d).drop("blt_site_no").withColumns({c: F.col(c).cast("double") for c in ("total_tlp", "total_tsp")}), f"WITH {T.DAY} SELECT * REPLACE (CAST(total_tlp AS DOUBLE) AS total_tlp, CAST(total_tsp AS DOUBLE) AS total_tsp) FROM day")
add("agg_monthly", lambda s, d: T.months(s, d).drop("blt_site_no").withColumns({c: S.r6(F.col(c)) for c in ("avg_real_price", "discount_rate")}),
    f"WITH {T.MON} SELECT *, round(total_tsp / nullif(total_qty, 0), 6) AS avg_real_price, round(total_tsp / nullif(total_tlp, 0), 6) AS discount_rate FROM mon")
add("agg_store_activity", T.activity, f"WITH {T.ACT} SELECT * FROM act")
add("agg_closures", lambda s, d: cleaning.closures(T.activity(s, d)), f"WITH {T.ACT} SELECT site_no, last_idx, last_idx + 1 AS closure_idx FROM act WHERE last_idx < (SELECT max(last_idx) FROM act)")


@query("agg_closure_validate", f"WITH {T.ACT} SELECT site_no, CAST(last_idx + 1 AS INTEGER) AS closure_idx, 'not configured' AS problem FROM act WHERE last_idx < (SELECT max(last_idx) FROM act) AND gap_months > 0")
def agg_closure_validate(s: SparkSession, d: str) -> DataFrame:
    """Closures against a configuration that knows only the stores without gaps."""
    act = T.activity(s, d)
    found = cleaning.closures(act)
    return cleaning.closure_differences(found.join(act.where("gap_months = 0").select("site_no"), "site_no"), found)


add("agg_cross_store", lambda s, d: cleaning.cross_store(T.months(s, d)), f"WITH {T.MON} SELECT month_idx, item_id, sum(greatest(total_qty, 0)) AS group_positive_qty, count(*) FILTER (WHERE total_qty > 0) AS group_positive_sites FROM mon GROUP BY 1, 2")
_LT = "(CASE WHEN total_qty <= 0 THEN '0' WHEN total_qty = 1 THEN '1' WHEN total_qty <= 5 THEN '2-5' WHEN total_qty <= 20 THEN '5-20' ELSE '20+' END)"
add("lt_buckets", lambda s, d: longtail.buckets(T.months(s, d)),
    f"WITH {T.MON} SELECT bucket, count(k) AS n, round(count(k) / (SELECT count(*) FROM mon), 6) AS ratio FROM (VALUES ('0'), ('1'), ('2-5'), ('5-20'), ('20+')) v(bucket) LEFT JOIN (SELECT {_LT} AS k FROM mon) ON k = bucket GROUP BY bucket")
add("lt_describe", lambda s, d: longtail.describe(T.months(s, d)),
    f"WITH {T.MON} SELECT count(*) AS count, round(avg(total_qty), 6) AS mean, round(stddev_samp(total_qty), 6) AS std, min(total_qty) AS low, {', '.join(f'round(quantile_cont(total_qty, {p / 100}), 6) AS p{p}' for p in (50, 75, 90, 95, 99))}, max(total_qty) AS high FROM mon")
add("lt_top_share", lambda s, d: longtail.top_share(T.months(s, d)),
    f"WITH {T.MON}, r AS (SELECT total_qty, row_number() OVER (ORDER BY total_qty DESC) AS rank, count(*) OVER () AS n FROM mon) SELECT p::DOUBLE AS p, round(sum(total_qty) FILTER (WHERE rank <= greatest(1, floor(n * p))) / sum(total_qty), 6) AS share FROM r, (VALUES (0.1), (0.2)) v(p) GROUP BY p")
add("lt_category", lambda s, d: longtail.categories(T.months(s, d)),
    f"WITH {T.MON} SELECT gds_ctgry_3_lvel, count(*) AS n_rows, sum(total_qty) AS qty, quantile_cont(total_qty, 0.5) AS median_qty, round(avg(CASE WHEN total_qty <= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_not_sold FROM mon GROUP BY 1 ORDER BY qty DESC, 1 LIMIT 30")
add("lt_channel", lambda s, d: longtail.channels(T.months(s, d)),
    f"WITH {T.MON}, c AS (SELECT 'offline' AS channel, offline_qty AS q FROM mon UNION ALL SELECT 'online', online_qty FROM mon UNION ALL SELECT 'unknown_channel', unknown_channel_qty FROM mon) SELECT channel, sum(q) AS qty, count(*) FILTER (WHERE q > 0) AS rows_sold, round(sum(q) / (SELECT sum(q) FROM c), 6) AS share FROM c GROUP BY 1")
add("lt_core_ratios", lambda s, d: longtail.core_ratios(T.months(s, d)), f"WITH {T.MON} SELECT round(avg(CASE WHEN total_qty <= 0 THEN 1.0 ELSE 0.0 END), 6) AS ratio_not_sold, round(avg(CASE WHEN total_qty > 0 AND total_qty <= 5 THEN 1.0 ELSE 0.0 END), 6) AS ratio_up_to_5 FROM mon")

# panel, history, targets, activity

_PANEL = "site_no, item_id, month, total_qty, offline_qty, online_qty, unknown_channel_qty, sales_days, sales_count, return_count, return_qty, gds_ctgry_3_lvel".split(", ")
add("pn_expand", lambda s, d: T.full_panel(s, d).select(*_PANEL), f"WITH {T.PAN} SELECT {', '.join(_PANEL)} FROM pan")


@query("pn_active_expand", f"WITH {T.ADS} SELECT {', '.join(_PANEL)} FROM apan")
def pn_active_expand(s: SparkSession, d: str) -> DataFrame:
    return panel.expand(T.months(s, d), T.stores(s, d)).select(*_PANEL)


def _features(*names: str) -> tuple[Query, str]:
    plain = [f"round({n}, 6) AS {n}" for n in names]
    return lambda s, d: T.history(s, d).select("site_no", "item_id", "month", *[S.r6(F.col(n)).alias(n) for n in names]), f"WITH {T.HIS} SELECT site_no, item_id, month, {', '.join(plain)} FROM his"


add("ft_lags", *_features("qty_lag_1m", "qty_lag_2m", "qty_lag_3m", "qty_lag_6m", "offline_qty_lag_1m", "online_qty_lag_1m", "sales_days_lag_1m"))
add("ft_roll", *_features(*[f"qty_{k}_last_{n}m" for k in ("sum", "mean", "max", "std") for n in (3, 6)]))
add("ft_roll_channel", *_features(*[f"{c}_{k}_last_{n}m" for c in ("offline", "online") for k in ("qty_sum", "ratio") for n in (3, 6)]))
add("ft_roll_activity", *_features(*[f"{k}_last_{n}m" for k in ("sales_days_sum", "active_months", "zero_sales_months", "is_sold") for n in (3, 6)], "is_sold_last_1m"))
add("ft_since_last_sale", *_features("months_since_last_sale"))
add("ft_roll_amount", *_features(*[f"{k}_last_{n}m" for k in ("tsp_sum", "tlp_sum", "discount_rate") for n in (3, 6)]))
add("tg_future", lambda s, d: T.dataset(s, d).select("site_no", "item_id", "month", "split", *[f"future_{k}_{n}m" for k in ("qty", "has_sales") for n in (1, 2)]),
    f"WITH {T.HIS} SELECT site_no, item_id, month, split, future_qty_1m, future_qty_2m, future_has_sales_1m, future_has_sales_2m FROM ds")
add("tg_split", lambda s, d: T.dataset(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month")), f"WITH {T.HIS} SELECT split, count(*) AS n, min(month) AS first_month, max(month) AS last_month FROM ds GROUP BY 1")
_ACTIVE = "site_no, item_id, month, split, total_qty, future_qty_1m, future_qty_2m, target_available_1m, target_available_2m, future_has_sales_1m, future_has_sales_2m, target_mc_1m, target_mc_2m, first_idx, last_idx".split(", ")
add("as_filter", lambda s, d: T.active(s, d).select(*_ACTIVE), f"WITH {T.ADS} SELECT {', '.join(_ACTIVE)} FROM ads")
add("src_horizon_scan", lambda s, d: sources.horizon_scan(T.active(s, d), 2, ["valid", "test"], ["site_no", "item_id", "month", "future_qty_2m"]), f"WITH {T.ADS} SELECT site_no, item_id, month, future_qty_2m FROM ads WHERE target_available_2m = 1 AND split IN ('valid', 'test')")


@query("as_zero_audit", f"WITH {T.PAN} SELECT count(*) AS n_rows, count(*) FILTER (WHERE total_qty = 0) AS zero_rows, count(*) FILTER (WHERE month_idx > last_idx) AS rows_after_closure, count(*) FILTER (WHERE month_idx > last_idx AND total_qty <> 0) AS nonzero_after_closure FROM pan JOIN act USING (site_no)")
def as_zero_audit(s: SparkSession, d: str) -> DataFrame:
    return panel.closure_audit(T.full_panel(s, d), T.stores(s, d))


@query("as_exclusion_counts", f"WITH {T.HIS} SELECT CASE WHEN month_idx > last_idx THEN 'after_closure' WHEN month_idx + 1 > last_idx THEN 'cross_1m' WHEN month_idx + 2 > last_idx THEN 'cross_2m_extra' ELSE 'unaffected' END AS reason, split, count(*) AS n FROM his JOIN act USING (site_no) GROUP BY 1, 2")
def as_exclusion_counts(s: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("month") <= T.TRAIN_UNTIL, "train").when(F.col("month") <= T.VALID_UNTIL, "valid").otherwise("test")
    return panel.exclusion_counts(T.full_panel(s, d).withColumn("split", split), T.stores(s, d))


add("as_dataset_stats", lambda s, d: panel.dataset_stats(T.active(s, d)),
    f"WITH {T.ADS} SELECT coalesce(split, 'all') AS split, count(*) AS n_rows, count(*) FILTER (WHERE total_qty = 0) AS zero_rows, round(count(*) FILTER (WHERE total_qty = 0) / count(*), 6) AS zero_ratio, CAST(sum(target_available_2m) AS BIGINT) AS available_2m FROM ads GROUP BY ROLLUP (split)")
_DIFF = ["qty_diff_current_lag1", "qty_diff_lag1_lag2", "log_qty_diff_current_lag1", "sales_days_diff_current_lag1", "qty_diff_recent3_previous3", "qty_diff_6m_history_available"]
_OBS = "active_months_last_6m + zero_sales_months_last_6m = 6"
add("ft_diff", lambda s, d: panel.differences(T.history(s, d)).select("site_no", "item_id", "month", *[S.r6(F.col(c)).alias(c) for c in _DIFF]),
    f"""WITH {T.HIS} SELECT site_no, item_id, month, total_qty - qty_lag_1m AS qty_diff_current_lag1, qty_lag_1m - qty_lag_2m AS qty_diff_lag1_lag2, round(ln(1 + greatest(total_qty, 0)) - ln(1 + greatest(qty_lag_1m, 0)), 6) AS log_qty_diff_current_lag1, sales_days - sales_days_lag_1m AS sales_days_diff_current_lag1,
  round(CASE WHEN {_OBS} THEN qty_sum_last_3m / 3 - (qty_sum_last_6m - qty_sum_last_3m) / 3 ELSE 0 END, 6) AS qty_diff_recent3_previous3, CASE WHEN {_OBS} THEN 1 ELSE 0 END AS qty_diff_6m_history_available FROM his""")  # fmt: skip
_CROSS = ["xstore_qty_current", "xstore_positive_sites_current", "xstore_qty_per_positive_site_current", "xstore_qty_mean_last_3m", "xstore_qty_max_last_3m", "xstore_qty_diff_1m"]


@query("ft_cross", f"""WITH {T.HIS}, side AS (SELECT month_idx, item_id, sum(greatest(total_qty, 0)) AS gq, count(*) FILTER (WHERE total_qty > 0) AS gs FROM mon GROUP BY 1, 2),
x AS (SELECT h.site_no, h.item_id, h.month, greatest(coalesce(a.gq, 0) - greatest(total_qty, 0), 0) AS q0, greatest(coalesce(b.gq, 0) - greatest(qty_lag_1m, 0), 0) AS q1, greatest(coalesce(c.gq, 0) - greatest(qty_lag_2m, 0), 0) AS q2, greatest(coalesce(a.gs, 0) - CASE WHEN total_qty > 0 THEN 1 ELSE 0 END, 0) AS s0
  FROM his h LEFT JOIN side a ON a.item_id = h.item_id AND a.month_idx = h.month_idx LEFT JOIN side b ON b.item_id = h.item_id AND b.month_idx = h.month_idx - 1 LEFT JOIN side c ON c.item_id = h.item_id AND c.month_idx = h.month_idx - 2)
SELECT site_no, item_id, month, q0 AS xstore_qty_current, s0 AS xstore_positive_sites_current, round(coalesce(q0 / nullif(s0, 0), 0), 6) AS xstore_qty_per_positive_site_current, round((q0 + q1 + q2) / 3, 6) AS xstore_qty_mean_last_3m, greatest(q0, q1, q2) AS xstore_qty_max_last_3m, q0 - q1 AS xstore_qty_diff_1m FROM x""")
def ft_cross(s: SparkSession, d: str) -> DataFrame:
    rows = panel.cross_features(T.history(s, d), cleaning.cross_store(T.months(s, d)))
    return rows.select("site_no", "item_id", "month", *[S.r6(F.col(c)).alias(c) for c in _CROSS])


_CAL = [f"{k}{a}" for k in ("cal_year", "cal_month", "cal_quarter", "time_index") for a in ("", "_1m", "_2m")]
add("fn_calendar", lambda s, d: panel.calendar(T.months(s, d), "1995-01").select("month", *_CAL).distinct(),
    f"WITH {T.MON} SELECT DISTINCT month, {', '.join(f'CAST((month_idx + {n}) // 12 AS INTEGER) AS cal_year{a}, CAST((month_idx + {n}) % 12 + 1 AS INTEGER) AS cal_month{a}, CAST((month_idx + {n}) % 12 // 3 + 1 AS INTEGER) AS cal_quarter{a}, CAST(month_idx + {n} - 1995 * 12 AS INTEGER) AS time_index{a}' for n, a in enumerate(('', '_1m', '_2m')))} FROM mon")
add("ft_inference", lambda s, d: panel.inference_rows(T.months(s, d), "2001-07").select("site_no", "item_id", "month", "total_qty", "qty_lag_1m", "qty_sum_last_6m", "months_since_last_sale"),
    f"WITH {T.HIS} SELECT site_no, item_id, month, total_qty, qty_lag_1m, qty_sum_last_6m, months_since_last_sale FROM his WHERE month = '2001-06'")

# profiles and contracts

_RAW = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"
add("dq_file_profile", lambda s, d: checks.file_profile(T.ledger(s, d), "oln_or_ofln", ["period", "site_no", "rtn_flag", "gds_no"], ["qty", "price"], "period"),
    f"WITH {T.LED}, l AS (SELECT *, CASE channel_type WHEN 'online' THEN 'oln' WHEN 'unknown' THEN 'x' ELSE 'ofln' END AS c FROM led) SELECT coalesce(c, 'all') AS oln_or_ofln, count(*) AS n_rows, 0::BIGINT AS missing_period, 0::BIGINT AS missing_site_no, count(*) AS missing_rtn_flag, 0::BIGINT AS missing_gds_no, 0::BIGINT AS failed_qty, 0::BIGINT AS failed_price, CAST(min(period) AS VARCHAR) AS first_date, CAST(max(period) AS VARCHAR) AS last_date, count(*) FILTER (WHERE qty < 0) AS negative_qty FROM l GROUP BY ROLLUP (c)")
add("dq_top_values", lambda s, d: checks.top_values(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag", "l_linestatus", "l_suppkey"]),
    "WITH v AS (SELECT 'l_returnflag' AS field, trim(l_returnflag) AS value FROM lineitem UNION ALL SELECT 'l_linestatus', trim(l_linestatus) FROM lineitem UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem), c AS (SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2) SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c QUALIFY rank <= 20")
add("dq_date_range", lambda s, d: checks.date_range(T.ledger(s, d), "period", ["site_no"]), f"WITH {T.LED} SELECT site_no, CAST(min(period) AS VARCHAR) AS first_date, CAST(max(period) AS VARCHAR) AS last_date, string_agg(DISTINCT strftime(period, '%Y-%m'), ',' ORDER BY strftime(period, '%Y-%m')) AS months FROM led GROUP BY 1")
_EV = ["event_id", "user_id", "event_type", "value", "props"]
add("dq_column_profile", lambda s, d: checks.column_profile(s.read.parquet(f"{d}/events.parquet"), _EV), " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS distinct_count FROM events" for c in _EV))
_NUM = ["l_quantity", "l_discount", "l_tax"]
add("dq_numeric_stats", lambda s, d: checks.numeric_stats(s.read.parquet(f"{d}/lineitem.parquet"), _NUM), " UNION ALL ".join(f"SELECT '{c}' AS field, round(min({c}), 6) AS low, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(max({c}), 6) AS high FROM lineitem" for c in _NUM))
add("dq_monthly_summary", lambda s, d: T.months(s, d).agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_distinct("site_no").alias("stores"), F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("n_rows")),
    f"WITH {T.MON} SELECT min(month) AS first_month, max(month) AS last_month, count(DISTINCT site_no) AS stores, count(DISTINCT item_id) AS items, count(*) AS n_rows FROM mon")


@query("dq_panel_row_count", f"WITH {T.ACT}, f AS (SELECT site_no, item_id, min(month_idx) AS f FROM mon GROUP BY 1, 2) SELECT CAST(sum((SELECT max(last_idx) FROM act) - f + 1) AS BIGINT) AS panel_rows, CAST(sum(last_idx - f + 1) AS BIGINT) AS active_rows, count(*) AS series FROM f JOIN act USING (site_no)")
def dq_panel_row_count(s: SparkSession, d: str) -> DataFrame:
    return checks.panel_row_count(T.months(s, d), T.stores(s, d))


add("dq_duplicate_keys", lambda s, d: checks.duplicate_keys(T.ledger(s, d), ["period", "site_no", "gds_no"]), f"WITH {T.LED} SELECT period, site_no, item_id AS gds_no, count(*) AS n FROM led GROUP BY 1, 2, 3 HAVING count(*) > 1")
add("dq_validate_horizon", lambda s, d: checks.horizon_violations(T.active(s, d)), f"WITH {T.ADS} SELECT count(*) FILTER (WHERE target_available_2m = 1 AND target_available_1m <> 1) AS second_without_first, count(*) FILTER (WHERE target_mc_2m NOT IN (-1, 0, 1, 2, 3, 4)) AS unknown_level, 0::BIGINT AS wrong_level_1m, 0::BIGINT AS wrong_level_2m, count(*) FILTER (WHERE target_available_2m = 0 AND target_mc_2m <> -1) AS level_without_target, count(*) FILTER (WHERE month_idx + 1 > last_idx) AS after_close FROM ads")


@query("dq_alignment", f"WITH {T.FOR}, a AS (SELECT * FROM fc WHERE hist > 0), b AS (SELECT * FROM fc WHERE wma > 1) SELECT count(*) FILTER (WHERE b.target IS NULL) AS only_first, count(*) FILTER (WHERE a.target IS NULL) AS only_second, coalesce(max(abs(a.target - b.target)), 0) AS max_target_difference, 0::BIGINT AS bad_predictions, count(*) FILTER (WHERE a.target IS NOT NULL AND b.target IS NOT NULL) AS common FROM a FULL JOIN b USING (month, site_no, item_id)")
def dq_alignment(s: SparkSession, d: str) -> DataFrame:
    rows = T.forecasts(s, d)
    a, b = (rows.where(F.col(m) > least).select("month", "site_no", "item_id", "target", F.col(m).alias("prediction")) for m, least in (("hist", 0), ("wma", 1)))
    return checks.alignment(a, b, ["month", "site_no", "item_id"], "target", "prediction")


add("dq_unknown_rate", lambda s, d: checks.unknown_rates(T.months(s, d), F.col("month") <= "1995-03", ["gds_ctgry_3_lvel", "item_id"]),
    f"WITH {T.MON}, v AS (SELECT month <= '1995-03' AS t, 'gds_ctgry_3_lvel' AS field, gds_ctgry_3_lvel AS value FROM mon UNION ALL SELECT month <= '1995-03', 'item_id', item_id FROM mon), c AS (SELECT field, value, count(*) FILTER (WHERE t) AS i, count(*) FILTER (WHERE NOT t) AS o FROM v GROUP BY 1, 2) SELECT field, round(coalesce(sum(o) FILTER (WHERE i = 0), 0) / sum(o), 6) AS unknown_rate FROM c GROUP BY 1")
add("dq_fingerprint", lambda s, d: checks.fingerprint(T.dataset(s, d).withColumn("whole", F.col("future_qty_1m").cast("long")), ["month", "site_no", "item_id", "whole"], ["split"]),
    f"WITH {T.HIS} SELECT split, count(*) AS n_rows, CAST(CAST(sum(CAST(('0x' || substr(md5(month || '|' || site_no || '|' || item_id || '|' || CAST(future_qty_1m AS BIGINT)), 1, 12)) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS fingerprint FROM ds GROUP BY 1")


# forecasts

_FC = ["hist", "wma", "two"]
add("fc_formulas", lambda s, d: T.forecasts(s, d).select("month", "site_no", "item_id", *[S.r6(F.col(c)).alias(c) for c in _FC], S.r6(forecast.historical_mean(2)).alias("hist_2m"), S.r6(forecast.weighted_average(2)).alias("wma_2m")),
    f"WITH {T.FOR} SELECT month, site_no, item_id, round(hist, 6) AS hist, round(wma, 6) AS wma, round(two, 6) AS two, round(hist * 2, 6) AS hist_2m, round(wma * 2, 6) AS wma_2m FROM fc")
add("fc_gate", lambda s, d: T.forecasts(s, d).select("month", "site_no", "item_id", S.r6(forecast.gate_a(F.col("p"), F.col("q"), 0.5)).alias("gate_a"), S.r6(forecast.gate_b(F.col("p"), F.col("q"), 0.5)).alias("gate_b")),
    f"WITH {T.FOR} SELECT month, site_no, item_id, round(CASE WHEN p < 0.5 THEN 0 ELSE CAST(p AS DOUBLE) * q END, 6) AS gate_a, round(CASE WHEN p < 0.5 THEN 0 ELSE q END, 6) AS gate_b FROM fc")
add("fc_calibrate", lambda s, d: forecast.calibrated(T.forecasts(s, d), "target", "hist", ["gds_ctgry_3_lvel"]).groupBy("gds_ctgry_3_lvel").agg(S.r6(F.max("factor")).alias("factor"), F.round(F.sum("calibrated"), 3).alias("calibrated_sum")),
    f"WITH {T.FOR} SELECT gds_ctgry_3_lvel, round(coalesce(sum(target) / nullif(sum(hist), 0), 1), 6) AS factor, round(sum(hist) * coalesce(sum(target) / nullif(sum(hist), 0), 1), 3) AS calibrated_sum FROM fc GROUP BY 1")
add("fc_top_threshold", lambda s, d: forecast.top_threshold(T.forecasts(s, d), "qty_sum_last_3m", 0.05, ["split"]),
    f"WITH {T.FOR}, r AS (SELECT split, qty_sum_last_3m, row_number() OVER (PARTITION BY split ORDER BY qty_sum_last_3m) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM fc) SELECT split, min(qty_sum_last_3m) AS threshold FROM r WHERE i >= ceil(round((n - 1) * 0.95, 9)) GROUP BY 1")
add("fc_weighted_threshold", lambda s, d: forecast.weighted_threshold(T.forecasts(s, d).withColumn("w", F.col("target") + 1), "qty_sum_last_3m", "w", 0.1, ["split"]),
    f"WITH {T.FOR}, g AS (SELECT split, qty_sum_last_3m AS x, sum(target + 1) AS w FROM fc GROUP BY 1, 2), c AS (SELECT split, x, sum(w) OVER (PARTITION BY split ORDER BY x DESC) AS u, sum(w) OVER (PARTITION BY split) AS t FROM g) SELECT split, max(x) AS threshold FROM c WHERE round(u, 6) >= round(0.1 * t, 6) GROUP BY 1")
add("fc_multiplier", lambda s, d: forecast.multiplier(T.forecasts(s, d), "target", "hist", F.lit(1.0), ["site_no"]).select("site_no", S.r6(F.col("multiplier")).alias("multiplier")),
    f"WITH {T.FOR} SELECT site_no, round(least(greatest(coalesce(sqrt(sum(target) / nullif(sum(hist), 0)), 1), 1), 1.5), 6) AS multiplier FROM fc GROUP BY 1")


add("fc_comp_apply", lambda s, d: T.forecasts(s, d).groupBy("split").agg(F.round(F.sum(forecast.compensated(F.col("hist"), F.col("qty_sum_last_3m"), F.col("qty_lag_1m"), (20.0, 1.1), (15.0, 1.25))), 3).alias("compensated_sum")),
    f"WITH {T.FOR} SELECT split, round(sum(hist * CASE WHEN least(qty_lag_1m, qty_sum_last_3m) >= 15 THEN 1.25::DOUBLE WHEN qty_sum_last_3m >= 20 THEN 1.1::DOUBLE ELSE 1 END), 3) AS compensated_sum FROM fc GROUP BY 1")
add("fc_postprocess", lambda s, d: T.predictions(s, d).withColumn("pred_qty_raw", S.r6(F.col("pred_qty_raw"))).withColumn("p_sale", S.r6(F.col("p_sale"))), f"WITH {T.PRE} SELECT * REPLACE (round(pred_qty_raw, 6) AS pred_qty_raw, round(CAST(p_sale AS DOUBLE), 6) AS p_sale) FROM pre")

# evaluation

_METRIC = """count(*) AS count, round(sum(abs(p - t)) / count(*) + 1e-9, 6) AS mae, round(sqrt(sum((p - t) * (p - t)) / count(*)) + 1e-9, 6) AS rmse, round(100 * sum(coalesce(2 * abs(p - t) / nullif(t + p, 0), 0)) / count(*) + 1e-9, 6) AS smape,
  round(CASE WHEN sum(t) = 0 THEN CASE WHEN sum(abs(p - t)) = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE 100 * sum(abs(p - t)) / sum(t) END + 1e-9, 6) AS wape, round(sum(t) + 1e-9, 6) AS target_sum, round(sum(p) + 1e-9, 6) AS prediction_sum, round(100 * (sum(p) - sum(t)) / nullif(sum(t), 0) + 1e-9, 6) AS total_bias_rate"""
_BUCKET = "CASE WHEN t = 0 THEN '0' WHEN t < 2 THEN '1' WHEN t < 5 THEN '2-5' WHEN t < 20 THEN '5-20' ELSE '20+' END"
_LONG = f"lo AS (SELECT split, candidate, target AS t, p, current, month, site_no, item_id FROM (SELECT *, 'hist' AS candidate, hist AS p FROM (SELECT * EXCLUDE (p) FROM fc) UNION ALL SELECT *, 'wma', wma FROM (SELECT * EXCLUDE (p) FROM fc) UNION ALL SELECT *, 'two', two FROM (SELECT * EXCLUDE (p) FROM fc)))"
_SEG = f"sg AS (SELECT *, unnest(list_filter(['overall', {_BUCKET}, CASE WHEN t > 0 THEN 'nonzero' END, CASE WHEN t >= 5 THEN 'ge_5' END, CASE WHEN t >= 20 THEN 'ge_20' END], lambda x: x IS NOT NULL)) AS segment FROM lo)"
LONG = f"{T.FOR},\n{_LONG}"


def _judged(s: SparkSession, d: str) -> DataFrame:
    """(split, candidate, target, prediction, current, keys) of all formula forecasts."""
    rows = metrics.candidates(T.forecasts(s, d), _FC)
    return metrics.cleaned(rows, "target", "prediction")


add("mt_quantity", lambda s, d: metrics.quantity(_judged(s, d), ["split", "candidate"]), f"WITH {LONG} SELECT split, candidate, {_METRIC} FROM lo GROUP BY 1, 2")
add("mt_by_bucket", lambda s, d: metrics.quantity(metrics.segmented(_judged(s, d), metrics.bucket_segments()), ["candidate", "segment"]),
    f"WITH {LONG}, {_SEG} SELECT candidate, segment, {_METRIC} FROM sg WHERE segment NOT IN ('nonzero', 'ge_5', 'ge_20') GROUP BY 1, 2")
add("mt_long_tail", lambda s, d: metrics.long_tail(_judged(s, d), ["split", "candidate"]),
    f"WITH {LONG}, {_SEG} SELECT * REPLACE (CASE WHEN segment <> '0' THEN wape END AS wape) FROM (SELECT split, candidate, segment, {_METRIC}, CASE WHEN segment = '0' THEN round(avg(p), 6) END AS mean_prediction, CASE WHEN segment = '0' THEN round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), 6) END AS prediction_gt_0_5_rate, CASE WHEN segment = '0' THEN round(avg(CASE WHEN p > 1 THEN 1.0 ELSE 0.0 END), 6) END AS prediction_gt_1_rate FROM sg GROUP BY 1, 2, 3)")
add("mt_exact_range", lambda s, d: metrics.quantity(metrics.segmented(_judged(s, d), metrics.exact_segments()), ["candidate", "segment"]),
    f"WITH {LONG}, sx AS (SELECT *, unnest(list_filter(['overall', CASE WHEN t = 0 THEN 'eq_0' END, CASE WHEN t = 1 THEN 'eq_1' END, CASE WHEN t >= 2 AND t < 5 THEN '2_to_5' END, CASE WHEN t >= 5 AND t < 20 THEN '5_to_20' END, CASE WHEN t >= 20 THEN 'ge_20' END, CASE WHEN t > 0 THEN 'nonzero' END], lambda x: x IS NOT NULL)) AS segment FROM lo) SELECT candidate, segment, {_METRIC} FROM sx GROUP BY 1, 2")
_WEIGHTED = _METRIC.replace("count(*) AS count", "count(*) AS c").replace("count(*),", "sum(w),").replace("/ count(*)", "/ sum(w)").replace("sum(abs", "sum(w * abs").replace("sum((p", "sum(w * (p").replace("sum(coalesce", "sum(w * coalesce").replace("sum(t)", "sum(w * t)").replace("sum(p)", "sum(w * p)").replace("count(*) AS c", "count(*) AS count")
add("mt_weighted", lambda s, d: metrics.quantity(metrics.cleaned(metrics.candidates(sampling.stratified(T.forecasts(s, d), "target", sampling.RATES), _FC), "target", "prediction"), ["split", "candidate"], F.col("sample_weight")),
    None)
add("mt_iteration", lambda s, d: metrics.quantity(_judged(s, d), ["candidate"]).select("candidate", "count", "wape", "total_bias_rate"), f"WITH {LONG} SELECT candidate, count, wape, total_bias_rate FROM (SELECT candidate, {_METRIC} FROM lo GROUP BY 1)")
_TL, _PL = T.level_sql("t"), T.level_sql("p")
_CONF = f"cf AS (SELECT g.split, g.candidate, a.x AS true_code, b.x AS pred_code, count(l.t) AS n FROM (SELECT DISTINCT split, candidate FROM lo) g CROSS JOIN range(5) a(x) CROSS JOIN range(5) b(x) LEFT JOIN (SELECT *, {_TL} AS tl, {_PL} AS pl FROM lo) l ON l.split = g.split AND l.candidate = g.candidate AND tl = a.x AND pl = b.x GROUP BY 1, 2, 3, 4)"


def _confusion(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_judged(s, d), S.level(F.col("target")), S.level(F.col("prediction")), ["split", "candidate"])


add("mt_confusion", _confusion, f"WITH {LONG}, {_CONF} SELECT * FROM cf")
add("mt_classification", lambda s, d: metrics.classification(_confusion(s, d), ["split", "candidate"]),
    f"""WITH {LONG}, {_CONF}, pc AS (SELECT split, candidate, code, CAST(sum(CASE WHEN true_code = code THEN n ELSE 0 END) AS BIGINT) AS tr, sum(CASE WHEN pred_code = code THEN n ELSE 0 END) AS gu, sum(CASE WHEN true_code = code AND pred_code = code THEN n ELSE 0 END) AS tp FROM cf, range(5) c(code) GROUP BY 1, 2, 3),
pf AS (SELECT *, coalesce(2.0 * tp / nullif(tr + gu, 0), 0) AS f1 FROM pc), er AS (SELECT split, candidate, sum(n) FILTER (WHERE abs(true_code - pred_code) = 1) AS near, sum(n) FILTER (WHERE abs(true_code - pred_code) >= 2) AS far FROM cf GROUP BY 1, 2)
SELECT split, candidate, CAST(sum(tr) AS BIGINT) AS count, round(sum(tp) / sum(tr), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * tr) / sum(tr), 6) AS weighted_f1, round(any_value(near) / sum(tr), 6) AS adjacent_error_rate, round(any_value(far) / sum(tr), 6) AS severe_error_rate, round(max(CASE WHEN code = 4 THEN tp / nullif(tr, 0) END), 6) AS high_level_recall FROM pf JOIN er USING (split, candidate) GROUP BY 1, 2""")  # fmt: skip
add("mt_trend", lambda s, d: metrics.trend(_judged(s, d), ["split", "candidate"]),
    f"WITH {LONG}, tr AS (SELECT split, candidate, sign(t - current) AS a, sign(p - current) AS b FROM lo) SELECT split, candidate, count(*) AS count, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS trend_accuracy, round(count(*) FILTER (WHERE a = 1 AND b = 1) / nullif(count(*) FILTER (WHERE a = 1), 0), 6) AS up_recall, round(count(*) FILTER (WHERE a = -1 AND b = -1) / nullif(count(*) FILTER (WHERE a = -1), 0), 6) AS down_recall, round(count(*) FILTER (WHERE a * b = -1) / count(*), 6) AS severe_direction_error_rate FROM tr GROUP BY 1, 2")


_TAU = [round(0.05 * i, 2) for i in range(1, 20)]
_GS = "sx AS (SELECT CAST(p AS DOUBLE) AS p, q, target AS t, unnest(list_filter(['overall', CASE WHEN target = 0 THEN 'zero' END, CASE WHEN target > 0 THEN 'nonzero' END, CASE WHEN target = 1 THEN 'qty_1' END, CASE WHEN target >= 2 AND target < 5 THEN 'qty_2_5' END, CASE WHEN target >= 5 AND target < 20 THEN '5_20' END, CASE WHEN target >= 20 THEN '20plus' END], lambda x: x IS NOT NULL)) AS segment FROM fc)"
_SWEEP = f"""SELECT segment, tau AS threshold, count(*) AS count, round(sum(t), 6) AS target_sum, round(100 * sum(abs(CASE WHEN p >= tau THEN p * q ELSE 0 END - t)) / nullif(sum(t), 0), 6) AS wape_gate_a, round(100 * sum(abs(CASE WHEN p >= tau THEN q ELSE 0 END - t)) / nullif(sum(t), 0), 6) AS wape_gate_b,
  round(sum(CASE WHEN p >= tau THEN p * q ELSE 0 END), 6) AS prediction_sum_a, round(sum(CASE WHEN p >= tau THEN q ELSE 0 END), 6) AS prediction_sum_b, count(*) FILTER (WHERE p >= tau) AS passing, round(count(*) FILTER (WHERE p >= tau) / count(*), 6) AS pass_rate FROM sx, (SELECT unnest({_TAU}::DOUBLE[]) AS tau) GROUP BY 1, 2"""
_PB = "count(*) AS count, round(avg(p), 6) AS mean_p, " + ", ".join(f"list_sort(list(floor(p * 10000 + 0.5)))[CAST(ceil({x} * count(*)) AS BIGINT)] / 10000 AS p{round(100 * x)}" for x in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", " + ", ".join(f"round(count(*) FILTER (WHERE p < {x}) / count(*), 6) AS share_below_{n}" for x, n in ((0.2, "02"), (0.3, "03"), (0.5, "05")))
add("mt_prob_diag", lambda s, d: metrics.probability_bins(T.forecasts(s, d), S.demand_bucket(F.col("target"))), f"WITH {T.FOR}, x AS (SELECT CAST(p AS DOUBLE) AS p, target AS t FROM fc) SELECT {_BUCKET} AS grp, {_PB} FROM x GROUP BY 1")
add("mt_binary_rank", lambda s, d: metrics.binary_rank(T.forecasts(s, d), "p", F.col("target") > 0, ["split"]),
    f"""WITH {T.FOR}, b AS (SELECT split, floor(CAST(p AS DOUBLE) * 1000) AS bin, sum(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS pos, count(*) AS a, sum(-CASE WHEN target > 0 THEN ln(greatest(CAST(p AS DOUBLE), 1e-15)) ELSE ln(1 - least(CAST(p AS DOUBLE), 1 - 1e-15)) END) AS loss FROM fc GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY bin DESC) AS tp, sum(a) OVER (PARTITION BY split ORDER BY bin DESC) AS seen FROM b)
SELECT split, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision, round(sum((a - pos) * (tp - pos / 2)) / (sum(pos) * (sum(a) - sum(pos))), 6) AS roc_auc, round(sum(loss) / sum(a), 6) AS logloss, round(sum(pos) / sum(a), 6) AS positive_rate FROM c GROUP BY 1""")  # fmt: skip
_HL, _WL = T.level_sql("hist"), T.level_sql("wma")
add("mt_mc_disagree", lambda s, d: metrics.disagreement(T.forecasts(s, d), S.level(F.col("hist")), S.level(F.col("wma")), ["split"]),
    f"WITH {T.FOR} SELECT split, CASE WHEN {_HL} = {_WL} THEN 'same' WHEN {_HL} = {T.level_sql('target')} THEN 'first_right' WHEN {_WL} = {T.level_sql('target')} THEN 'second_right' ELSE 'both_wrong' END AS kind, count(*) AS n FROM fc GROUP BY 1, 2")
add("mt_describe", lambda s, d: metrics.describe(T.forecasts(s, d), F.col("hist") - F.col("target"), ["split"]),
    f"WITH {T.FOR} SELECT split, count(*) AS count, round(avg(hist - target), 6) AS mean, round(quantile_cont(hist - target, 0.25), 6) AS p25, round(quantile_cont(hist - target, 0.5), 6) AS median, round(quantile_cont(hist - target, 0.75), 6) AS p75 FROM fc GROUP BY 1")
add("mt_migration", lambda s, d: metrics.migration(T.forecasts(s, d), S.level(F.col("hist")), S.level(F.col("wma")), ["split"]), f"WITH {T.FOR} SELECT split, {_HL} AS from_level, {_WL} AS to_level, count(*) AS n, round(sum(target), 6) AS target_sum FROM fc GROUP BY 1, 2, 3")
add("mt_median_ratio", lambda s, d: metrics.median_ratio(_judged(s, d), ["split", "candidate"]), f"WITH {LONG} SELECT split, candidate, count(*) AS count, round(quantile_cont(p / t, 0.5), 6) AS median_ratio FROM lo WHERE t >= 20 GROUP BY 1, 2")
add("mt_head_month", lambda s, d: metrics.head_months(_judged(s, d), ["month", "candidate"]),
    f"WITH {LONG} SELECT month, candidate, count(*) AS count, round(sum(t), 3) AS target_sum, round(quantile_cont(p / t, 0.5), 6) AS median_ratio, round(quantile_cont(t, 0.5), 6) AS median_target, round(quantile_cont(p, 0.5), 6) AS median_prediction, round(quantile_cont(t, 0.9), 6) AS p90_target, round(quantile_cont(t, 0.95), 6) AS p95_target, round(avg(CASE WHEN p >= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(100 * sum(abs(p - t)) / sum(t), 6) AS wape FROM lo WHERE t >= 20 GROUP BY 1, 2")
_HF = ["current", "qty_lag_1m", "qty_sum_last_3m", "active_months_last_6m", "p", "hist"]
add("mt_head_features", lambda s, d: metrics.head_features((rows := T.forecasts(s, d)).where("split <> 'train'"), rows.where("split = 'train'"), ["month"], _HF),
    f"""WITH {T.FOR}, l AS MATERIALIZED ({' UNION ALL '.join(f"SELECT split, month, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM fc WHERE target >= 20" for f in _HF)}),
m AS (SELECT month, feature, count(*) AS count, avg(v) AS mean, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM l WHERE split <> 'train' GROUP BY 1, 2)
SELECT month, feature, count, round(mean, 6) AS mean, round(a, 6) AS p25, round(b, 6) AS median, round(c, 6) AS p75, round(100 * (SELECT count(*) FILTER (WHERE v <= b) / count(*) FROM l WHERE split = 'train' AND l.feature = m.feature), 6) AS median_train_percentile FROM m""")  # fmt: skip



# sampling

_U = lambda h, seed=42: f"(CAST(('0x' || substr(md5(month || '|' || site_no || '|' || item_id || '|{h}|{seed}'), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"
_RATE = "(CASE WHEN target = 0 THEN 0.05::DOUBLE WHEN target < 2 THEN 0.2::DOUBLE WHEN target < 5 THEN 0.4::DOUBLE WHEN target < 20 THEN 0.8::DOUBLE ELSE 1::DOUBLE END)"
STRATA = f"sa AS (SELECT *, {_RATE} AS sampling_probability, 1 / {_RATE} AS sample_weight FROM fc WHERE {_U('1m')} < {_RATE})"
ORACLES["mt_weighted"] = f"WITH {T.FOR}, {STRATA}, lo AS (SELECT split, sample_weight AS w, target AS t, unnest(['hist', 'wma', 'two']) AS candidate, unnest([hist, wma, two]) AS p FROM sa) SELECT split, candidate, {_WEIGHTED} FROM lo GROUP BY 1, 2"


def _stratified(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(T.forecasts(s, d), "target", sampling.RATES)


add("sm_stratified", lambda s, d: _stratified(s, d).select("month", "site_no", "item_id", "target", "sampling_probability", "sample_weight"), f"WITH {T.FOR}, {STRATA} SELECT month, site_no, item_id, target, sampling_probability, sample_weight FROM sa")
add("fn_hash_uniform", lambda s, d: T.months(s, d).select("month", "site_no", "item_id", F.round(sampling.uniform("1m", 7), 12).alias("u")), f"WITH {T.MON} SELECT month, site_no, item_id, round({_U('1m', 7)}, 12) AS u FROM mon")
add("sm_bucket_counts", lambda s, d: sampling.bucket_counts(T.dataset(s, d)),
    f"WITH {T.HIS}, l AS (SELECT split, '1m' AS horizon, greatest(future_qty_1m, 0) AS t FROM ds UNION ALL SELECT split, '2m', greatest(future_qty_2m, 0) FROM ds) SELECT split, horizon, {_BUCKET} AS bucket, count(*) AS n FROM l GROUP BY 1, 2, 3")
add("sm_distribution", lambda s, d: sampling.distribution(_stratified(s, d), "target", "gds_ctgry_3_lvel"),
    f"WITH {T.FOR}, {STRATA} SELECT gds_ctgry_3_lvel, round(sum(sample_weight), 6) AS weighted_rows, round(sum(sample_weight * target) / sum(sample_weight), 6) AS mean, round(coalesce(sum(sample_weight) FILTER (WHERE target > 0), 0) / sum(sample_weight), 6) AS nonzero_rate, round(sum(sample_weight) / (SELECT sum(sample_weight) FROM sa), 6) AS share FROM sa GROUP BY 1")
add("dq_distribution_shift", lambda s, d: checks.weight_shift(T.forecasts(s, d), F.lit(1.0), sampling.sample_weight("target", sampling.RATES), ["gds_ctgry_3_lvel", "site_no", "month"]),
    f"""WITH {T.FOR}, {STRATA}, a AS (SELECT f AS field, v AS value, count(*) AS w FROM (SELECT unnest(['gds_ctgry_3_lvel', 'site_no', 'month']) AS f, unnest([gds_ctgry_3_lvel, site_no, month]) AS v FROM fc) GROUP BY 1, 2), b AS (SELECT f AS field, v AS value, sum(w) AS w FROM (SELECT unnest(['gds_ctgry_3_lvel', 'site_no', 'month']) AS f, unnest([gds_ctgry_3_lvel, site_no, month]) AS v, sample_weight AS w FROM sa) GROUP BY 1, 2),
j AS (SELECT field, abs(coalesce(x, 0) - coalesce(y, 0)) AS d FROM (SELECT field, value, w / sum(w) OVER (PARTITION BY field) AS x FROM a) FULL JOIN (SELECT field, value, w / sum(w) OVER (PARTITION BY field) AS y FROM b) USING (field, value)) SELECT field, round(max(d), 6) AS max_share_difference, round(max(d), 6) > 0.02 AS fails FROM j GROUP BY 1""")  # fmt: skip
add("sm_priority_topn", lambda s, d: sampling.first_by_hash(T.forecasts(s, d), ["split", "gds_ctgry_3_lvel"], 20).select("split", "gds_ctgry_3_lvel", "month", "site_no", "item_id", "rank"),
    f"WITH {T.FOR} SELECT split, gds_ctgry_3_lvel, month, site_no, item_id, row_number() OVER (PARTITION BY split, gds_ctgry_3_lvel ORDER BY {_U('sample')}, month, site_no, item_id) AS rank FROM fc QUALIFY rank <= 20")
add("sm_audit_mix", lambda s, d: sampling.audit_mix(T.forecasts(s, d).withColumn("prediction", F.col("hist"))).select("month", "site_no", "item_id", "split", "target", "reasons"),
    f"""WITH {T.FOR}, r AS (SELECT month, site_no, item_id, split, target, row_number() OVER (PARTITION BY split ORDER BY {_U('audit')}, month, site_no, item_id) AS a, row_number() OVER (PARTITION BY split, {T.level_sql('target')} ORDER BY {_U('audit')}, month, site_no, item_id) AS b, row_number() OVER (PARTITION BY split ORDER BY abs(hist - target) DESC, month, site_no, item_id) AS c FROM fc)
SELECT month, site_no, item_id, split, target, concat_ws(',', CASE WHEN b <= 50 THEN 'level' END, CASE WHEN a <= 50 THEN 'random' END, CASE WHEN c <= 50 THEN 'worst' END) AS reasons FROM r WHERE a <= 50 OR b <= 50 OR c <= 50""")  # fmt: skip
add("sm_uniform", lambda s, d: T.forecasts(s, d).where("split = 'train'").where(sampling.uniform("uniform", 42) < 0.02).select("month", "site_no", "item_id"), f"WITH {T.FOR} SELECT month, site_no, item_id FROM fc WHERE split = 'train' AND {_U('uniform')} < 0.02::DOUBLE")
_FOLDS = [("1998-12", "1999-01", "1999-06"), ("1999-06", "1999-07", "1999-12"), ("1999-12", "2000-01", "2000-06")]
_FOLD_SQL = "fo AS (SELECT fc.*, fold, CASE WHEN month <= e THEN 'train' ELSE 'valid' END AS kind FROM fc, (VALUES (1, '1998-12', '1999-01', '1999-06'), (2, '1999-06', '1999-07', '1999-12'), (3, '1999-12', '2000-01', '2000-06')) v(fold, e, a, z) WHERE month <= e OR month BETWEEN a AND z)"
add("sm_time_folds", lambda s, d: sampling.time_folds(T.forecasts(s, d), _FOLDS).groupBy("fold", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.sum("target").alias("target_sum")),
    f"WITH {T.FOR}, {_FOLD_SQL} SELECT fold, kind, count(*) AS n, min(month) AS first_month, max(month) AS last_month, sum(target) AS target_sum FROM fo GROUP BY 1, 2")
add("sm_multi_kind", lambda s, d: sampling.many_kinds(T.forecasts(s, d), "target", {"train": sampling.RATES, "probe": dict.fromkeys(S.BUCKETS, 0.05)}).groupBy("sample_kind", "split").agg(F.count(F.lit(1)).alias("n"), S.r6(F.sum("sample_weight")).alias("w")),
    f"WITH {T.FOR} SELECT 'train' AS sample_kind, split, count(*) AS n, round(sum(1 / {_RATE}), 6) AS w FROM fc WHERE {_U('train')} < {_RATE} GROUP BY 2 UNION ALL SELECT 'probe', split, count(*), round(sum(1 / 0.05::DOUBLE), 6) FROM fc WHERE {_U('probe')} < 0.05::DOUBLE GROUP BY 2")


add("sm_scaled_rates", lambda s, d: sampling.stratified_to(T.forecasts(s, d), "target", sampling.RATES, 2000).select("month", "site_no", "item_id", "target", S.r6(F.col("sampling_probability")).alias("sampling_probability"), S.r6(F.col("sample_weight")).alias("sample_weight")),
    f"""WITH {T.FOR}, bu AS (SELECT *, {_RATE} AS own FROM fc), co AS (SELECT own, count(*) AS n FROM bu GROUP BY 1),
sg AS (SELECT own, (2000 - coalesce(sum(n) OVER (ORDER BY own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(n * own) OVER (ORDER BY own DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x, coalesce(1 / lag(own) OVER (ORDER BY own DESC), 0) AS begins FROM co),
fa AS (SELECT min(x) FILTER (WHERE x BETWEEN begins - 1e-12 AND 1 / own + 1e-12) AS f FROM sg),
ra AS (SELECT bu.*, round(least(1, coalesce(own * f, 1)), 9) AS r FROM bu, fa) SELECT month, site_no, item_id, target, round(r, 6) AS sampling_probability, round(1 / r, 6) AS sample_weight FROM ra WHERE {_U('1m')} < r""")  # fmt: skip

# sources and sinks

_TITLES = {"period": "销售日期", "site_no": "门店编码", "gds_no": "商品编码", "gds_ctgry_3_lvel": "品类", "oln_or_ofln": "渠道", "qty": "数量", "price": "定价", "tsp": "实洋"}


def src_zip_csv(s: SparkSession, d: str) -> DataFrame:
    """The ledger written as zipped CSV files in three encodings under other headers, read member by member and cleaned again: sums by store and channel."""
    folder = f"{shared_folder(s)}/archives-{uuid.uuid4().hex}"
    ledger = T.ledger(s, d).select(*_TITLES)  # a large one is dealt already
    archives.write_zipped_csv(ledger if T.parts(s, d) else ledger.repartition(6), folder, _TITLES, ("utf-8-sig", "utf-8", "gb18030"), 5000)
    columns = list(_TITLES.values())
    rows = archives.read_zipped_csv(s, folder, columns, archives.UPLOAD_ENCODINGS, archives.TASK_BYTES)
    cleaned = cleaning.clean(sources.to_ledger(rows, sources.field_mapping(columns)))
    return cleaned.groupBy("site_no", "channel_type").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.min("period").alias("first_day"), F.max("period").alias("last_day"), F.count_distinct("gds_no").alias("n_items"))


add("src_zip_csv", src_zip_csv, f"WITH {T.LED} SELECT site_no, channel_type, count(*) AS n, sum(qty) AS qty, min(period) AS first_day, max(period) AS last_day, count(DISTINCT item_id) AS n_items FROM led GROUP BY 1, 2")
add("so_stable_sort", lambda s, d: sources.numbered(T.months(s, d).select("month", "site_no", "item_id", "total_qty"), [F.desc("total_qty"), "month", "site_no", "item_id"], parts=T.parts(s, d)), f"WITH {T.MON} SELECT month, site_no, item_id, total_qty, row_number() OVER (ORDER BY total_qty DESC, month, site_no, item_id) AS row_number FROM mon")

# selection

add("sel_metric_order", lambda s, d: selection.best(metrics.quantity(_judged(s, d), ["site_no", "candidate"]), ["site_no"], [("wape", "min"), ("total_bias_rate", "abs_min")], ["candidate"]).select("site_no", "candidate", "wape", "total_bias_rate"),
    f"WITH {LONG.replace('SELECT split, candidate, target', 'SELECT split, site_no AS sn, candidate, target')}, q AS (SELECT site_no, candidate, {_METRIC} FROM lo GROUP BY 1, 2) SELECT site_no, candidate, wape, total_bias_rate FROM q QUALIFY row_number() OVER (PARTITION BY site_no ORDER BY coalesce(wape, 'inf'::DOUBLE), abs(coalesce(total_bias_rate, 'inf'::DOUBLE)), candidate) = 1")
add("sel_metric_winners", lambda s, d: selection.winners(metrics.quantity(_judged(s, d), ["site_no", "candidate"]), ["site_no"], [("wape", "min"), ("rmse", "min"), ("total_bias_rate", "abs_min")], ["candidate"], 2).select("site_no", "candidate", "n_best", "rank"),
    f"""WITH {LONG}, q AS (SELECT site_no, candidate, {_METRIC} FROM lo GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_no ORDER BY wape, candidate) = 1 AS INTEGER) + CAST(row_number() OVER (PARTITION BY site_no ORDER BY rmse, candidate) = 1 AS INTEGER) + CAST(row_number() OVER (PARTITION BY site_no ORDER BY abs(total_bias_rate), candidate) = 1 AS INTEGER) AS n_best FROM q)
SELECT site_no, candidate, n_best, row_number() OVER (PARTITION BY site_no ORDER BY n_best DESC, candidate) AS rank FROM r WHERE n_best > 0 QUALIFY rank <= 2""")  # fmt: skip


@query("sel_business", f"""WITH {LONG}, z AS (SELECT site_no, candidate, avg(CASE WHEN t = 0 THEN CASE WHEN p > 1 THEN 1.0 ELSE 0.0 END END) AS zr, round(sum(abs(p - t)) / count(*), 6) AS mae, round(100 * (sum(p) - sum(t)) / sum(t), 6) AS total_bias_rate, round(100 * sum(abs(p - t)) FILTER (WHERE t > 0) / sum(t), 6) AS nonzero_wape, round(100 * sum(abs(p - t)) FILTER (WHERE t >= 20) / sum(t) FILTER (WHERE t >= 20), 6) AS ge_20_wape FROM lo GROUP BY 1, 2),
b AS (SELECT *, min(mae) OVER (PARTITION BY site_no) AS base FROM z), c AS (SELECT *, concat_ws(',', CASE WHEN zr > 0.8 THEN 'zero_false_positives' END, CASE WHEN mae > base * 1.35 THEN 'mae' END) AS reasons FROM b)
SELECT site_no, candidate, reasons, reasons = '' AS accepted, row_number() OVER (PARTITION BY site_no ORDER BY reasons = '' DESC, abs(total_bias_rate), nonzero_wape, ge_20_wape, candidate) AS rank FROM c""")
def sel_business(s: SparkSession, d: str) -> DataFrame:
    """Guardrails against the store's best MAE; at most 80 % of zero rows may be forecast above one."""
    rows = _judged(s, d)
    t, p = F.col("target"), F.col("prediction")
    error = F.abs(p - t)
    share = lambda mask: S.r6(100 * F.sum(F.when(mask, error)) / F.sum(F.when(mask, t)))
    found = rows.groupBy("site_no", "candidate").agg(
        F.avg(F.when(t == 0, F.when(p > 1, 1.0).otherwise(0.0))).alias("zr"), S.r6(F.sum(error) / F.count(F.lit(1))).alias("mae"), S.r6(100 * (F.sum(p) - F.sum(t)) / F.sum(t)).alias("total_bias_rate"), share(t > 0).alias("nonzero_wape"), share(t >= 20).alias("ge_20_wape"),
    )
    base = found.groupBy("site_no").agg(F.min("mae").alias("base_mae"))
    judged = selection.business(found.join(base, "site_no").withColumn("zero_gt_1_rate", F.when(F.col("zr") > 0.8, F.col("zr")).otherwise(0.0)), ["site_no"], ["candidate"])
    return judged.select("site_no", "candidate", "reasons", "accepted", "rank")


def _recalls(s: SparkSession, d: str) -> DataFrame:
    """The gate sweep with the recalls of both head segments beside each threshold."""
    sweep = metrics.gate_sweep(T.forecasts(s, d), _TAU)
    heads = sweep.groupBy("threshold").agg(F.max(F.when(F.col("segment") == "5_20", F.col("pass_rate"))).alias("recall_5_20"), F.max(F.when(F.col("segment") == "20plus", F.col("pass_rate"))).alias("recall_20plus"))
    return sweep.join(heads, "threshold").where(F.col("wape_gate_a").isNotNull())


_HEADS = f"sw AS ({_SWEEP}), he AS (SELECT threshold, max(CASE WHEN segment = '5_20' THEN pass_rate END) AS r5, max(CASE WHEN segment = '20plus' THEN pass_rate END) AS r20 FROM sw GROUP BY 1), sh AS (SELECT * FROM sw JOIN he USING (threshold) WHERE wape_gate_a IS NOT NULL)"
add("sel_gate_safe", lambda s, d: selection.gate(_recalls(s, d), ["segment"], "wape_gate_a", 0.8).select("segment", "threshold", "wape_gate_a"),
    f"WITH {T.FOR}, {_GS}, {_HEADS} SELECT segment, threshold, wape_gate_a FROM sh WHERE r5 >= 0.8 AND r20 >= 0.8 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY wape_gate_a, threshold) = 1")
add("sel_gate_protect", lambda s, d: selection.gate_protected(_recalls(s, d), ["segment"], "wape_gate_b", (0.7, 0.8, 0.9)).select("segment", "protection", "threshold", "wape_gate_b"),
    f"WITH {T.FOR}, {_GS}, {_HEADS} SELECT segment, v::DOUBLE AS protection, threshold, wape_gate_b FROM sh, (VALUES (0.7), (0.8), (0.9)) x(v) WHERE r5 >= v AND r20 >= v QUALIFY row_number() OVER (PARTITION BY segment, v ORDER BY wape_gate_b, threshold) = 1")


add("sel_weighted_median", lambda s, d: selection.weighted_median(T.forecasts(s, d).withColumn("w", F.col("target") + 1), ["gds_ctgry_3_lvel"], "qty_sum_last_3m", "w"),
    f"WITH {T.FOR}, g AS (SELECT gds_ctgry_3_lvel, qty_sum_last_3m AS x, sum(target + 1) AS w FROM fc GROUP BY 1, 2), c AS (SELECT gds_ctgry_3_lvel, x, sum(w) OVER (PARTITION BY gds_ctgry_3_lvel ORDER BY x) AS u, sum(w) OVER (PARTITION BY gds_ctgry_3_lvel) AS t FROM g) SELECT gds_ctgry_3_lvel, min(x) AS weighted_median FROM c WHERE 2 * u >= t GROUP BY 1")

# serving

add("sv_top_books", lambda s, d: serving.top_books(T.predictions(s, d)).select("model_id", "site_no", "item_id", "pred_qty_int", "rank"),
    f"WITH {T.PRE} SELECT model_id, site_no, item_id, pred_qty_int, row_number() OVER (PARTITION BY model_id ORDER BY pred_qty_int DESC, pred_qty_raw DESC, site_no, item_id) AS rank FROM pre QUALIFY rank <= 100")
add("sv_store_summary", lambda s, d: serving.store_summary(T.predictions(s, d)), f"WITH {T.PRE} SELECT model_id, site_no, CAST(sum(pred_qty_int) AS BIGINT) AS total_qty, count(*) FILTER (WHERE pred_qty_int > 0) AS nonzero_count, count(*) FILTER (WHERE pred_qty_int >= 20) AS head_count FROM pre GROUP BY 1, 2")
add("sv_model_summary", lambda s, d: serving.model_summary(T.predictions(s, d)),
    f"WITH {T.PRE} SELECT model_id, CAST(sum(pred_qty_int) AS BIGINT) AS total_qty, count(*) FILTER (WHERE pred_qty_int > 0) AS nonzero_count, {', '.join(f'count(*) FILTER (WHERE pred_mc = {c}) AS mc{c}_count' for c in range(5))}, count(*) FILTER (WHERE pred_qty_int >= 20) AS head_count, count(DISTINCT site_no) AS stores, count(DISTINCT item_id) AS items, count(*) AS n_rows FROM pre GROUP BY 1")
add("sv_results", lambda s, d: serving.page(T.predictions(s, d), F.col("pred_mc") >= 2, number=2).select("model_id", "site_no", "item_id", "pred_qty_int"),
    f"WITH {T.PRE} SELECT model_id, site_no, item_id, pred_qty_int FROM pre WHERE pred_mc >= 2 ORDER BY pred_qty_int DESC, site_no, item_id, model_id LIMIT 50 OFFSET 50")
add("sv_store_detail", lambda s, d: serving.store_detail(T.predictions(s, d), "1"),
    f"WITH {T.PRE} SELECT model_id, CAST(sum(pred_qty_int) AS BIGINT) AS total_qty, count(*) FILTER (WHERE pred_qty_int > 0) AS nonzero_count, count(*) FILTER (WHERE pred_mc = 3) AS mc3_count, count(*) FILTER (WHERE pred_mc = 4) AS mc4_count, count(*) AS n_rows FROM pre WHERE site_no = '1' GROUP BY 1")
add("sv_history_series", lambda s, d: serving.history_series(T.months(s, d), T.predictions(s, d), "2001-10"),
    f"WITH {T.PRE} SELECT site_no, month, sum(total_qty) AS qty, 'actual' AS kind FROM mon GROUP BY 1, 2 UNION ALL SELECT site_no, '2001-10', CAST(sum(pred_qty_int) AS DOUBLE), model_id FROM pre GROUP BY 1, 4")
_DIF = "df AS (SELECT *, abs(p - t) AS e, abs(p - t) / greatest(abs(t), 1) AS st, CASE WHEN abs(p - t) >= 10 OR abs(p - t) / greatest(abs(t), 1) >= 1 THEN 'hard' WHEN abs(p - t) >= 5 OR abs(p - t) / greatest(abs(t), 1) >= 0.5 THEN 'medium' ELSE 'easy' END AS difficulty FROM lo)"
add("sv_difficult", lambda s, d: serving.difficult(_judged(s, d).where("split = 'test' AND candidate = 'hist'")).where("difficulty <> 'easy'").select("month", "site_no", "item_id", "difficulty", S.r6(F.col("abs_error")).alias("abs_error"), S.r6(F.col("stable_error")).alias("stable_error")),
    f"WITH {LONG}, {_DIF} SELECT month, site_no, item_id, difficulty, round(e, 6) AS abs_error, round(st, 6) AS stable_error FROM df WHERE split = 'test' AND candidate = 'hist' AND difficulty <> 'easy'")
add("sv_difficult_summary", lambda s, d: serving.difficult_summary(_judged(s, d), ["split", "candidate"]),
    f"WITH {LONG}, {_DIF} SELECT split, candidate, count(*) FILTER (WHERE difficulty <> 'easy') AS difficult_count, round(count(*) FILTER (WHERE difficulty <> 'easy') / count(*), 6) AS difficult_ratio, count(DISTINCT site_no) FILTER (WHERE difficulty <> 'easy') AS stores, round(avg(e) FILTER (WHERE difficulty <> 'easy'), 6) AS mean_error, count(*) FILTER (WHERE difficulty = 'hard') AS hard_count FROM df GROUP BY 1, 2")

# joins, unions, encodings, scalars


@query("jn_left_lookup", f"WITH {T.MON}, si AS (SELECT month_idx, item_id, count(*) FILTER (WHERE total_qty > 0) AS gs FROM mon GROUP BY 1, 2 HAVING count(*) > 2) SELECT month, site_no, mon.item_id, coalesce(gs, 0) AS group_sites FROM mon LEFT JOIN si USING (month_idx, item_id)")
def jn_left_lookup(s: SparkSession, d: str) -> DataFrame:
    m = T.months(s, d)
    side = m.groupBy("month_idx", "item_id").agg(F.count_if(F.col("total_qty") > 0).alias("group_sites"), F.count(F.lit(1)).alias("n")).where("n > 2").drop("n")
    return m.select("month_idx", "month", "site_no", "item_id").join(side, ["month_idx", "item_id"], "left").select("month", "site_no", "item_id", F.coalesce("group_sites", F.lit(0)).alias("group_sites"))


@query("src_history_union", f"WITH {T.MON}, u AS (SELECT month, site_no, item_id, total_qty, 'first' AS source_dataset_id, 1 AS o FROM mon WHERE month <= '1999-12' UNION ALL SELECT month, site_no, item_id, total_qty * 2, 'second', 2 FROM mon WHERE month >= '1999-01') SELECT * EXCLUDE (o) FROM u QUALIFY row_number() OVER (PARTITION BY month, site_no, item_id ORDER BY o DESC) = 1")
def src_history_union(s: SparkSession, d: str) -> DataFrame:
    m = T.months(s, d).select("month", "site_no", "item_id", "total_qty")
    return sources.history_union([("first", m.where("month <= '1999-12'")), ("second", m.where("month >= '1999-01'").withColumn("total_qty", F.col("total_qty") * 2))], ["month", "site_no", "item_id"])


@query("src_to_ledger", "SELECT CAST(l_suppkey AS VARCHAR) AS site_no, count(*) AS n, round(sum(l_quantity), 6) AS qty, round(sum(l_extendedprice), 4) AS tlp FROM lineitem GROUP BY 1")
def src_to_ledger(s: SparkSession, d: str) -> DataFrame:
    """Other headers brought to the ledger's names through aliases."""
    raw = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_shipdate").alias('﻿"销售日期"'), F.col("l_suppkey").alias("门店编码"), F.col("l_partkey").alias("ISBN\t"), F.col("l_quantity").alias("数量"), F.col("l_extendedprice").alias("实洋"))
    named = sources.normalised(raw)
    rows = sources.to_ledger(named, sources.field_mapping(named.columns))
    return rows.groupBy("site_no").agg(F.count(F.lit(1)).alias("n"), S.r6(F.sum(F.col("qty").cast("double"))).alias("qty"), F.round(F.sum(F.col("tlp").cast("double")), 4).alias("tlp"))


_CODES = "cm AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT gds_ctgry_3_lvel AS value FROM fc WHERE month <= '1995-03'))"
def _early() -> Column:
    return F.col("month") <= "1995-03"



@query("pp_category", f"WITH {T.FOR}, {_CODES} SELECT month, site_no, item_id, coalesce(code, -1) AS gds_ctgry_3_lvel_code FROM fc LEFT JOIN cm ON value = gds_ctgry_3_lvel")
def pp_category(s: SparkSession, d: str) -> DataFrame:
    rows = T.forecasts(s, d).select("month", "site_no", "item_id", "gds_ctgry_3_lvel")
    codes = encoding.category_map(rows, _early(), ["gds_ctgry_3_lvel"])
    return encoding.apply_map(rows, codes, ["gds_ctgry_3_lvel"]).drop("gds_ctgry_3_lvel")


@query("pp_fold_seen", f"WITH {T.FOR}, {_FOLD_SQL}, se AS (SELECT DISTINCT fold, item_id FROM fo WHERE kind = 'train') SELECT fold, kind, count(*) AS n, count(*) FILTER (WHERE se.item_id IS NULL) AS n_unseen FROM fo LEFT JOIN se USING (fold, item_id) GROUP BY 1, 2")
def pp_fold_seen(s: SparkSession, d: str) -> DataFrame:
    rows = encoding.fold_seen(sampling.time_folds(T.forecasts(s, d), _FOLDS), "item_id")
    return rows.groupBy("fold", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("item_id_fold") == "-1").alias("n_unseen"))


add("pp_scale", lambda s, d: encoding.scaled(T.forecasts(s, d), F.col("split") == "train", ["current", "qty_lag_1m"]).select("month", "site_no", "item_id", *[F.round(f"{c}_scaled", 5).alias(f"{c}_scaled") for c in ("current", "qty_lag_1m")]),
    f"WITH {T.FOR.replace('fc AS (', 'fc AS MATERIALIZED (')}, st AS MATERIALIZED (SELECT avg(current) AS a, stddev_pop(current) AS b, avg(qty_lag_1m) AS c, stddev_pop(qty_lag_1m) AS e FROM fc WHERE split = 'train') SELECT month, site_no, item_id, round((current - a) / b, 5) AS current_scaled, round((qty_lag_1m - c) / e, 5) AS qty_lag_1m_scaled FROM fc, st")
_PAT = "CASE WHEN least(qty_lag_1m, qty_lag_2m, qty_lag_3m) >= 5 THEN 'persistent_high' WHEN (qty_lag_1m + qty_lag_2m + qty_lag_3m) / 3 <= 1 THEN 'sudden_burst_from_low' WHEN greatest(qty_lag_1m, qty_lag_2m, qty_lag_3m) - least(qty_lag_1m, qty_lag_2m, qty_lag_3m) >= 5 THEN 'volatile' ELSE 'other' END"
add("fn_history_pattern", lambda s, d: T.forecasts(s, d).groupBy(S.history_pattern(F.col("qty_lag_1m"), F.col("qty_lag_2m"), F.col("qty_lag_3m")).alias("pattern")).agg(F.count(F.lit(1)).alias("n")), f"WITH {T.FOR} SELECT {_PAT} AS pattern, count(*) AS n FROM fc GROUP BY 1")
add("fn_scalars", lambda s, d: T.months(s, d).select("month", "site_no", "item_id", S.demand_bucket(F.col("total_qty")).alias("bucket"), S.longtail_bucket(F.col("total_qty")).alias("longtail"), S.half_up(F.col("total_qty"), 2).alias("half_2m"), S.level(F.col("total_qty")).alias("level_1m"), S.level(F.col("total_qty"), 2).alias("level_2m"), S.month_text(F.col("month_idx") + 2).alias("two_later")),
    f"WITH {T.MON} SELECT month, site_no, item_id, CASE WHEN total_qty <= 0 THEN '0' WHEN total_qty < 2 THEN '1' WHEN total_qty < 5 THEN '2-5' WHEN total_qty < 20 THEN '5-20' ELSE '20+' END AS bucket, {_LT} AS longtail, CAST(floor(greatest(total_qty / 2, 0) + 0.5) AS BIGINT) AS half_2m, {T.level_sql('total_qty')} AS level_1m, {T.level_sql('total_qty', 2)} AS level_2m, printf('%04d-%02d', (month_idx + 2) // 12, (month_idx + 2) % 12 + 1) AS two_later FROM mon")
add("dq_compare_summary", lambda s, d: checks.compare_metrics(*[checks.long_metrics(metrics.quantity(_judged(s, d).where(F.col("candidate") == c), ["split"]), ["split"], ["mae", "wape", "target_sum"]) for c in ("hist", "wma")], ["split"]).select("split", "metric", "verdict"),
    f"WITH {LONG}, q AS (SELECT split, candidate, {_METRIC} FROM lo GROUP BY 1, 2), l AS (SELECT split, candidate, unnest(['mae', 'wape', 'target_sum']) AS metric, unnest([mae, wape, target_sum]) AS v FROM q) SELECT a.split, a.metric, CASE WHEN abs(a.v - b.v) <= 1e-9 THEN 'same' WHEN abs(a.v - b.v) <= 1e-3 THEN 'equivalent' ELSE 'different' END AS verdict FROM l a JOIN l b ON a.split = b.split AND a.metric = b.metric AND a.candidate = 'hist' AND b.candidate = 'wma'")

# learned forecasts: no SQL can train them


def _model_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from shelfcast.operators import models

    # a fit reads its rows many times: to count, to find splits, and to cache them
    rows = models.assembled(staged(T.forecasts(s, d).select("split", "target", "hist", *models.FEATURES), "model"))
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _model_cells(s: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of equal target and features as one, with their number in ``rows``: neither trees nor metrics can tell them apart. They are counted where they are made and never written one by one."""
    from shelfcast.operators import models

    columns = ["split", "target", *more, *models.FEATURES]
    cells = staged(T.forecasts(s, d).where("split <> 'valid'").groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")), "model")
    return cells.where("split = 'train'"), cells.where("split = 'test'")


@query("ml_two_stage")
def ml_two_stage(s: SparkSession, d: str) -> DataFrame:
    from shelfcast.operators import models

    found = models.two_stage(*_model_rows(s, d))
    return metrics.quantity(metrics.cleaned(found, "target", "prediction"), ["split"])


@query("ml_tree_reg")
def ml_tree_reg(s: SparkSession, d: str) -> DataFrame:
    from shelfcast.operators import models

    train, test = _model_cells(s, d)
    kinds = [models.tree_regression(train, test, kind, weight="rows").select("target", "prediction", "rows", F.lit(kind).alias("kind")) for kind in ("boosted", "forest")]
    found = metrics.quantity(metrics.cleaned(checks.union_all(kinds), "target", "prediction"), ["kind"], F.col("rows"), [F.sum("rows").alias("rows")])
    return found.withColumn("count", F.col("rows")).drop("rows")


@query("ml_head_classifiers")
def ml_head_classifiers(s: SparkSession, d: str) -> DataFrame:
    from shelfcast.operators import models

    train, test = _model_rows(s, d)
    parts = [metrics.binary_rank(models.head_classifier(train, test, least), "score", F.col("target") >= least, ["split"]).withColumn("least", F.lit(least)) for least in (5, 20)]
    return checks.union_all(parts)


@query("ml_mc_direct")
def ml_mc_direct(s: SparkSession, d: str) -> DataFrame:
    from shelfcast.operators import models

    found, n = models.direct_level(*_model_cells(s, d, "hist"), weight="rows"), F.col("rows")
    return models.level_logloss(found, ["split"], n).join(metrics.disagreement(found, S.level(F.col("hist")), F.col("direct"), ["split"], n), "split")
