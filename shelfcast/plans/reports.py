"""Queries of whole reports, and of checks on rows that violate them, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import audit, checks, cleaning, forecast, metrics, panel, reports, selection
from shelfcast.plans import evaluation, queries
from shelfcast.plans import tables as T
from shelfcast.sources import ledger as sources
from shelfcast.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MATRIX = ["split", "candidate", "horizon"]


def add(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = function, sql


# levels over one and two months

_LK = f"""{evaluation.HZ}, lk AS (SELECT split, candidate, CASE horizon WHEN 1 THEN '1m' ELSE '2m_cumulative' END AS horizon, {T.level_sql('t')} AS a, {T.level_sql('p')} AS b FROM hz UNION ALL SELECT split, candidate, '2m_average', {T.level_sql('t', 2)}, {T.level_sql('p', 2)} FROM hz WHERE horizon = 2),
pe AS (SELECT split, candidate, horizon, CAST(x.l AS INTEGER) AS level, count(*) FILTER (WHERE a = l) AS support, count(*) FILTER (WHERE b = l) AS predicted, count(*) FILTER (WHERE a = l AND b = l) AS hits FROM lk, range(5) x(l) GROUP BY 1, 2, 3, 4)"""
_SHARE = lambda a, b: f"round(count(*) FILTER (WHERE {a}) / nullif(count(*) FILTER (WHERE {b}), 0), 6)"
_ZERO = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0), 6)"
add("mt_level_details", lambda s, d: reports.level_details(reports.level_cells(evaluation.monthly(s, d), ["split"], ["hist", "wma"]), MATRIX),
    f"WITH {_LK} SELECT split, candidate, horizon, level, support, predicted, {_ZERO('hits', 'predicted')} AS precision, {_ZERO('hits', 'support')} AS recall, {_ZERO('2 * hits', '(support + predicted)')} AS f1 FROM pe")
add("mt_levels", lambda s, d: reports.level_summary(reports.level_cells(evaluation.monthly(s, d), ["split"], ["hist", "wma"]), MATRIX),
    f"""WITH {_LK}, ff AS (SELECT split, candidate, horizon, round(sum(f) / 5, 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM (SELECT *, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f FROM pe) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT split, candidate, horizon, count(*) AS count, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS accuracy, {_SHARE('a >= 1 AND b >= 1', 'a >= 1')} AS active_recall, {_SHARE('a >= 3 AND b >= 3', 'a >= 3')} AS medium_high_or_high_recall, {_SHARE('a = 4 AND b = 4', 'a = 4')} AS high_recall, {_SHARE('a >= 3 AND b <= 1', 'a >= 3')} AS severe_under_rate, {_SHARE('a <= 1 AND b >= 3', 'a <= 1')} AS severe_over_rate FROM lk GROUP BY 1, 2, 3) JOIN ff USING (split, candidate, horizon)""")  # fmt: skip


# two models on the rows that both have


def mt_fair(s: SparkSession, d: str) -> DataFrame:
    """Two tables of predictions, each with its own target, on the rows that both have, by segment."""
    rows, key = T.forecasts(s, d), ["month", "site_no", "item_id"]
    a, b = rows.where("hist > 0").select(*key, "split", "target", "hist"), rows.where("wma > 1").select(*key, F.col("target").alias("other"), "wma")
    long = metrics.candidates(a.join(b, key).withColumn("target_gap", F.abs(F.col("target") - F.col("other"))), ["hist", "wma"])
    return reports.fair(metrics.segmented(long, reports.fair_segments()), ["split", "candidate"])


add("mt_fair", mt_fair, f"""WITH {T.FOR}, j AS (SELECT a.split, a.target AS t, a.hist, b.wma, abs(a.target - b.target) AS gap FROM (SELECT * FROM fc WHERE hist > 0) a JOIN (SELECT * FROM fc WHERE wma > 1) b USING (month, site_no, item_id)),
lo AS (SELECT split, 'hist' AS candidate, t, hist AS p, gap FROM j UNION ALL SELECT split, 'wma', t, wma, gap FROM j), sg AS (SELECT *, unnest(list_filter(['overall', CASE WHEN t <= 0 THEN 'zero' ELSE 'nonzero' END, CASE WHEN t >= 5 AND t < 20 THEN '5-20' END, CASE WHEN t >= 20 THEN '20+' END], lambda x: x IS NOT NULL)) AS segment FROM lo),
su AS (SELECT split, candidate, segment, count(*) AS count, round(sum(abs(t - p)), 6) AS ae, round(sum((t - p) * (t - p)), 6) AS se, round(CAST(sum(t) AS DOUBLE), 6) AS target_sum, round(sum(p), 6) AS prediction_sum, CAST(max(gap) AS DOUBLE) AS max_target_difference FROM sg GROUP BY 1, 2, 3)
SELECT split, candidate, segment, count, round(ae / count, 6) AS mae, round(sqrt(se / count), 6) AS rmse, CASE WHEN target_sum > 0 THEN round(100 * (ae / target_sum), 6) END AS wape, target_sum, prediction_sum, CASE WHEN target_sum > 0 THEN round(100 * ((prediction_sum - target_sum) / target_sum), 6) END AS total_bias, CASE WHEN segment = 'zero' THEN prediction_sum END AS zero_pred_total, max_target_difference FROM su""")


# the dataset and its history

add("dq_month_coverage", lambda s, d: reports.month_coverage(queries.src_history_union(s, d)),
    f"WITH u AS ({queries.ORACLES['src_history_union']}) SELECT month, substr(month, 1, 4) AS year, 'READY' AS status, count(DISTINCT site_no) AS stores, count(DISTINCT item_id) AS items, count(*) AS n_rows, string_agg(DISTINCT source_dataset_id, ',' ORDER BY source_dataset_id) AS source_dataset_ids FROM u GROUP BY 1")
CONTRACTS = [["qty_lag_1m", "qty_sum_last_3m", "cal_month"], ["qty_lag_6m", "active_months_last_6m", "qty_lag_1m"], ["active_months_last_6m", "online_ratio_last_6m"]]
add("dq_history_ready", lambda s, d: reports.readiness(T.months(s, d), "2001-12", CONTRACTS),
    f"""WITH {T.MON}, rq AS (SELECT i, printf('%04d-%02d', i // 12, i % 12 + 1) AS m FROM range({2001 * 12 + 4}, {2001 * 12 + 11}) r(i)), sc AS (SELECT DISTINCT site_no AS scope, month FROM mon UNION SELECT 'all', month FROM mon),
mi AS (SELECT scope, string_agg(m, ',' ORDER BY m) AS missing_months, count(*) AS n_missing FROM (SELECT a.scope, rq.m FROM (SELECT DISTINCT scope FROM sc) a CROSS JOIN rq WHERE NOT EXISTS (SELECT 1 FROM sc z WHERE z.scope = a.scope AND z.month = rq.m)) GROUP BY 1)
SELECT scope, CASE WHEN n_missing > 0 THEN 'DataNotReady' ELSE 'READY' END AS status, (SELECT max(m) FROM rq) AS observation_month, (SELECT string_agg(m, ',' ORDER BY m) FROM rq) AS required_months, coalesce(missing_months, '') AS missing_months, coalesce(n_missing, 0) AS n_missing,
  CASE WHEN n_missing > 0 THEN 'qty_lag_6m,active_months_last_6m,online_ratio_last_6m' ELSE '' END AS affected_features FROM (SELECT DISTINCT scope FROM sc) LEFT JOIN mi USING (scope)""")  # fmt: skip
_B = "CASE WHEN total_qty <= 0 THEN '0' WHEN total_qty < 2 THEN '1' WHEN total_qty < 5 THEN '2-5' WHEN total_qty < 20 THEN '5-20' ELSE '20+' END"
_SECTIONS = {"split": "split", "total_qty_bucket": _B, "future_has_sales_1m": "CAST(future_has_sales_1m AS VARCHAR)", "future_has_sales_2m": "CAST(future_has_sales_2m AS VARCHAR)"}
_STATS = lambda c: [("count", "count(*)"), ("mean", f"sum({c}) / count(*)"), ("std", f"sqrt((sum({c} * {c}) - CAST(sum({c}) AS DOUBLE) * sum({c}) / count(*)) / (count(*) - 1))"), ("min", f"min({c})"), ("max", f"max({c})")]
add("dq_dataset_report", lambda s, d: reports.dataset_report(T.dataset(s, d), T.months(s, d)), f"""WITH {T.HIS}, dm AS MATERIALIZED (SELECT split, month, total_qty, CAST(future_qty_1m AS DOUBLE) AS future_qty_1m, CAST(future_qty_2m AS DOUBLE) AS future_qty_2m, future_has_sales_1m, future_has_sales_2m FROM ds), f AS (SELECT count(*) AS n, min(month_idx) AS f FROM mon GROUP BY site_no, item_id)
SELECT 'overview' AS section, 'input_rows' AS key, CAST(sum(n) AS DOUBLE) AS value, NULL::DOUBLE AS ratio FROM f UNION ALL SELECT 'overview', 'panel_rows', CAST(sum((SELECT max(month_idx) FROM mon) - f + 1) AS DOUBLE), NULL FROM f UNION ALL SELECT 'overview', 'final_rows', count(*), NULL FROM dm
UNION ALL SELECT 'overview', 'first_month', CAST(replace(min(month), '-', '') AS DOUBLE), NULL FROM dm UNION ALL SELECT 'overview', 'last_month', CAST(replace(max(month), '-', '') AS DOUBLE), NULL FROM dm
{' '.join(f"UNION ALL SELECT '{c}', '{k}', round(CAST({x} AS DOUBLE), 6), NULL FROM dm" for c in ('future_qty_1m', 'future_qty_2m') for k, x in _STATS(c))}
{' '.join(f"UNION ALL SELECT '{n}', {k}, count(*), round(count(*) / (SELECT count(*) FROM dm), 6) FROM dm GROUP BY 2" for n, k in _SECTIONS.items())}""")


# levels and errors that move from one model to the other

_HL, _WL = T.level_sql("hist"), T.level_sql("wma")
add("mt_migration_levels", lambda s, d: reports.level_moves(T.forecasts(s, d), ["split"], S.level(F.col("hist")), S.level(F.col("wma"))),
    f"WITH {T.FOR}, x AS (SELECT split, {_HL} AS a, {_WL} AS b FROM fc WHERE target >= 5 AND target < 20), c AS (SELECT split, CAST(l AS INTEGER) AS level, count(*) FILTER (WHERE a = l) AS first_count, count(*) FILTER (WHERE b = l) AS second_count, count(*) AS n FROM x, range(5) r(l) GROUP BY 1, 2) SELECT split, level, first_count, round(first_count / n, 6) AS first_share, second_count, round(second_count / n, 6) AS second_share, second_count - first_count AS count_change FROM c")
_LOST = lambda n, c: f"round(round(sum({c}), 6) / count(*), 6) AS {n}_mean, round(quantile_cont({c}, 0.5), 6) AS {n}_median, round(round(sum(abs({c} - target)), 6) / count(*), 6) AS {n}_mae, round(100 * (round(sum(abs({c} - target)), 6) / sum(target)), 6) AS {n}_wape"
add("mt_migration_errors", lambda s, d: reports.lost_levels(T.forecasts(s, d), ["split"], "hist", "wma"),
    f"WITH {T.FOR}, x AS (SELECT *, CASE WHEN {_WL} = 4 THEN 'to_20_plus' WHEN {_WL} = 2 THEN 'to_2_4' WHEN {_WL} <= 1 THEN 'to_1_or_0' END AS kind FROM fc WHERE target >= 5 AND target < 20 AND {_HL} = 3) SELECT split, kind, count(*) AS count, round(sum(target) / count(*), 6) AS target_mean, round(CAST(quantile_cont(target, 0.5) AS DOUBLE), 6) AS target_median, {_LOST('first', 'hist')}, {_LOST('second', 'wma')} FROM x WHERE kind IS NOT NULL GROUP BY 1, 2")
_COLUMNS = {"site_no": 10, "gds_ctgry_3_lvel": 10, "history_level": 1, "short_history": 1, "xstore_heat": 1}


def mt_concentration(s: SparkSession, d: str) -> DataFrame:
    """Where the weighted average is materially worse than the mean on high demand: by store, category, kind of history and heat of the item in other stores (bands of the training rows)."""
    level = F.when(F.col("current") <= 0, "0").when(F.col("current") < 5, "1-4").when(F.col("current") < 20, "5-19").otherwise("20+")
    rows = panel.cross_features(T.dataset(s, d), cleaning.cross_store(T.months(s, d))).withColumns({"target": S.clip_target(F.col("future_qty_1m")), "current": F.col("total_qty"), "hist": forecast.historical_mean(), "wma": forecast.weighted_average()})
    heads = staged(rows.where("target >= 20").select("split", "site_no", "gds_ctgry_3_lvel", "target", "hist", "wma", "xstore_qty_current", level.alias("history_level"), F.when(F.col("active_months_last_6m") < 3, "lt3_active_months").otherwise("3plus_active_months").alias("short_history")), "heads")
    return audit.worse_groups(reports.banded(heads, heads.where("split = 'train'"), "xstore_qty_current", "xstore_heat"), _COLUMNS, "hist", "wma")


add("mt_concentration", mt_concentration, f"""WITH {T.FOR}, side AS (SELECT month_idx, item_id, sum(greatest(total_qty, 0)) AS gq FROM mon GROUP BY 1, 2),
x AS MATERIALIZED (SELECT fc.*, greatest(coalesce(gq, 0) - greatest(current, 0), 0) AS xq FROM fc LEFT JOIN side USING (month_idx, item_id) WHERE target >= 20), cu AS (SELECT quantile_cont(xq, 0.5) AS a, quantile_cont(xq, 0.75) AS b, quantile_cont(xq, 0.9) AS c FROM x WHERE split = 'train'),
h AS MATERIALIZED (SELECT *, CASE WHEN current <= 0 THEN '0' WHEN current < 5 THEN '1-4' WHEN current < 20 THEN '5-19' ELSE '20+' END AS history_level, CASE WHEN active_months_last_6m < 3 THEN 'lt3_active_months' ELSE '3plus_active_months' END AS short_history, CASE WHEN xq >= c THEN 'very_high' WHEN xq >= b THEN 'high' WHEN xq >= a THEN 'mid' ELSE 'low' END AS xstore_heat,
  abs(wma - target) - abs(hist - target) > greatest(2.0, 0.1::DOUBLE * target) AS worse FROM x, cu),
g AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, trim({c}) AS value, {least} AS least, count(*) AS all_count, count(*) FILTER (WHERE worse) AS worse_count FROM h GROUP BY 2" for c, least in _COLUMNS.items())}),
f AS (SELECT *, sum(all_count) OVER (PARTITION BY col) AS n, sum(worse_count) OVER (PARTITION BY col) AS nw FROM g),
k AS (SELECT col AS column, value, worse_count, all_count, round(worse_count / nw, 6) AS worse_share, round(all_count / n, 6) AS all_share, round((worse_count / nw) / (all_count / n), 6) AS concentration_ratio FROM f WHERE worse_count >= least AND worse_count > 0)
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY concentration_ratio DESC, worse_count DESC, value) AS rank FROM k QUALIFY rank <= 10""")


# checks on rows that violate them


def agg_closure_validate_violated(s: SparkSession, d: str) -> DataFrame:
    """Closures against a configuration that has every third store a month late, leaves out every fifth and names every seventh twice."""
    found = cleaning.closures(T.activity(s, d))
    n = F.col("site_no").cast("long")
    late = found.where(n % 5 != 0).withColumn("closure_idx", F.col("closure_idx") + F.when(n % 3 == 0, 1).otherwise(0))
    return cleaning.closure_differences(late.unionByName(late.where(n % 7 == 0)), found)


add("agg_closure_validate_violated", agg_closure_validate_violated, f"""WITH {T.ACT}, fo AS (SELECT site_no, CAST(site_no AS BIGINT) AS k, CAST(last_idx + 1 AS INTEGER) AS c FROM act WHERE last_idx < (SELECT max(last_idx) FROM act)), cf AS (SELECT site_no, k, c + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS c FROM fo WHERE k % 5 <> 0)
SELECT site_no, CAST(c AS INTEGER) AS closure_idx, 'not found' AS problem FROM cf WHERE k % 3 = 0 UNION ALL SELECT site_no, c, 'not found' FROM cf WHERE k % 7 = 0 UNION ALL SELECT site_no, c, 'not configured' FROM fo WHERE k % 5 = 0 OR k % 3 = 0 UNION ALL SELECT site_no, NULL, 'configured twice' FROM cf WHERE k % 7 = 0""")


def dq_validate_horizon_violated(s: SparkSession, d: str) -> DataFrame:
    """The contract of the horizons on rows spoilt by store: horizons withdrawn, levels moved, months put after the close."""
    n = F.col("site_no").cast("long")
    spoilt = T.active(s, d).withColumns({
        "target_available_1m": F.when(n % 4 == 0, 0).otherwise(F.col("target_available_1m")), "target_mc_1m": F.when(n % 4 == 1, 4 - F.col("target_mc_1m")).otherwise(F.col("target_mc_1m")),
        "target_mc_2m": F.when(n % 4 == 2, F.col("target_mc_2m") + 1).otherwise(F.col("target_mc_2m")), "month_idx": F.col("month_idx") + F.when(n % 4 == 3, 6).otherwise(0),
    })
    return checks.horizon_violations(spoilt)


_L1, _L2 = T.level_sql("future_qty_1m"), T.level_sql("future_qty_2m", 2)
add("dq_validate_horizon_violated", dq_validate_horizon_violated, f"""WITH {T.ADS}, sp AS (SELECT month_idx + CASE WHEN k = 3 THEN 6 ELSE 0 END AS month_idx, last_idx, future_qty_1m, future_qty_2m, CASE WHEN k = 0 THEN 0 ELSE target_available_1m END AS a1, target_available_2m AS a2, CASE WHEN k = 1 THEN 4 - target_mc_1m ELSE target_mc_1m END AS m1, CASE WHEN k = 2 THEN target_mc_2m + 1 ELSE target_mc_2m END AS m2 FROM (SELECT *, CAST(site_no AS BIGINT) % 4 AS k FROM ads))
SELECT count(*) FILTER (WHERE a2 = 1 AND a1 <> 1) AS second_without_first, count(*) FILTER (WHERE m2 NOT IN (-1, 0, 1, 2, 3, 4)) AS unknown_level, count(*) FILTER (WHERE a1 = 1 AND m1 <> {_L1}) AS wrong_level_1m, count(*) FILTER (WHERE a2 = 1 AND m2 <> {_L2}) AS wrong_level_2m, count(*) FILTER (WHERE a2 = 0 AND m2 <> -1) AS level_without_target, count(*) FILTER (WHERE month_idx + 1 > last_idx) AS after_close FROM sp""")


def cl_return_flag(s: SparkSession, d: str) -> DataFrame:
    """Return marks of all kinds, dealt by day: normal ones in several spellings, none, and two that mean a return."""
    marks = F.array(*[F.lit(m) for m in _MARKS])
    marked = T.ledger(s, d).withColumn("rtn_flag", F.element_at(marks, (F.dayofmonth("period") % len(_MARKS) + 1).cast("int")))
    lines = cleaning.clean(marked).withColumn("mark", F.coalesce(F.element_at(marks, (F.dayofmonth("period") % len(_MARKS) + 1).cast("int")), F.lit("null")))
    return lines.groupBy("mark", "is_return").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum("return_qty_component").alias("return_qty"))


_MARKS = [" N ", "Normal", "0", "", None, "R", "1"]
add("cl_return_flag", cl_return_flag, f"""WITH {T.LED}, m AS (SELECT coalesce([' N ', 'Normal', '0', '', NULL, 'R', '1'][CAST(day(period) % 7 + 1 AS INTEGER)], 'null') AS mark, qty FROM led), r AS (SELECT *, qty < 0 OR mark IN ('R', '1') AS is_return FROM m) SELECT mark, is_return, count(*) AS n, sum(qty) AS qty, sum(CASE WHEN is_return THEN abs(qty) ELSE 0 END) AS return_qty FROM r GROUP BY 1, 2""")
add("dq_history_ready_gaps", lambda s, d: reports.readiness(T.months(s, d).where("NOT (month = '2001-06' OR month = '2001-08' AND CAST(site_no AS BIGINT) % 3 = 0)"), "2001-12", CONTRACTS),
    ORACLES["dq_history_ready"].replace("FROM mon", "FROM (SELECT * FROM mon WHERE NOT (month = '2001-06' OR month = '2001-08' AND CAST(site_no AS BIGINT) % 3 = 0))"))
_MADE = {"hist": "hist", "kept": "0.9::DOUBLE * target", "even": "CASE WHEN target = 0 AND current >= 20 THEN 2 ELSE 0.9::DOUBLE * target END", "poor": "3 * target"}


def sel_business_guarded(s: SparkSession, d: str) -> DataFrame:
    """The guardrails on forecasts of which some keep them: beside the mean three are made of the target, to pass, to fail on zeros and to fail by MAE."""
    t, p = F.col("target"), F.col("prediction")
    made = T.forecasts(s, d).withColumns({"kept": 0.9 * t, "even": F.when((t == 0) & (F.col("current") >= 20), 2).otherwise(0.9 * t), "poor": 3 * t})
    rows, error = metrics.candidates(made, list(_MADE)), F.abs(p - t)
    total = lambda c, mask: S.r6(F.coalesce(F.sum(F.when(mask, c)), F.lit(0.0)))  # noqa: E731  before it is divided: last digits depend on the order of rows
    share = lambda mask: S.r6(100 * S.ratio(total(error, mask), total(t, mask)))
    every = F.lit(True)
    found = rows.groupBy("site_no", "candidate").agg(
        S.r6(F.coalesce(F.avg(F.when(t == 0, F.when(p > 1, 1.0).otherwise(0.0))), F.lit(0.0))).alias("zero_gt_1_rate"), S.r6(total(error, every) / F.count(F.lit(1))).alias("mae"), S.r6(100 * S.ratio(total(p, every) - total(t, every), total(t, every))).alias("total_bias_rate"),
        share(t > 0).alias("nonzero_wape"), share(t >= 20).alias("ge_20_wape"),
    )
    least = found.groupBy("site_no").agg(F.min("mae").alias("base_mae"))
    return selection.business(found.join(least, "site_no"), ["site_no"], ["candidate"]).select("site_no", "candidate", "zero_gt_1_rate", "mae", "reasons", "accepted", "rank")


_SUM = lambda x, c="true": f"round(coalesce(sum({x}) FILTER (WHERE {c}), 0), 6)"
_PART = lambda c: f"round(100 * ({_SUM('abs(p - t)', c)} / nullif({_SUM('t', c)}, 0)), 6)"
add("sel_business_guarded", sel_business_guarded, f"""WITH {T.FOR}, lo AS ({' UNION ALL '.join(f"SELECT site_no, '{n}' AS candidate, CAST(target AS DOUBLE) AS t, {x} AS p FROM fc" for n, x in _MADE.items())}),
z AS (SELECT site_no, candidate, round(coalesce(avg(CASE WHEN p > 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE t = 0), 0), 6) AS zero_gt_1_rate, round({_SUM('abs(p - t)')} / count(*), 6) AS mae, round(100 * (({_SUM('p')} - {_SUM('t')}) / nullif({_SUM('t')}, 0)), 6) AS total_bias_rate, {_PART('t > 0')} AS nonzero_wape, {_PART('t >= 20')} AS ge_20_wape FROM lo GROUP BY 1, 2),
b AS (SELECT *, concat_ws(',', CASE WHEN zero_gt_1_rate > 0 THEN 'zero_false_positives' END, CASE WHEN mae > base * 1.35 THEN 'mae' END) AS reasons FROM (SELECT *, min(mae) OVER (PARTITION BY site_no) AS base FROM z))
SELECT site_no, candidate, zero_gt_1_rate, mae, reasons, reasons = '' AS accepted, row_number() OVER (PARTITION BY site_no ORDER BY reasons = '' DESC, abs(total_bias_rate), nonzero_wape, ge_20_wape NULLS LAST, candidate) AS rank FROM b""")
