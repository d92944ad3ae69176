"""Queries of the wider evaluation, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import evaluation as E
from shelfcast.operators import forecast, metrics
from shelfcast.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAMES = ["hist", "wma", "two"]
TAUS = [round(0.1 * i, 1) for i in range(1, 10)]
FEATURES = ["current", "qty_lag_1m", "qty_sum_last_3m"]


def add(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = function, sql


def judged(s: SparkSession, d: str) -> DataFrame:
    """Rows of all formula forecasts (candidate, target, prediction), with their year as fold."""
    rows = metrics.cleaned(metrics.candidates(T.forecasts(s, d), NAMES), "target", "prediction")
    return rows.withColumn("fold", F.substring("month", 1, 4))


def monthly(s: SparkSession, d: str) -> DataFrame:
    """Rows with the targets of both horizons and two monthly forecasts."""
    return T.dataset(s, d).select("month", "site_no", "item_id", "split", F.col("total_qty").alias("current"), "future_qty_1m", "future_qty_2m", forecast.historical_mean().alias("hist"), forecast.weighted_average().alias("wma"))


def horizons(s: SparkSession, d: str) -> DataFrame:
    """The same over one and over two months: two-month targets against twice the monthly forecast."""
    rows = monthly(s, d)
    both = F.explode(F.array(F.struct(F.lit(1).alias("horizon"), F.col("future_qty_1m").cast("double").alias("target")), F.struct(F.lit(2).alias("horizon"), F.col("future_qty_2m").cast("double").alias("target"))))
    long = metrics.candidates(rows.withColumn("h", both).select("month", "site_no", "item_id", "split", "current", "hist", "wma", "h.horizon", "h.target"), ["hist", "wma"])
    return long.withColumn("target", S.clip_target(F.col("target"))).withColumn("prediction", S.clip_target(F.col("prediction")) * F.col("horizon"))


LO = f"{T.FOR},\nlo AS (" + " UNION ALL ".join(f"SELECT split, month, substr(month, 1, 4) AS fold, site_no, item_id, current, active_months_last_6m, '{n}' AS candidate, target AS t, {n} AS p FROM fc" for n in NAMES) + ")"
_WMA = "greatest(qty_lag_1m * 0.5::DOUBLE + qty_lag_2m * 0.3::DOUBLE + qty_lag_3m * 0.2::DOUBLE, 0)"
HZ = f"{T.HIS},\nhz AS (" + " UNION ALL ".join(f"SELECT month, site_no, item_id, split, total_qty AS current, {h} AS horizon, '{n}' AS candidate, greatest(future_qty_{h}m, 0) AS t, {h} * {p} AS p FROM ds" for h in (1, 2) for n, p in (("hist", "greatest(qty_mean_last_3m, 0)"), ("wma", _WMA))) + ")"


def complete_sql(source: str, by: list[str], w: str = "1") -> str:
    """A SELECT of the complete metrics over (t, p) of ``source``."""
    rules = {n: r.replace("target", "t") for n, r in E.COMPLETE.items()}
    part = lambda c, r: f"sum(CASE WHEN {r} THEN ({w}) * ({c}) ELSE 0 END)"
    of = lambda x: f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} = 1 THEN 1 WHEN {x} < 5 THEN 2 WHEN {x} < 20 THEN 3 ELSE 4 END"
    out = []
    for segment, r in rules.items():
        n, t = E.name_of(segment), part("t", r)
        out += [f"count(*) FILTER (WHERE {r}) AS count_{n}", f"round({t}, 3) AS target_sum_{n}", f"round({part('p', r)}, 3) AS prediction_sum_{n}"]
        out += [f"round(100 * {part('abs(p - t)', r)} / nullif({t}, 0), 6) AS wape_{n}", f"round(100 * {part('abs(whole - t)', r)} / nullif({t}, 0), 6) AS integer_wape_{n}"]
    f1 = " + ".join(f"coalesce(2 * {part('1', f'tc = {k} AND pc = {k}')} / nullif({part('1', f'tc = {k}')} + {part('1', f'pc = {k}')}, 0), 0)" for k in E.CODES)
    recall = lambda k: f"round(100 * coalesce({part('1', f'tc = {k} AND pc = {k}')} / nullif({part('1', f'tc = {k}')}, 0), 0), 6)"
    zero = lambda x: f"round(coalesce({part('1', f't <= 0 AND p > {x}')} / nullif({part('1', 't <= 0')}, 0), 0), 6)"
    out += [f"round(100 * (sum(({w}) * p) - sum(({w}) * t)) / nullif(sum(({w}) * t), 0), 6) AS total_bias", f"{zero(0.5)} AS zero_gt_0_5", f"{zero(1)} AS zero_gt_1", f"round(20 * ({f1}), 6) AS mc_macro_f1", f"{recall(3)} AS recall_5_19", f"{recall(4)} AS recall_20_plus"]
    keys = ", ".join(by)
    return f"SELECT {keys}, {', '.join(out)} FROM (SELECT *, {of('t')} AS tc, {of('whole')} AS pc FROM (SELECT *, floor(p + 0.5) AS whole FROM {source})) GROUP BY {keys}"


def weight() -> Column:
    return F.col("active_months_last_6m") + 1


add("mt_complete", lambda s, d: E.complete(judged(s, d), ["split", "candidate"]), f"WITH {LO} {complete_sql('lo', ['split', 'candidate'])}")
add("mt_weighted_complete", lambda s, d: E.complete(judged(s, d), ["split", "candidate"], weight()), f"WITH {LO} {complete_sql('lo', ['split', 'candidate'], 'active_months_last_6m + 1')}")
add("mt_weighted_component", lambda s, d: E.weighted_components(T.forecasts(s, d), ["split"], weight()),
    f"""WITH {T.FOR}, x AS (SELECT split, CAST(p AS DOUBLE) AS p, q, target AS t, active_months_last_6m + 1 AS w FROM fc),
b AS (SELECT split, floor(p * 1000) AS bin, sum(CASE WHEN t > 0 THEN w ELSE 0 END) AS pos, sum(w) AS a, sum(-w * CASE WHEN t > 0 THEN ln(greatest(p, 1e-15)) ELSE ln(1 - least(p, 1 - 1e-15)) END) AS loss FROM x GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY bin DESC) AS tp, sum(a) OVER (PARTITION BY split ORDER BY bin DESC) AS seen FROM b),
r AS (SELECT split, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision, round(sum((a - pos) * (tp - pos / 2)) / (sum(pos) * (sum(a) - sum(pos))), 6) AS roc_auc, round(sum(loss) / sum(a), 6) AS logloss, round(sum(pos) / sum(a), 6) AS positive_rate FROM c GROUP BY 1),
e AS (SELECT split, round(coalesce(sum(w) FILTER (WHERE t > 0 AND p >= 0.5), 0) / sum(w) FILTER (WHERE t > 0), 6) AS recall, round(sum(w * abs(q - t)) FILTER (WHERE t > 0) / sum(w) FILTER (WHERE t > 0), 6) AS positive_mae, round(100 * sum(w * abs(q - t)) FILTER (WHERE t > 0) / sum(w * t) FILTER (WHERE t > 0), 6) AS positive_wape FROM x GROUP BY 1)
SELECT * FROM r JOIN e USING (split)""")  # fmt: skip

_GATE_SEGMENTS = {"overall": "true", "zero": "t = 0", "nonzero": "t > 0", "qty_1": "t = 1", "qty_2_5": "t >= 2 AND t < 5", "5_20": "t >= 5 AND t < 20", "20plus": "t >= 20"}
_FIVE = ("overall", "zero", "nonzero", "5_20", "20plus")


def gates_sql(segments: tuple[str, ...], methods: tuple[str, ...]) -> str:
    named = ", ".join(f"CASE WHEN {_GATE_SEGMENTS[n]} THEN '{n}' END" for n in segments)
    gated = [f"SELECT '{m}' AS method, tau AS threshold, segment, t, p >= tau AS ok, CASE WHEN p >= tau THEN {'q' if m == 'gate_b' else 'p * q'} ELSE 0 END AS v FROM sx, th" for m in methods if m != "original"]
    gated += ["SELECT 'original', NULL, segment, t, true, p * q FROM sx"] if "original" in methods else []
    return f"""WITH {T.FOR}, x AS (SELECT CAST(p AS DOUBLE) AS p, q, target AS t FROM fc), sx AS (SELECT *, unnest(list_filter([{named}], lambda x: x IS NOT NULL)) AS segment FROM x), th AS (SELECT unnest({TAUS}::DOUBLE[]) AS tau), g AS ({' UNION ALL '.join(gated)})
SELECT method, threshold, segment, count(*) AS count, round(sum(abs(v - t)) / count(*), 6) AS mae, round(sqrt(sum((v - t) * (v - t)) / count(*)), 6) AS rmse, round(100 * sum(abs(v - t)) / nullif(sum(t), 0), 6) AS wape, round(sum(t), 3) AS target_sum, round(sum(v), 3) AS prediction_sum,
  round(100 * (sum(v) - sum(t)) / nullif(sum(t), 0), 6) AS total_bias, round(sum(v) / count(*), 6) AS mean_prediction, round(count(*) FILTER (WHERE v > 0.5) / count(*), 6) AS gt_0_5_rate, round(count(*) FILTER (WHERE v > 1) / count(*), 6) AS gt_1_rate, round(count(*) FILTER (WHERE ok) / count(*), 6) AS pass_rate FROM g GROUP BY 1, 2, 3"""


_ALL = ("original", "gate_a", "gate_b")
add("mt_gate_sweep_full", lambda s, d: E.gates(T.forecasts(s, d), TAUS, metrics.gate_segments(), _ALL), gates_sql(tuple(_GATE_SEGMENTS), _ALL))
add("mt_gate_tradeoff", lambda s, d: E.gates(T.forecasts(s, d), TAUS, {k: v for k, v in metrics.gate_segments().items() if k in _FIVE}, _ALL[:2]), gates_sql(_FIVE, _ALL[:2]))
add("mt_binary_full", lambda s, d: E.threshold_scores(T.forecasts(s, d), "p", F.col("target") > 0, ["split"], TAUS),
    f"""WITH {T.FOR}, g AS (SELECT split, tau AS threshold, count(*) FILTER (WHERE p >= tau AND target > 0) AS tp, count(*) FILTER (WHERE p >= tau) AS n, count(*) FILTER (WHERE target > 0) AS pos FROM (SELECT split, CAST(p AS DOUBLE) AS p, target FROM fc), (SELECT unnest({TAUS}::DOUBLE[]) AS tau) GROUP BY 1, 2)
SELECT split, threshold, round(tp / nullif(n, 0), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall, round(coalesce(2 * tp / nullif(n + pos, 0), 0), 6) AS f1, row_number() OVER (PARTITION BY split ORDER BY coalesce(2 * tp / nullif(n + pos, 0), 0) DESC, threshold) = 1 AS is_best FROM g""")  # fmt: skip
add("mt_signal_month", lambda s, d: E.signal_months(T.forecasts(s, d), FEATURES, F.col("target") >= 20, weight()),
    f"""WITH {T.FOR}, l AS ({' UNION ALL '.join(f"SELECT month, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, CASE WHEN target >= 20 THEN 1 ELSE 0 END AS y, active_months_last_6m + 1 AS w FROM fc" for f in FEATURES)}),
b AS (SELECT month, feature, v, sum(w * y) AS pos, sum(w) AS a FROM l GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER o AS tp, sum(a) OVER o AS seen, sum(a) OVER (PARTITION BY month, feature) AS total, sum(pos) OVER (PARTITION BY month, feature) AS hits FROM b WINDOW o AS (PARTITION BY month, feature ORDER BY v DESC)),
g AS (SELECT month, feature, sum(pos * tp / seen) AS ap, min(v) FILTER (WHERE seen - a < 0.1::DOUBLE * total) AS th, max(hits) AS hits, max(total) AS total, sum(pos) FILTER (WHERE seen - a < 0.1::DOUBLE * total) AS tp, sum(a) FILTER (WHERE seen - a < 0.1::DOUBLE * total) AS n FROM c GROUP BY 1, 2)
SELECT month, feature, round(ap / nullif(hits, 0), 6) AS average_precision, round(th, 6) AS top_decile_threshold, round(hits / total, 6) AS base_rate, round(coalesce(tp / n, 0), 6) AS top_decile_rate, round(coalesce(tp / n, 0) / nullif(hits / total, 0), 6) AS top_decile_lift FROM g""")  # fmt: skip
add("mt_error_summary", lambda s, d: E.error_summary(T.forecasts(s, d).where("target >= 20"), ["split"], "hist", "wma"),
    f"WITH {T.FOR} SELECT split, count(*) AS count, round(avg(target), 6) AS target_mean, round(quantile_cont(target, 0.5), 6) AS target_median, " + ", ".join(f"round(avg({c}), 6) AS {n}_mean, round(quantile_cont({c}, 0.5), 6) AS {n}_median, round(avg(abs({c} - target)), 6) AS {n}_mae, round(100 * sum(abs({c} - target)) / nullif(sum(target), 0), 6) AS {n}_wape" for n, c in (("first", "hist"), ("second", "wma"))) + " FROM fc WHERE target >= 20 GROUP BY 1")
_ZS = """st AS (SELECT horizon, candidate, avg(p) FILTER (WHERE t <= 0) AS m, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE t <= 0) AS h, 100 * (sum(p) - sum(t)) / nullif(sum(t), 0) AS b FROM hz WHERE split = 'valid' GROUP BY 1, 2),
bs AS (SELECT horizon, m AS base FROM st WHERE candidate = 'wma'),
rs AS (SELECT *, concat_ws(',', CASE WHEN m > greatest(0.1, 1.2::DOUBLE * base) + 1e-9 THEN 'zero_mean_prediction_high' END, CASE WHEN h > 0.05 THEN 'zero_false_positive_rate_high' END, CASE WHEN b > 20 THEN 'total_prediction_overestimated' END, CASE WHEN m > 1.2::DOUBLE * base + 1e-9 THEN 'zero_mae_worse_than_baseline' END) AS reasons FROM st JOIN bs USING (horizon))"""
add("mt_zero_sensitivity", lambda s, d: E.zero_sensitivity(horizons(s, d).where("split = 'valid'"), ["horizon"], "wma"),
    f"WITH {HZ}, {_ZS} SELECT horizon, candidate, round(m, 6) AS mean_prediction, round(h, 6) AS gt_0_5_rate, round(b, 6) AS total_bias, round(base, 6) AS baseline_zero_mae, reasons, reasons <> '' AS triggered FROM rs")
_TM, _PM = T.level_sql("(t / horizon)"), T.level_sql("(p / horizon)")
_SHARE = lambda a, b: f"round(count(*) FILTER (WHERE ({a}) AND {b}) / nullif(count(*) FILTER (WHERE {b}), 0), 6)"
add("mt_business_horizons", lambda s, d: E.business(horizons(s, d), ["split", "horizon", "candidate"], F.col("horizon")),
    f"""WITH {HZ}, lv AS (SELECT *, {_TM} AS a, {_PM} AS b FROM hz)
SELECT split, horizon, candidate, count(*) AS count, round(100 * sum(abs(p - t)) / nullif(sum(t), 0), 6) AS wape, {_SHARE('a = b', 'true')} AS accuracy, {_SHARE('b >= 1', 'a >= 1')} AS active_recall, {_SHARE('b >= 3', 'a >= 3')} AS medium_high_or_high_recall, {_SHARE('b = 4', 'a = 4')} AS high_recall,
  {_SHARE('b <= 1', 'a >= 3')} AS severe_under_rate, {_SHARE('b >= 3', 'a <= 1')} AS severe_over_rate, {_SHARE('sign(t / horizon - current) = sign(p / horizon - current)', 'true')} AS trend_accuracy FROM lv GROUP BY 1, 2, 3""")  # fmt: skip
_KS = (20, 50, 100)
_TOP = ", ".join(f"round(count(*) FILTER (WHERE r <= {k} AND t > 0) / nullif(count(*) FILTER (WHERE r <= {k}), 0), 6) AS precision_{k}, round(coalesce(sum(t) FILTER (WHERE r <= {k}), 0) / nullif(sum(t), 0), 6) AS sales_capture_{k}, round(count(*) FILTER (WHERE r <= {k} AND t >= 20) / nullif(count(*) FILTER (WHERE t >= 20), 0), 6) AS high_coverage_{k}" for k in _KS)
add("mt_topk_horizons", lambda s, d: metrics.top_k_horizons(T.dealt(s, d, monthly(s, d), "month", "site_no"), ["month", "site_no"], ["hist", "wma"], {1: "future_qty_1m", 2: "future_qty_2m"}, _KS),
    f"WITH {HZ}, rk AS (SELECT *, row_number() OVER (PARTITION BY horizon, candidate, month, site_no ORDER BY p DESC, item_id) AS r FROM hz) SELECT horizon, candidate, month, site_no, {_TOP} FROM rk GROUP BY 1, 2, 3, 4")

# types, integrity, common rows

_INTS = ["sales_days_lag_1m", "active_months_last_6m", "zero_sales_months_last_6m", "is_sold_last_3m"]
_FLOATS = ["total_qty", "qty_lag_1m", "qty_sum_last_3m", "future_qty_1m"]


def typed(rows: DataFrame) -> DataFrame:
    """Keys as text, counts as 32-bit numbers with 0 for missing ones, quantities as 32-bit floats, in a fixed order."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("month", "site_no", "item_id", "split")], *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in _INTS], *[F.col(c).cast("float").alias(c) for c in _FLOATS])


add("tg_dtype", lambda s, d: typed(T.dataset(s, d)), f"WITH {T.HIS} SELECT month, site_no, item_id, split, {', '.join(f'CAST(coalesce({c}, 0) AS INTEGER) AS {c}' for c in _INTS)}, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in _FLOATS)} FROM ds")
_VIOLATED = "count_if(month_idx > last_idx) AS rows_after_close, count_if(month_idx + 1 > last_idx AND target_available_1m = 1) AS invalid_1m_horizon, count_if(month_idx + 2 > last_idx AND target_available_2m = 1) AS invalid_2m_horizon"


def integrity(rows: DataFrame) -> DataFrame:
    """By split: rows, those beyond their store's last active month, and horizons that claim to be known but reach beyond it."""
    keys = rows.groupBy("split", "month_idx", "site_no", "item_id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("last_idx", "target_available_1m", "target_available_2m", "total_qty")])
    n = lambda mask: F.sum(F.when(mask, F.col("n")).otherwise(0))
    late = lambda k: F.col("month_idx") + k > F.col("last_idx")
    return keys.groupBy("split").agg(
        F.sum("n").alias("output_rows"), n(F.col("target_available_2m") == 1).alias("available_2m_rows"), n(F.col("total_qty") <= 0).alias("zero_rows"), F.sum(F.col("n") - 1).alias("duplicate_keys"), n(late(0)).alias("rows_after_close"),
        n(late(1) & (F.col("target_available_1m") == 1)).alias("invalid_1m_horizon"), n(late(2) & (F.col("target_available_2m") == 1)).alias("invalid_2m_horizon"),
    )


def _damaged(s: SparkSession, d: str) -> DataFrame:
    """The active rows as if stores whose number ends in 7 had closed half a year earlier, so that every check has something to find."""
    return T.active(s, d).withColumn("last_idx", F.when(F.col("site_no").endswith("7"), F.col("last_idx") - 6).otherwise(F.col("last_idx")))


_INTEGRITY = "SELECT split, count(*) AS output_rows, CAST(sum(target_available_2m) AS BIGINT) AS available_2m_rows, count(*) FILTER (WHERE total_qty <= 0) AS zero_rows, count(*) - count(DISTINCT (month_idx, site_no, item_id)) AS duplicate_keys, " + _VIOLATED + " FROM {0} GROUP BY 1"
add("dq_active_integrity", lambda s, d: integrity(T.active(s, d)), f"WITH {T.ADS} {_INTEGRITY.format('ads')}")
add("dq_active_integrity_violated", lambda s, d: integrity(_damaged(s, d)), f"WITH {T.ADS}, bad AS (SELECT * REPLACE (CASE WHEN site_no LIKE '%7' THEN last_idx - 6 ELSE last_idx END AS last_idx) FROM ads) {_INTEGRITY.format('bad')}")


def common_rows(models: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The rows that all models predict, with their predictions and the largest difference of their targets. Keys that recur are an error."""
    joined = None
    for name, rows in models.items():
        own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("target").alias(f"target_{name}"), F.first("prediction").alias(name))
        own = own.select(*keys, F.when(F.col("n") > 1, F.raise_error(F.lit(f"{name} predicts a key twice"))).otherwise(F.col(f"target_{name}")).alias(f"target_{name}"), name)
        joined = own if joined is None else joined.join(own, keys)
    targets = [F.col(f"target_{n}") for n in models]
    return joined.withColumns({"target": targets[0], "target_gap": F.greatest(*targets) - F.least(*targets)}).drop(*[f"target_{n}" for n in models])


_SEGMENTS = {"overall": "true", "nonzero": "target > 0", "20+": "target >= 20"}


def jn_multi_fair(s: SparkSession, d: str) -> DataFrame:
    """Three models on the rows that all of them predict, by split and segment."""
    keys = ["split", "month", "site_no", "item_id"]
    rows = T.forecasts(s, d)
    given = {n: rows.where(rule).select(*keys, "target", F.col(n).alias("prediction")) for n, rule in (("hist", "hist > 0"), ("wma", "wma > 1"), ("two", "two > 0"))}
    long = metrics.candidates(metrics.segmented(common_rows(given, keys), {n: F.expr(r) for n, r in _SEGMENTS.items()}), NAMES)
    error = F.abs(F.col("prediction") - F.col("target"))
    return long.groupBy("split", "segment", "candidate").agg(F.count(F.lit(1)).alias("count"), S.r6(F.avg(error)).alias("mae"), S.r6(100 * S.ratio(F.sum(error), F.sum("target"))).alias("wape"), F.max("target_gap").alias("max_target_gap"))


add("jn_multi_fair", jn_multi_fair, f"""WITH {T.FOR}, j AS (SELECT a.split, a.target AS t, a.hist, b.wma, c.two FROM (SELECT * FROM fc WHERE hist > 0) a JOIN (SELECT * FROM fc WHERE wma > 1) b USING (split, month, site_no, item_id) JOIN (SELECT * FROM fc WHERE two > 0) c USING (split, month, site_no, item_id)),
l AS ({' UNION ALL '.join(f"SELECT split, '{n}' AS candidate, t, {n} AS p FROM j" for n in NAMES)}), g AS (SELECT *, unnest(list_filter(['overall', CASE WHEN t > 0 THEN 'nonzero' END, CASE WHEN t >= 20 THEN '20+' END], lambda x: x IS NOT NULL)) AS segment FROM l)
SELECT split, segment, candidate, count(*) AS count, round(avg(abs(p - t)), 6) AS mae, round(100 * sum(abs(p - t)) / nullif(sum(t), 0), 6) AS wape, CAST(0 AS DOUBLE) AS max_target_gap FROM g GROUP BY 1, 2, 3""")
add("so_page_total", lambda s, d: T.predictions(s, d).groupBy("model_id", "pred_mc").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 50).alias("pages")), f"WITH {T.PRE} SELECT model_id, pred_mc, count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM pre GROUP BY 1, 2")

# decisions

_G = lambda c: f"(b.{c} - c.{c})"
_PAIR = lambda by: f"(SELECT * FROM cm WHERE candidate = 'hist') b JOIN (SELECT * FROM cm WHERE candidate = 'wma') c USING ({by})"
add("sel_pilot", lambda s, d: E.pilot(E.complete(judged(s, d), ["fold", "candidate"]), "fold", "hist", "wma"),
    f"""WITH {LO}, cm AS ({complete_sql('lo', ['fold', 'candidate'])}), e AS (SELECT fold, round(-{_G('wape_nonzero')}, 6) AS nonzero_worsening_pp, round({_G('wape_5_19')}, 6) AS wape5_gain_pp, round({_G('wape_20_plus')}, 6) AS wape20_gain_pp, round(-{_G('recall_5_19')}, 6) AS recall5_gain_pp, round(-{_G('recall_20_plus')}, 6) AS recall20_gain_pp,
  coalesce((greatest({_G('wape_5_19')}, {_G('wape_20_plus')}) >= 0.5 OR greatest(-{_G('recall_5_19')}, -{_G('recall_20_plus')}) >= 1) AND -{_G('wape_nonzero')} <= 0.5, false) AS passed FROM {_PAIR('fold')})
SELECT *, CASE WHEN (SELECT bool_and(passed) FROM e) THEN 'consistent_gain' WHEN (SELECT bool_or(passed) FROM e) THEN 'time_conditional' ELSE 'no_model_increment' END AS status FROM e""")  # fmt: skip


def _accepted(s: SparkSession, d: str) -> DataFrame:
    rows = judged(s, d).where("split = 'valid'")
    return E.acceptance(E.complete(rows, ["candidate"]), E.complete(rows, ["month", "candidate"]), "hist", "wma")


_CHECKS = {
    "one_head_wape_improved": f"greatest({_G('wape_5_19')}, {_G('wape_20_plus')}) >= 0.5", "other_head_wape_protected": f"least({_G('wape_5_19')}, {_G('wape_20_plus')}) >= -0.5", "one_head_recall_improved": f"greatest(-{_G('recall_5_19')}, -{_G('recall_20_plus')}) >= 1",
    "other_head_recall_protected": f"least(-{_G('recall_5_19')}, -{_G('recall_20_plus')}) >= -1", "overall_protected": f"-{_G('wape_overall')} <= 0.2 AND -{_G('integer_wape_overall')} <= 0.2",
    "zero_protected": f"c.prediction_sum_0 <= b.prediction_sum_0 * 1.05::DOUBLE AND -100 * {_G('zero_gt_0_5')} <= 0.5 AND -100 * {_G('zero_gt_1')} <= 0.5", "bias_protected": "abs(c.total_bias) - abs(b.total_bias) <= 1", "mc_protected": f"-{_G('mc_macro_f1')} >= -0.2", "monthly_stable": "months_improved >= 4",
}
add("sel_acceptance", _accepted, f"""WITH {LO}, va AS (SELECT * FROM lo WHERE split = 'valid'), cm AS ({complete_sql('va', ['candidate'])}), mo AS ({complete_sql('va', ['month', 'candidate'])}),
im AS (SELECT count(*) FILTER (WHERE b.wape_20_plus > c.wape_20_plus OR c.recall_20_plus > b.recall_20_plus) AS months_improved FROM (SELECT * FROM mo WHERE candidate = 'hist') b JOIN (SELECT * FROM mo WHERE candidate = 'wma') c USING (month)),
k AS (SELECT months_improved, {', '.join(f'{r} AS {n}' for n, r in _CHECKS.items())} FROM (SELECT * FROM cm WHERE candidate = 'hist') b, (SELECT * FROM cm WHERE candidate = 'wma') c, im) SELECT *, {' AND '.join(_CHECKS)} AS passed FROM k""")
_DECIDED = {"head_wape": f"{_G('wape_20_plus')} >= 0.5", "head_recall": f"-{_G('recall_20_plus')} >= 1", "five_nineteen": f"-{_G('wape_5_19')} <= 0.5", "nonzero": f"-{_G('wape_nonzero')} <= 0.5", "zero_total": "coalesce(c.prediction_sum_0 / nullif(b.prediction_sum_0, 0) - 1, 0) <= 0.05", "total_bias": "abs(c.total_bias) - abs(b.total_bias) <= 1"}
add("sel_comp_decision", lambda s, d: E.compensation_decision(E.complete(judged(s, d), ["split", "candidate"]), ["split"], "hist", "wma"),
    f"""WITH {LO}, cm AS ({complete_sql('lo', ['split', 'candidate'])}), k AS (SELECT split, round({_G('wape_20_plus')}, 6) AS twenty_plus_wape_gain_pp, round(coalesce(c.prediction_sum_0 / nullif(b.prediction_sum_0, 0) - 1, 0), 6) AS zero_prediction_total_increase, round(abs(c.total_bias) - abs(b.total_bias), 6) AS absolute_bias_worsening_pp, {', '.join(f'{r} AS {n}' for n, r in _DECIDED.items())} FROM {_PAIR('split')})
SELECT *, {' AND '.join(_DECIDED)} AS promoted FROM k""")  # fmt: skip


def sel_test_gate(s: SparkSession, d: str) -> DataFrame:
    """For each threshold of gate B: is the relative gain in WAPE at least 0.5 %, and do both heads keep 95 % of their rows; only then the test split is looked at."""
    found = E.gates(T.forecasts(s, d).where("split = 'valid'"), TAUS, {k: v for k, v in metrics.gate_segments().items() if k in ("overall", "5_20", "20plus")}, ("original", "gate_b"))
    of = lambda segment, c: F.max(F.when(F.col("segment") == segment, F.col(c)))
    original = found.where("method = 'original' AND segment = 'overall'").select(F.col("wape").alias("original_wape"))
    wide = found.where("method = 'gate_b'").groupBy("threshold").agg(of("overall", "wape").alias("wape"), of("5_20", "pass_rate").alias("recall_5_20"), of("20plus", "pass_rate").alias("recall_20plus"))
    relative = (F.col("original_wape") - F.col("wape")) / F.col("original_wape")
    return wide.crossJoin(F.broadcast(original)).select("threshold", "original_wape", "wape", "recall_5_20", "recall_20plus", S.r6(relative).alias("relative_gain"), ((relative >= 0.005) & (F.col("recall_5_20") >= 0.95) & (F.col("recall_20plus") >= 0.95)).alias("look_at_test"))  # one row


_VALID_GATES = gates_sql(("overall", "5_20", "20plus"), ("original", "gate_b")).replace("target AS t FROM fc)", "target AS t FROM fc WHERE split = 'valid')")
add("sel_test_gate", sel_test_gate, f"""WITH gt AS ({_VALID_GATES}), o AS (SELECT wape AS original_wape FROM gt WHERE method = 'original' AND segment = 'overall'),
w AS (SELECT threshold, max(wape) FILTER (WHERE segment = 'overall') AS wape, max(pass_rate) FILTER (WHERE segment = '5_20') AS recall_5_20, max(pass_rate) FILTER (WHERE segment = '20plus') AS recall_20plus FROM gt WHERE method = 'gate_b' GROUP BY 1)
SELECT threshold, original_wape, wape, recall_5_20, recall_20plus, round((original_wape - wape) / original_wape, 6) AS relative_gain, (original_wape - wape) / original_wape >= 0.005 AND recall_5_20 >= 0.95 AND recall_20plus >= 0.95 AS look_at_test FROM w, o""")

#: Names of the survey under which a query also goes.
for short, whole in {"mt_topk": "mt_topk_horizons", "mt_business": "mt_business_horizons", "mt_gate_sweep": "mt_gate_sweep_full", "sel_complete": "sel_acceptance"}.items():
    QUERIES[short], ORACLES[short] = QUERIES[whole], ORACLES[whole]
