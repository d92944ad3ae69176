"""Queries of feature audits, fitted rules and errors on high demand, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S
from shelfcast.operators import audit as A
from shelfcast.operators import cleaning, evaluation, metrics, panel
from shelfcast.plans import evaluation as plans
from shelfcast.plans import tables as T
from shelfcast.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIFF = ["qty_diff_current_lag1", "qty_diff_lag1_lag2", "log_qty_diff_current_lag1", "sales_days_diff_current_lag1", "qty_diff_recent3_previous3", "qty_diff_6m_history_available"]
CROSS = ["xstore_qty_current", "xstore_positive_sites_current", "xstore_qty_per_positive_site_current", "xstore_qty_mean_last_3m", "xstore_qty_max_last_3m", "xstore_qty_diff_1m"]
EXISTING = [
    "total_qty", "qty_lag_1m", "qty_lag_2m", "qty_lag_3m", "qty_sum_last_3m", "qty_mean_last_3m", "qty_max_last_3m", "qty_sum_last_6m", "qty_mean_last_6m", "qty_max_last_6m",
    "sales_days", "sales_days_lag_1m", "sales_days_sum_last_3m", "active_months_last_6m", "zero_sales_months_last_6m",
]
LABELS = {"5plus": 5, "20plus": 20}


def add(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = function, sql


#: Groups of an item and a month whose cross-store demand is broadcast: some 100 MB; beyond them it is joined once and the rows are written again.
BROADCAST_GROUPS = 1_000_000


def featured(s: SparkSession, d: str) -> DataFrame:
    """Training rows with their target and all features. What needs a series' history is written, the rest follows from it in each read.

    Cross-store demand is summed from the rows themselves, as they have every series' month up to the last of training, so the ledger is read once; it is looked up where the rows are.
    """
    own = staged(T.dataset(s, d).where("split = 'train'").select("month_idx", "item_id", "future_qty_1m", *EXISTING), "own")
    side = staged(cleaning.cross_store(own), "side")
    near = side.count() <= BROADCAST_GROUPS
    rows = panel.cross_features(panel.differences(own), side, near).select(F.col("month_idx").alias("month"), "future_qty_1m", *EXISTING, *DIFF, *CROSS)
    return rows if near else staged(rows, "featured")


def feature_audit(s: SparkSession, d: str) -> DataFrame:
    target = S.clip_target(F.col("future_qty_1m"))
    return A.audit(featured(s, d), {"diff": DIFF, "cross_store": CROSS}, EXISTING, {n: target >= x for n, x in LABELS.items()})


_OBS = "active_months_last_6m + zero_sales_months_last_6m = 6"
_FEATURED = f"""{T.HIS}, side AS MATERIALIZED (SELECT month_idx, item_id, sum(greatest(total_qty, 0)) AS gq, count(*) FILTER (WHERE total_qty > 0) AS gs FROM mon GROUP BY 1, 2),
xs AS (SELECT h.*, greatest(coalesce(a.gq, 0) - greatest(total_qty, 0), 0) AS q0, greatest(coalesce(b.gq, 0) - greatest(qty_lag_1m, 0), 0) AS q1, greatest(coalesce(c.gq, 0) - greatest(qty_lag_2m, 0), 0) AS q2, greatest(coalesce(a.gs, 0) - CASE WHEN total_qty > 0 THEN 1 ELSE 0 END, 0) AS s0
  FROM ds h LEFT JOIN side a ON a.item_id = h.item_id AND a.month_idx = h.month_idx LEFT JOIN side b ON b.item_id = h.item_id AND b.month_idx = h.month_idx - 1 LEFT JOIN side c ON c.item_id = h.item_id AND c.month_idx = h.month_idx - 2),
xf AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, total_qty - qty_lag_1m AS qty_diff_current_lag1, qty_lag_1m - qty_lag_2m AS qty_diff_lag1_lag2, ln(1 + greatest(total_qty, 0)) - ln(1 + greatest(qty_lag_1m, 0)) AS log_qty_diff_current_lag1, sales_days - sales_days_lag_1m AS sales_days_diff_current_lag1,
  CASE WHEN {_OBS} THEN qty_sum_last_3m / 3 - (qty_sum_last_6m - qty_sum_last_3m) / 3 ELSE 0 END AS qty_diff_recent3_previous3, CASE WHEN {_OBS} THEN 1 ELSE 0 END AS qty_diff_6m_history_available,
  q0 AS xstore_qty_current, s0 AS xstore_positive_sites_current, coalesce(q0 / nullif(s0, 0), 0) AS xstore_qty_per_positive_site_current, (q0 + q1 + q2) / 3 AS xstore_qty_mean_last_3m, greatest(q0, q1, q2) AS xstore_qty_max_last_3m, q0 - q1 AS xstore_qty_diff_1m FROM xs)"""
_IS_NEW = f"feature IN ({', '.join(repr(f) for f in DIFF + CROSS)})"


def tops_sql(source: str, by: str, fractions: dict[str, float]) -> str:
    """A SELECT of the ranking metrics over (value, n, pos) of ``source``."""
    top = lambda c, x: f"sum({c}) FILTER (WHERE total - seen + n > ceil(round((total - 1) * (1 - {x}::DOUBLE), 9)))"
    out = ", ".join(f"round({top('pos', x)} / {top('n', x)}, 6) AS precision_{n}, round({top('pos', x)} / nullif(max(hits), 0), 6) AS recall_{n}, round({top('pos', x)} / {top('n', x)} / nullif(max(hits) / max(total), 0), 6) AS lift_{n}" for n, x in fractions.items())
    return f"""SELECT {by}, max(hits) AS hits, round(CASE WHEN max(hits) < max(total) THEN sum(pos * tp / seen) / nullif(max(hits), 0) END, 6) AS average_precision, {out}
FROM (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS seen, sum(pos) OVER (PARTITION BY {by}) AS hits, sum(n) OVER (PARTITION BY {by}) AS total FROM {source} WINDOW o AS (PARTITION BY {by} ORDER BY value DESC)) GROUP BY {by}"""


add("mt_feature_audit_full", feature_audit, f"""WITH {_FEATURED},
l AS MATERIALIZED ({' UNION ALL '.join(f"SELECT rid, month, greatest(future_qty_1m, 0) AS t, '{f}' AS feature, round(CAST({f} AS DOUBLE), 6) AS value FROM xf WHERE split = 'train'" for f in EXISTING + DIFF + CROSS)}),
r AS MATERIALIZED (SELECT rid, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM l),
sp AS (SELECT a.feature, b.feature AS existing, round(abs(corr(a.rk, b.rk)), 6) AS c FROM r a JOIN r b USING (rid) WHERE a.{_IS_NEW} AND NOT b.{_IS_NEW} GROUP BY 1, 2),
st AS (SELECT feature, c AS strongest_correlation, existing AS strongest_existing FROM sp QUALIFY row_number() OVER (PARTITION BY feature ORDER BY c DESC, existing DESC) = 1),
y AS ({' UNION ALL '.join(f"SELECT feature, month, value, '{n}' AS label, count(*) AS n, count(*) FILTER (WHERE t >= {x}) AS pos FROM l GROUP BY 1, 2, 3" for n, x in LABELS.items())}),
w AS (SELECT feature, label, value, sum(n) AS n, sum(pos) AS pos FROM y GROUP BY 1, 2, 3),
sh AS (SELECT feature, round(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) / sum(n), 6) AS missing_share, round(coalesce(sum(n) FILTER (WHERE value = 0), 0) / sum(n), 6) AS zero_share, min(value) AS low, max(value) AS high, round(max(n) / sum(n), 6) AS modal_share FROM w WHERE label = '5plus' GROUP BY 1),
sc AS ({tops_sql('w', 'feature, label', A.TOPS)}),
mo AS ({tops_sql('y', 'feature, label, month', {'10': 0.1})}),
di AS (SELECT feature, label, round(avg(CASE WHEN lift_10 > 1 THEN 1.0 ELSE 0.0 END), 6) AS direction_share FROM mo WHERE hits > 0 GROUP BY 1, 2),
be AS (SELECT label, max(average_precision) AS best_existing_precision FROM sc WHERE NOT {_IS_NEW} GROUP BY 1),
j AS (SELECT sc.* EXCLUDE (hits), CASE WHEN feature LIKE 'xstore%' THEN 'cross_store' ELSE 'diff' END AS family, coalesce(direction_share, 0) AS direction_share, best_existing_precision, missing_share, zero_share, low, high, modal_share, strongest_correlation, strongest_existing,
  modal_share >= {A.CONSTANT} AS constant, coalesce(strongest_correlation >= {A.CORRELATION}, false) AS redundant, bool_or(coalesce(average_precision > best_existing_precision, false)) OVER (PARTITION BY feature) AS superior
  FROM sc LEFT JOIN di USING (feature, label) JOIN be USING (label) JOIN sh USING (feature) JOIN st USING (feature) WHERE {_IS_NEW}),
k AS (SELECT *, NOT constant AND (NOT redundant OR superior) AS kept FROM j)
SELECT *, bool_or(kept AND coalesce(lift_10 > {A.LIFT}, false) AND direction_share >= {A.MONTHS}) OVER (PARTITION BY family) AS family_passed FROM k""")

FINE = [round(0.01 * i, 2) for i in range(5, 96)]


def sel_gate_refined(s: SparkSession, d: str) -> DataFrame:
    """Both gates on every hundredth; the coarse best, refined within one coarse step, and the gate that wins."""
    swept = evaluation.gates(T.forecasts(s, d), FINE, {"overall": F.lit(True)}, ("gate_a", "gate_b"))
    return A.refined_gate(swept, ["segment"])


_FINE_SQL = plans.gates_sql(("overall",), ("gate_a", "gate_b")).replace(str(plans.TAUS), str(FINE))
add("sel_gate_refined", sel_gate_refined, f"""WITH sw AS MATERIALIZED ({_FINE_SQL}),
ce AS (SELECT segment, method, threshold AS centre FROM sw WHERE abs(threshold * 20 - round(threshold * 20)) < 1e-6 QUALIFY row_number() OVER (PARTITION BY segment, method ORDER BY wape, threshold) = 1),
fi AS (SELECT segment, method, centre, threshold, wape FROM sw JOIN ce USING (segment, method) WHERE abs(threshold - centre) <= 0.0500001 QUALIFY row_number() OVER (PARTITION BY segment, method ORDER BY wape, threshold) = 1)
SELECT *, row_number() OVER (PARTITION BY segment ORDER BY wape, method, threshold) = 1 AS chosen FROM fi""")


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Forecasts with the scores of both heads, weights, and their year as fold."""
    return T.forecasts(s, d).select("split", F.substring("month", 1, 4).alias("fold"), F.col("qty_sum_last_3m").cast("double").alias("s5"), F.col("qty_lag_1m").cast("double").alias("s20"), "target", F.col("two").alias("prediction"), plans.weight().alias("w"))


def fc_comp_rules(s: SparkSession, d: str) -> DataFrame:
    """Rows of equal scores, target and prediction are one weighted cell, written once: rules and their judgement read the cells."""
    cells = _scored(s, d).groupBy("split", "s5", "s20", "target", "prediction").agg(F.sum("w").alias("w"))
    return A.compensation_rules(staged(cells, "cells"), ["split"])


def _rules(by: str) -> str:
    """Common table expressions that end in ``ru`` (all rules) and ``re`` (their metrics, gates and choice) of the rows ``b``, by group."""

    def taus(score: str, name: str, fractions: tuple[float, ...]) -> str:
        return f"""{name} AS (SELECT {by}, f AS {name}, max(v) AS tau_{name} FROM (SELECT {by}, v, sum(w) OVER (PARTITION BY {by} ORDER BY v DESC) AS upto, sum(w) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, {score} AS v, sum(w) AS w FROM b GROUP BY 1, 2)), (SELECT unnest({list(fractions)}::DOUBLE[]) AS f) WHERE round(upto, 6) >= round(f * total, 6) GROUP BY 1, 2)"""

    return f"""{taus('s5', 'medium', A.MEDIUM)}, {taus('s20', 'high', A.HIGH)},
ru AS MATERIALIZED (SELECT {by}, medium, high, tau_medium AS tau5, tau_high AS tau20, least(greatest(coalesce(sqrt(sum(w * t) FILTER (WHERE s20 < tau_high AND s5 >= tau_medium) / nullif(sum(w * p) FILTER (WHERE s20 < tau_high AND s5 >= tau_medium), 0)), 1), 1), 1.5) AS c5,
  least(greatest(coalesce(sqrt(sum(w * t) FILTER (WHERE s20 >= tau_high) / nullif(sum(w * p) FILTER (WHERE s20 >= tau_high), 0)), 1), 1), 1.5) AS c20 FROM b JOIN medium USING ({by}) JOIN high USING ({by}) GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT DISTINCT {by}, 0::DOUBLE, 0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 1::DOUBLE, 1::DOUBLE FROM b),
ju AS (SELECT {by}, medium, high, w, t, CASE WHEN s20 >= tau20 THEN p * c20 WHEN s5 >= tau5 THEN p * c5 ELSE p END AS p FROM b JOIN ru USING ({by})),
cm AS MATERIALIZED ({plans.complete_sql('ju', [by, 'medium', 'high'], 'w')}),
ch AS (SELECT c.*, round(c.wape_5_19 - i.wape_5_19, 6) AS five_nineteen_change, round(c.wape_nonzero - i.wape_nonzero, 6) AS nonzero_change, round(coalesce(c.prediction_sum_0 / nullif(i.prediction_sum_0, 0) - 1, 0), 6) AS zero_total_change, round(abs(c.total_bias) - abs(i.total_bias), 6) AS total_bias_change
  FROM (SELECT * FROM cm WHERE medium > 0) c JOIN (SELECT * FROM cm WHERE medium = 0) i USING ({by})),
el AS (SELECT *, {' AND '.join(f'coalesce({n}_change <= {most}, false)' for n, most in A.GATES.items())} AS eligible FROM ch),
re AS (SELECT *, eligible AND row_number() OVER (PARTITION BY {by} ORDER BY eligible DESC, wape_20_plus, recall_20_plus DESC, wape_overall, round(medium + high, 9), medium) = 1 AS chosen, CAST(sum(eligible::INT) OVER (PARTITION BY {by}) AS BIGINT) AS n_eligible FROM el),
al AS (SELECT {by}, medium, high, wape_overall, wape_20_plus, recall_20_plus, five_nineteen_change, nonzero_change, zero_total_change, total_bias_change, eligible, chosen, n_eligible FROM re
  UNION ALL SELECT {by}, 0, 0, wape_overall, wape_20_plus, recall_20_plus, 0, 0, 0, 0, false, n_eligible = 0, n_eligible FROM (SELECT * FROM cm WHERE medium = 0) JOIN (SELECT {by}, max(n_eligible) AS n_eligible FROM re GROUP BY 1) USING ({by}))"""


_SCORED = f"{T.FOR}, sc AS MATERIALIZED (SELECT split, substr(month, 1, 4) AS fold, CAST(qty_sum_last_3m AS DOUBLE) AS s5, CAST(qty_lag_1m AS DOUBLE) AS s20, target AS t, two AS p, active_months_last_6m + 1 AS w FROM fc)"
add("fc_comp_rules", fc_comp_rules, f"""WITH {_SCORED}, b AS (SELECT * EXCLUDE (fold) FROM sc), {_rules('split')}
SELECT al.*, tau5, tau20, round(c5, 6) AS c5, round(c20, 6) AS c20 FROM al JOIN ru USING (split, medium, high)""")
_CHANGES = {
    "wape20_gain": "b.wape_20_plus - c.wape_20_plus", "recall20_gain": "c.recall_20_plus - b.recall_20_plus", "wape5_worsening": "c.wape_5_19 - b.wape_5_19", "recall5_worsening": "b.recall_5_19 - c.recall_5_19", "nonzero_worsening": "c.wape_nonzero - b.wape_nonzero",
    "zero_increase": "coalesce(c.prediction_sum_0 / nullif(b.prediction_sum_0, 0) - 1, 0)", "bias_worsening": "abs(c.total_bias) - abs(b.total_bias)",
}
add("fc_comp_rolling", lambda s, d: A.rolling_rules(_scored(s, d).drop("split"), "fold"), f"""WITH {_SCORED}, f AS (SELECT fold AS until, lead(fold) OVER (ORDER BY fold) AS next FROM (SELECT DISTINCT fold FROM sc)), b AS MATERIALIZED (SELECT sc.*, until FROM sc JOIN f ON fold <= until), {_rules('until')},
rl AS MATERIALIZED (SELECT until, next, medium, high, tau5, tau20, round(c5, 6) AS c5, round(c20, 6) AS c20, n_eligible FROM al JOIN ru USING (until, medium, high) JOIN f USING (until) WHERE chosen),
me AS MATERIALIZED (SELECT fold, t, p, w, CASE WHEN s20 >= tau20 THEN 2 WHEN s5 >= tau5 THEN 1 ELSE 0 END AS head, c5, c20 FROM sc JOIN rl ON fold = next),
jj AS (SELECT fold, 'base' AS candidate, t, p, w FROM me UNION ALL SELECT fold, 'rule', t, CASE head WHEN 2 THEN p * c20 WHEN 1 THEN p * c5 ELSE p END, w FROM me), mm AS MATERIALIZED ({plans.complete_sql('jj', ['fold', 'candidate'], 'w')}),
cg AS (SELECT fold, {', '.join(f'round({r}, 6) AS {n}' for n, r in _CHANGES.items())} FROM (SELECT * FROM mm WHERE candidate = 'base') b JOIN (SELECT * FROM mm WHERE candidate = 'rule') c USING (fold)),
hd AS (SELECT fold, count(*) FILTER (WHERE head = 1) AS medium_rows, count(*) FILTER (WHERE head = 2) AS high_rows FROM me GROUP BY 1),
av AS (SELECT {', '.join(f'round(avg({n}), 6) AS mean_{n}' for n in _CHANGES)}, (SELECT bool_and(wape20_gain > 0 AND recall20_gain > 0) FROM (SELECT * FROM cg ORDER BY fold DESC LIMIT 2)) AS last_two_agree FROM cg)
SELECT cg.*, medium_rows, high_rows, av.*, last_two_agree AND {' AND '.join(f'mean_{n} >= {x}' if x > 0 else f'mean_{n} <= {-x}' for n, x in A.ROLLING.items())} AS passed, rl.* EXCLUDE (next), {', '.join(f'fi.{c} AS final_{c}' for c in A.RULE)}
FROM cg JOIN hd USING (fold) JOIN rl ON fold = next, av, (SELECT * FROM rl WHERE next IS NULL) fi""")

_COLUMNS = {"site_no": 10, "gds_ctgry_3_lvel": 10, "history_level": 1, "short_history": 1}


def mt_concentration_groups(s: SparkSession, d: str) -> DataFrame:
    """Where the weighted average is materially worse than the mean on high demand, by store, category and kind of history."""
    level = F.when(F.col("current") <= 0, "0").when(F.col("current") < 5, "1-4").when(F.col("current") < 20, "5-19").otherwise("20+")
    rows = T.forecasts(s, d).where("target >= 20").withColumns({"history_level": level, "short_history": F.when(F.col("active_months_last_6m") < 3, "lt3_active_months").otherwise("3plus_active_months")})
    return A.worse_groups(rows, _COLUMNS, "hist", "wma")


add("mt_concentration_groups", mt_concentration_groups, f"""WITH {T.FOR}, h AS MATERIALIZED (SELECT *, CASE WHEN current <= 0 THEN '0' WHEN current < 5 THEN '1-4' WHEN current < 20 THEN '5-19' ELSE '20+' END AS history_level, CASE WHEN active_months_last_6m < 3 THEN 'lt3_active_months' ELSE '3plus_active_months' END AS short_history,
  abs(wma - target) - abs(hist - target) > greatest(2.0, 0.1::DOUBLE * target) AS worse FROM fc WHERE target >= 20),
g AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, trim({c}) AS value, {least} AS least, count(*) AS all_count, count(*) FILTER (WHERE worse) AS worse_count FROM h GROUP BY 2" for c, least in _COLUMNS.items())}),
f AS (SELECT *, sum(all_count) OVER (PARTITION BY col) AS n, sum(worse_count) OVER (PARTITION BY col) AS nw FROM g),
k AS (SELECT col AS column, value, worse_count, all_count, round(worse_count / nw, 6) AS worse_share, round(all_count / n, 6) AS all_share, round((worse_count / nw) / (all_count / n), 6) AS concentration_ratio FROM f WHERE worse_count >= least AND worse_count > 0)
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY concentration_ratio DESC, worse_count DESC, value) AS rank FROM k QUALIFY rank <= 10""")
add("mt_head_errors", lambda s, d: A.head_errors(T.forecasts(s, d), ["month"], "hist", "wma"), f"""WITH {T.FOR}, h AS (SELECT month, target, abs(hist - target) AS a, abs(wma - target) AS b, row_number() OVER (PARTITION BY month ORDER BY target) AS r, count(*) OVER (PARTITION BY month) AS n FROM fc WHERE target >= 20),
k AS (SELECT h.*, target >= th AS top, th FROM h JOIN (SELECT month, min(target) AS th FROM h WHERE r > ceil(round((n - 1) * 0.99::DOUBLE, 9)) GROUP BY 1) USING (month))
SELECT month, count(*) AS count, max(th) AS threshold, count(*) FILTER (WHERE top) AS top_count, round(coalesce(sum(a) FILTER (WHERE top) / nullif(sum(a), 0), 0), 6) AS first_error_share, round(coalesce(sum(b) FILTER (WHERE top) / nullif(sum(b), 0), 0), 6) AS second_error_share,
  round(CASE WHEN sum(b) - sum(a) > 1e-9 THEN (sum(b) FILTER (WHERE top) - sum(a) FILTER (WHERE top)) / (sum(b) - sum(a)) END, 6) AS deterioration_share FROM k GROUP BY 1""")
_HISTORY = ["current", "qty_lag_1m", "qty_sum_last_3m", "active_months_last_6m"]
add("mt_error_groups", lambda s, d: A.error_groups(T.forecasts(s, d), ["split"], S.level(F.col("wma")), _HISTORY),
    f"WITH {T.FOR}, l AS (" + " UNION ALL ".join(f"SELECT split, CASE {T.level_sql('wma')} WHEN 3 THEN 'kept' WHEN 4 THEN 'to_20_plus' ELSE 'to_4_or_lower' END AS kind, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM fc WHERE target >= 5 AND target < 20" for f in _HISTORY) + ") SELECT split, kind, feature, count(*) AS count, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM l GROUP BY 1, 2, 3")

_SETS = ["hist", "wma", "near", "rank", "error"]


def sel_pilot_advance(s: SparkSession, d: str) -> DataFrame:
    """Which set of features goes on: forecasts stand for the sets, each ranking the heads and predicting the quantity; hist is the baseline. Beside a forecast three sets are made of the target, to pass both ways, by ranking only and by errors only."""
    rows = T.forecasts(s, d).withColumns({"near": (F.col("hist") + F.col("target")) / 2, "rank": 3 * F.col("target"), "error": F.when(F.col("target") > 0, F.col("target")).otherwise(1000)}).withColumn("fold", F.substring("month", 1, 4)).where("fold BETWEEN '1999' AND '2001'")
    long = staged(metrics.cleaned(metrics.candidates(rows, _SETS), "target", "prediction").select("fold", "candidate", "target", "prediction"), "sets")
    counts = long.groupBy("fold", "candidate", F.round("prediction", 6).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") >= 5).alias("p5"), F.count_if(F.col("target") >= 20).alias("p20"))
    down = Window.partitionBy("fold", "candidate").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ap = lambda c: F.try_divide(F.sum(F.col(c) * F.col(f"{c}_upto") / F.col("upto")), F.sum(c))
    ranks = counts.withColumns({"upto": F.sum("n").over(down), "p5_upto": F.sum("p5").over(down), "p20_upto": F.sum("p20").over(down)}).groupBy("fold", "candidate").agg(ap("p5").alias("ap5"), ap("p20").alias("ap20"))
    return evaluation.advancing(ranks, evaluation.complete(long, ["fold", "candidate"]), "fold", "hist")


_ADV = evaluation.ADVANCES
_GR = lambda c: f"round(coalesce(c.{c} / nullif(b.{c}, 0) - 1, 0), 6)"
add("sel_pilot_advance", sel_pilot_advance, f"""WITH {T.FOR}, fs AS (SELECT *, (hist + target) / 2 AS near, 3 * target AS rank, CASE WHEN target > 0 THEN target ELSE 1000 END AS error, substr(month, 1, 4) AS fold FROM fc WHERE substr(month, 1, 4) BETWEEN '1999' AND '2001'),
lo AS MATERIALIZED ({' UNION ALL '.join(f"SELECT fold, '{n}' AS candidate, target AS t, greatest({n}, 0) AS p FROM fs" for n in _SETS)}),
co AS (SELECT fold, candidate, round(p, 6) AS v, count(*) AS n, count(*) FILTER (WHERE t >= 5) AS p5, count(*) FILTER (WHERE t >= 20) AS p20 FROM lo GROUP BY 1, 2, 3),
ra AS (SELECT fold, candidate, sum(p5 * u5 / u) / nullif(sum(p5), 0) AS ap5, sum(p20 * u20 / u) / nullif(sum(p20), 0) AS ap20 FROM (SELECT *, sum(n) OVER o AS u, sum(p5) OVER o AS u5, sum(p20) OVER o AS u20 FROM co WINDOW o AS (PARTITION BY fold, candidate ORDER BY v DESC)) GROUP BY 1, 2),
cm AS ({plans.complete_sql('lo', ['fold', 'candidate'])}), al AS (SELECT * FROM ra JOIN cm USING (fold, candidate)),
ea AS (SELECT c.candidate, {_GR('ap5')} AS ap5, {_GR('ap20')} AS ap20, round(b.wape_5_19 - c.wape_5_19, 6) AS w5, round(b.wape_20_plus - c.wape_20_plus, 6) AS w20, round(c.recall_5_19 - b.recall_5_19, 6) AS r5, round(c.recall_20_plus - b.recall_20_plus, 6) AS r20, round(c.wape_nonzero - b.wape_nonzero, 6) AS nz
  FROM (SELECT * FROM al WHERE candidate <> 'hist') c JOIN (SELECT * FROM al WHERE candidate = 'hist') b USING (fold)),
de AS (SELECT candidate, count(*) AS folds, bool_and(coalesce(ap5 >= {_ADV['ap_gain']} AND ap20 >= {-_ADV['ap_decline']} OR ap20 >= {_ADV['ap_gain']} AND ap5 >= {-_ADV['ap_decline']}, false)) AS ap_pass, bool_and(coalesce((greatest(w5, w20) >= {_ADV['wape']} OR greatest(r5, r20) >= {_ADV['recall']}) AND nz <= {_ADV['nonzero']}, false)) AS q_pass,
  round(avg(w20), 6) AS mean_wape20_gain_pp, round(avg(ap20), 6) AS mean_ap20_relative, round(avg(ap5), 6) AS mean_ap5_relative FROM ea GROUP BY 1)
SELECT *, ap_pass OR q_pass AS passed, (ap_pass OR q_pass) AND row_number() OVER (ORDER BY ap_pass OR q_pass DESC, mean_wape20_gain_pp DESC NULLS LAST, mean_ap20_relative DESC NULLS LAST, mean_ap5_relative DESC NULLS LAST, length(candidate), candidate) = 1 AS selected FROM de""")

#: Names of the survey under which a query also goes.
for short, whole in {"mt_feature_audit": "mt_feature_audit_full", "sel_gate": "sel_gate_refined", "fc_comp_fit": "fc_comp_rules"}.items():
    QUERIES[short], ORACLES[short] = QUERIES[whole], ORACLES[whole]
