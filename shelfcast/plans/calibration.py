"""Queries of the probability diagnosis: reliability, calibration maps and what they change, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import calibration as C
from shelfcast.operators import evaluation as E
from shelfcast.plans import evaluation as plans
from shelfcast.plans import tables as T
from shelfcast.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
METHODS = ["original", "platt", "power", "isotonic"]
GROUP = "gds_ctgry_3_lvel"
MASSES = 10


def add(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = function, sql


def probable(s: SparkSession, d: str) -> DataFrame:
    """Forecasts as a probability with many values, and the quantity beside it."""
    two = F.col("two")
    p = two / (two + 1)
    return T.forecasts(s, d).select("month", "split", GROUP, "target", p.alias("p"), (two + 1).alias("q"), (p * (two + 1)).alias("prediction"))


def sold() -> Column:
    return F.col("target") > 0


def fitted(rows: DataFrame, by: list[str]) -> DataFrame:
    """The maps of each group, fitted on the validation split."""
    return C.maps(staged(C.counted(rows.where("split = 'valid'"), by, F.col("p"), sold()), "cells"), by)


def calibrated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the test split, one for each method (candidate), with the probability ``c``; a group without a fit keeps its own."""
    later = rows.where("split = 'test'").join(fitted(rows, by), by, "left")
    methods = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.coalesce(c, F.col("p")).alias("c")) for n, c in C.mapped(F.col("p")).items()]))
    return later.select("month", *by, "target", "p", "q", methods.alias("m")).select("month", *by, "target", "p", "q", "m.*")


_PR = f"{T.FOR},\npr AS MATERIALIZED (SELECT *, p * q AS prediction FROM (SELECT month, split, {GROUP}, target, two / (two + 1) AS p, two + 1 AS q FROM fc))"
_CELL = f"least(floor(least(greatest(p, 0), 1) * {C.BINS}), {C.BINS - 1})"
_INNER = lambda p: f"least(greatest({p}, {C.EDGE}), {1 - C.EDGE}::DOUBLE)"


def counts_sql(source: str, by: list[str]) -> str:
    keys = ", ".join(by)
    return f"SELECT {keys}, CAST({_CELL} AS INTEGER) AS cell, count(*)::DOUBLE AS n, count(*) FILTER (WHERE target > 0)::DOUBLE AS pos, sum(p) AS total FROM {source} GROUP BY {', '.join(map(str, range(1, len(by) + 2)))}"


def maps_sql(by: list[str], rounds: int = 16) -> str:
    """Common table expressions that end in ``pm`` (coefficients) and ``iso`` (rates of cells) from the counts ``ct``; Newton steps are written out."""
    keys = ", ".join(by)
    parts = [f"lx AS MATERIALIZED (SELECT *, ln(pm / (1 - pm)) AS x, ln(pm) AS lp FROM (SELECT *, {_INNER('total / n')} AS pm FROM ct))", f"a0 AS (SELECT DISTINCT {keys}, 1::DOUBLE AS slope, 0::DOUBLE AS intercept, 1::DOUBLE AS gamma FROM ct)"]
    for k in range(rounds):
        parts.append(f"""a{k + 1} AS MATERIALIZED (SELECT {keys}, slope - d1 / greatest(1, abs(d1), abs(d0)) AS slope, intercept - d0 / greatest(1, abs(d1), abs(d0)) AS intercept, greatest(gamma - dg / greatest(1, abs(dg)), {C.LEAST_POWER}) AS gamma FROM (SELECT *, (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS d1, (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS d0
  FROM (SELECT {keys}, slope, intercept, gamma, sum((n * f - pos) * x) + {C.PRIOR} * (slope - 1) AS g1, sum(n * f - pos) + {C.PRIOR} * intercept AS g0, sum(n * f * (1 - f) * x * x) + {C.PRIOR} AS h11, sum(n * f * (1 - f) * x) AS h10, sum(n * f * (1 - f)) + {C.PRIOR} AS h00,
  (sum(-pos * lp + (n - pos) * r * lp / (1 - r)) + {C.PRIOR} * (gamma - 1)) / (sum((n - pos) * r * lp * lp / ((1 - r) * (1 - r))) + {C.PRIOR}) AS dg FROM (SELECT *, 1 / (1 + exp(-(slope * x + intercept))) AS f, exp(gamma * lp) AS r FROM lx JOIN a{k} USING ({keys})) GROUP BY {keys}, slope, intercept, gamma)))""")
    # the highest of the lowest means of all runs around a cell
    parts.append(f"""cu AS MATERIALIZED (SELECT *, sum(n) OVER o AS un, sum(pos) OVER o AS up FROM ct WINDOW o AS (PARTITION BY {keys} ORDER BY cell)),
rn AS (SELECT {', '.join(f'a.{k}' for k in by)}, a.cell AS i, b.cell AS j, (b.up - a.up + a.pos) / (b.un - a.un + a.n) AS mean FROM cu a JOIN cu b ON {' AND '.join(f'a.{k} = b.{k}' for k in by)} AND b.cell >= a.cell),
lo AS (SELECT {keys}, i, j AS k, min(mean) OVER (PARTITION BY {keys}, i ORDER BY j DESC) AS m FROM rn),
iso AS MATERIALIZED (SELECT {keys}, k AS cell, max(m) AS rate FROM lo GROUP BY {keys}, k)""")
    return ",\n".join([*parts, f"pm AS (SELECT {keys}, slope, intercept, gamma FROM a{rounds})"])


def calibrated_sql(by: list[str]) -> str:
    """``maps_sql`` and ``ca``, the rows of the test split for each method."""
    keys = ", ".join(by)
    low = f"coalesce((SELECT rate FROM iso WHERE {' AND '.join(f'iso.{k} = te.{k}' for k in by)} AND iso.cell <= te.cell ORDER BY iso.cell DESC LIMIT 1), (SELECT rate FROM iso WHERE {' AND '.join(f'iso.{k} = te.{k}' for k in by)} ORDER BY iso.cell LIMIT 1))"
    return f"""va AS (SELECT * FROM pr WHERE split = 'valid'), ct AS MATERIALIZED ({counts_sql('va', by)}),
{maps_sql(by)},
pl AS MATERIALIZED (SELECT {keys}, cell, {low} AS rate FROM (SELECT DISTINCT {keys}, CAST({_CELL} AS INTEGER) AS cell FROM pr WHERE split = 'test') te),
te AS (SELECT pr.*, CAST({_CELL} AS INTEGER) AS cell, {_INNER('p')} AS low FROM pr WHERE split = 'test'),
mt AS MATERIALIZED (SELECT te.*, coalesce(1 / (1 + exp(-(slope * ln(low / (1 - low)) + intercept))), p) AS platt, coalesce(exp(gamma * ln(low)), p) AS power, coalesce(rate, p) AS isotonic FROM te LEFT JOIN pm USING ({keys}) LEFT JOIN pl USING ({keys}, cell)),
ca AS MATERIALIZED ({' UNION ALL '.join(f"SELECT month, {keys}, target, target AS t, p, q, '{n}' AS candidate, {'p' if n == 'original' else n} AS c FROM mt" for n in METHODS)})"""


def quality_sql(source: str, by: list[str], masses: int = MASSES) -> str:
    """Quality of probabilities from the counts (by, p, n, pos)."""
    keys = ", ".join(by)
    kept = f"least(greatest(p, 1e-15), {1 - 1e-15}::DOUBLE)"
    return f"""SELECT {keys}, count, round(rate, 6) AS positive_rate, round(mean, 6) AS mean_probability, round(brier, 6) AS brier, round(rate * (1 - rate), 6) AS brier_constant, round(1 - brier / nullif(rate * (1 - rate), 0), 6) AS brier_skill, round(loss, 6) AS log_loss, round(ece, 6) AS ece
FROM (SELECT {keys}, sum(n) AS count, sum(pos) / sum(n) AS rate, sum(total) / sum(n) AS mean, sum(brier) / sum(n) AS brier, sum(loss) / sum(n) AS loss, sum(abs(pos - total)) / sum(n) AS ece
  FROM (SELECT {keys}, mass, sum(n) AS n, sum(pos) AS pos, sum(n * p) AS total, sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) AS brier, sum(-pos * ln({kept}) - (n - pos) * ln(1 - {kept})) AS loss
    FROM (SELECT *, least(floor(coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY {keys}) * {masses} + 1e-9), {masses - 1}) AS mass FROM {source}) GROUP BY {keys}, mass) GROUP BY {keys})"""


def coefficients(s: SparkSession, d: str) -> DataFrame:
    """Slope, intercept, exponent and the number of pools of each category's maps."""
    found = fitted(probable(s, d), [GROUP])
    return found.select(GROUP, S.r6(F.col("slope")).alias("slope"), S.r6(F.col("intercept")).alias("intercept"), S.r6(F.col("gamma")).alias("gamma"), F.size(F.array_distinct(F.transform("pools", lambda q: F.round(q["rate"], 9)))).cast("long").alias("n_rates"))


add("mt_calibration_maps", coefficients, f"""WITH {_PR}, va AS (SELECT * FROM pr WHERE split = 'valid'), ct AS MATERIALIZED ({counts_sql('va', [GROUP])}),
{maps_sql([GROUP])}
SELECT {GROUP}, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(gamma, 6) AS gamma, n_rates FROM pm JOIN (SELECT {GROUP}, count(DISTINCT round(rate, 9)) AS n_rates FROM iso GROUP BY 1) USING ({GROUP})""")


def by_month(s: SparkSession, d: str) -> DataFrame:
    """Brier score, log loss and calibration error of each method, by month after the fit; maps by category."""
    # probabilities told apart to nine decimals, so that equal ones stay together
    counts = calibrated(probable(s, d), [GROUP]).groupBy("month", "candidate", F.round("c", 9).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(sold()).cast("double").alias("pos"))
    return C.quality(counts, ["month", "candidate"], MASSES)


add("mt_calibration", by_month, f"""WITH {_PR}, {calibrated_sql([GROUP])},
cc AS (SELECT month, candidate, round(c, 9) AS p, count(*)::DOUBLE AS n, count(*) FILTER (WHERE target > 0)::DOUBLE AS pos FROM ca GROUP BY 1, 2, 3)
{quality_sql('cc', ['month', 'candidate'])}""")
add("mt_calibration_business", lambda s, d: E.complete(calibrated(probable(s, d), [GROUP]).withColumn("prediction", F.col("c") * F.col("q")), ["candidate"]), f"""WITH {_PR}, {calibrated_sql([GROUP])},
cb AS (SELECT candidate, t, c * q AS p FROM ca) {plans.complete_sql('cb', ['candidate'])}""")
add("mt_reliability", lambda s, d: C.reliability(probable(s, d), ["split", "month"], "p", "prediction"), f"""WITH {_PR}, sg AS (SELECT *, {' + '.join(f'(p >= {x})::INT' for x in C.SEGMENTS[:-1])} AS segment FROM pr),
k AS (SELECT split, month, segment, count(*) AS count, avg(p) AS m, avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS r, count(*) FILTER (WHERE target <= 0) AS true_0, count(*) FILTER (WHERE target > 0 AND target < 2) AS true_1, count(*) FILTER (WHERE target >= 2 AND target < 5) AS true_2_4,
  count(*) FILTER (WHERE target >= 5 AND target < 20) AS true_5_19, count(*) FILTER (WHERE target >= 20) AS true_20_plus, coalesce(sum(prediction) FILTER (WHERE target <= 0), 0) AS z FROM sg GROUP BY 1, 2, 3)
SELECT split, month, segment, count, round(m, 6) AS mean_probability, round(r, 6) AS positive_rate, round(r / nullif(m, 0), 6) AS ratio, true_0, true_1, true_2_4, true_5_19, true_20_plus, round(z, 3) AS zero_prediction, round(z / nullif(sum(z) OVER (PARTITION BY split, month), 0), 6) AS zero_share FROM k""")
add("mt_reliability_masses", lambda s, d: C.masses(C.counted(probable(s, d), ["split"], F.col("p"), sold()), ["split"], MASSES), f"""WITH {_PR}, ct AS MATERIALIZED ({counts_sql('pr', ['split'])}),
mm AS (SELECT *, least(floor(coalesce(sum(n) OVER (PARTITION BY split ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY split) * {MASSES} + 1e-9), {MASSES - 1})::INTEGER AS mass FROM ct),
k AS (SELECT split, mass, sum(n) AS count, min(cell) AS low, max(cell) AS high, sum(pos) / sum(n) AS r, sum(total) / sum(n) AS m FROM mm GROUP BY 1, 2)
SELECT split, mass, count, low, high, round(m, 6) AS mean_probability, round(r, 6) AS positive_rate, round(r - m, 6) AS gap, round(r / nullif(m, 0), 6) AS ratio FROM k""")
