"""Calibration of probabilities: reliability, calibration error, and monotone, logistic and power maps fitted by group.

Rows are counted once by group and score cell (``BINS`` cells over 0 to 1, so counts are bounded by groups times cells). Everything is
fitted to these counts for all groups in the same jobs; windows run over cells of one group. Calibrated probabilities
are evaluated on the counts as well, except for what needs each row's quantity.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S
from shelfcast.sources.staging import staged

BINS = 1000
#: Neighbouring cells of one local pass of the monotone fit.
RANGE = 64
#: Pseudo-observations that hold the maps at the identity, so that groups of one outcome have a fit too.
PRIOR = 1.0
EDGE = 1e-6
LEAST_POWER = 0.01
TOLERANCE, ROUNDS, STEPS = 1e-10, 60, 4
#: Upper bounds of the report's probability segments.
SEGMENTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0)


def cell(p: Column, bins: int = BINS) -> Column:
    return F.least(F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int")


def counted(rows: DataFrame, by: list[str], p: Column, label: Column, weight: Column | None = None, bins: int = BINS) -> DataFrame:
    """(by, cell, n, pos, total): weight, weight of positive rows and summed probability of each cell; null probabilities are left out."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    known = rows.select(*by, p.alias("p"), label.alias("y"), w.alias("w")).where("p IS NOT NULL AND w > 0")
    return known.groupBy(*by, cell(F.col("p"), bins).alias("cell")).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("y"), F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.col("w") * F.col("p")).alias("total"))


def inner(p: Column) -> Column:
    """The probability kept off 0 and 1."""
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))


# a monotone map: pools of adjacent violators


def pooled(n: list[float], pos: list[float]) -> list[int]:
    """Sizes of the pools that make pos / n ascend, adjacent violators joined."""
    pools: list[tuple[float, float, int]] = []
    for one, hit in zip(n, pos, strict=True):
        size = 1
        while pools and pools[-1][1] * one >= hit * pools[-1][0]:
            before = pools.pop()
            one, hit, size = one + before[0], hit + before[1], size + before[2]
        pools.append((one, hit, size))
    return [size for _, _, size in pools]


def isotonic(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, low, high, n, pos, rate): the pools of each group's ascending map. Ranges of cells are pooled apart, then what is left of them together."""
    keys = [f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in by]

    def pool(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("low", "high", "n", "pos")), strict=True))
        out, at = [], 0
        for size in pooled([r[2] for r in rows], [r[3] for r in rows]):
            part = rows[at : at + size]
            out.append((part[0][0], part[-1][1], sum(r[2] for r in part), sum(r[3] for r in part)))
            at += size
        own = [pa.array([group.column(k)[0].as_py()] * len(out), group.schema.field(k).type) for k in by]
        return pa.Table.from_arrays([*own, pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.float64())], names=[*by, "low", "high", "n", "pos"])

    schema = ", ".join([*keys, "low int, high int, n double, pos double"])
    cells = counts.select(*by, F.col("cell").alias("low"), F.col("cell").alias("high"), "n", "pos")
    parts = cells.withColumn("range", F.floor(F.col("low") / RANGE)).groupBy(*by, "range").applyInArrow(pool, schema)
    return parts.groupBy(*by).applyInArrow(pool, schema).withColumn("rate", F.col("pos") / F.col("n"))


# maps of one or two coefficients, by Newton steps over all groups at once


def coefficients(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope, intercept, gamma) of sigmoid(slope * logit(p) + intercept) and of p ^ gamma, p the mean of each cell.

    A Newton step is one aggregate of gradients and curvatures for all groups, by at most 1 in each direction; ``STEPS`` of them are one job. It ends when no
    coefficient moves by more than the tolerance. A pseudo-observation holds them at the identity.
    """
    p = inner(F.col("total") / F.col("n"))
    cells = staged(counts.select(*by, "n", "pos", (F.log(p) - F.log(1 - p)).alias("__x"), F.log(p).alias("__l")), "logits")
    n, pos, x, log = (F.col(c) for c in ("n", "pos", "__x", "__l"))
    fit, raised, none = 1 / (1 + F.exp(-(F.col("slope") * x + F.col("intercept")))), F.exp(F.col("gamma") * log), n - pos
    off, bend = n * fit - pos, n * fit * (1 - fit)
    sums = [F.sum(off * x).alias("__g1"), F.sum(off).alias("__g0"), F.sum(bend * x * x).alias("__h11"), F.sum(bend * x).alias("__h10"), F.sum(bend).alias("__h00")]
    sums += [F.sum(-pos * log + none * raised * log / (1 - raised)).alias("__g"), F.sum(none * raised * log * log / ((1 - raised) * (1 - raised))).alias("__h")]
    g1, g0 = F.col("__g1") + PRIOR * (F.col("slope") - 1), F.col("__g0") + PRIOR * F.col("intercept")
    h11, h10, h00 = F.col("__h11") + PRIOR, F.col("__h10"), F.col("__h00") + PRIOR
    scale = h11 * h00 - h10 * h10
    d1, d0, dg = (h00 * g1 - h10 * g0) / scale, (h11 * g0 - h10 * g1) / scale, (F.col("__g") + PRIOR * (F.col("gamma") - 1)) / (F.col("__h") + PRIOR)
    wide = F.greatest(F.lit(1.0), F.abs(d1), F.abs(d0))
    to = {"slope": F.col("slope") - d1 / wide, "intercept": F.col("intercept") - d0 / wide, "gamma": F.greatest(F.col("gamma") - dg / F.greatest(F.lit(1.0), F.abs(dg)), F.lit(LEAST_POWER))}
    step = F.greatest(*[F.abs(c - F.col(k)) for k, c in to.items()])
    now = cells.select(*by).distinct().select("*", F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), F.lit(1.0).alias("gamma"))
    for _ in range(0, ROUNDS, STEPS):
        for _ in range(STEPS):
            now = cells.join(now.select(*by, *to), by).groupBy(*by, *to).agg(*sums).select(*by, *[c.alias(k) for k, c in to.items()], step.alias("__step"))
        now = staged(now, "coefficients")
        if (now.agg(F.max("__step")).first()[0] or 0) <= TOLERANCE:
            break
    return now.drop("__step")


def maps(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope, intercept, gamma, pools): all maps of a group, the monotone one as an array of (low, high, rate), at most ``BINS`` long."""
    pools = isotonic(counts, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("low", "high", "rate"))).alias("pools"))
    return coefficients(counts, by).join(pools, by)


def mapped(p: Column, bins: int = BINS) -> dict[str, Column]:
    """The calibrated probabilities of ``p`` by method, beside the columns of ``maps`` of as many cells. A cell between two pools has the rate of the one below it, or of the first."""
    low = inner(p)
    below = F.filter("pools", lambda q: q["low"] <= cell(p, bins))
    return {
        "original": p, "platt": 1 / (1 + F.exp(-(F.col("slope") * (F.log(low) - F.log(1 - low)) + F.col("intercept")))), "power": F.exp(F.col("gamma") * F.log(low)),
        "isotonic": F.coalesce(F.try_element_at(below, F.lit(-1))["rate"], F.get("pools", F.lit(0))["rate"]),
    }


# how good probabilities are


def quality(counts: DataFrame, by: list[str], masses: int = 10) -> DataFrame:
    """(by): Brier score and that of the constant rate, skill, log loss, calibration error over cells of equal mass, rate and mean probability.

    ``counts`` has cells of one probability each: (by, p, n, pos). Cells of equal mass are cut where the weight below a probability passes a share; equal
    probabilities stay together.
    """
    up = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    kept = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    placed = counts.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0.0)), "all": F.sum("n").over(whole)})
    mass = F.least(F.floor(F.col("below") / F.col("all") * masses + 1e-9), F.lit(masses - 1)).cast("int")
    sums = placed.groupBy(*by, mass.alias("mass")).agg(
        F.sum(n).alias("n"), F.sum(pos).alias("pos"), F.sum(n * p).alias("total"), F.sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p).alias("brier"), F.sum(-pos * F.log(kept) - (n - pos) * F.log(1 - kept)).alias("loss"),
    )
    rate = F.sum("pos") / F.sum("n")
    found = sums.groupBy(*by).agg(F.sum("n").alias("n"), rate.alias("rate"), (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("brier") / F.sum("n")).alias("brier"), (F.sum("loss") / F.sum("n")).alias("loss"), (F.sum(F.abs(F.col("pos") - F.col("total"))) / F.sum("n")).alias("ece"))
    base = F.col("rate") * (1 - F.col("rate"))
    return found.select(*by, F.col("n").alias("count"), S.r6(F.col("rate")).alias("positive_rate"), S.r6(F.col("mean")).alias("mean_probability"), S.r6(F.col("brier")).alias("brier"), S.r6(base).alias("brier_constant"), S.r6(1 - S.ratio(F.col("brier"), base)).alias("brier_skill"), S.r6(F.col("loss")).alias("log_loss"), S.r6(F.col("ece")).alias("ece"))


def masses(counts: DataFrame, by: list[str], many: int = 10) -> DataFrame:
    """(by, mass): reliability in cells of equal mass, from (by, cell, n, pos, total); rows of one cell stay together."""
    up = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0.0)), "all": F.sum("n").over(Window.partitionBy(*by))})
    mass = F.least(F.floor(F.col("below") / F.col("all") * many + 1e-9), F.lit(many - 1)).cast("int")
    sums = placed.groupBy(*by, mass.alias("mass")).agg(F.sum("n").alias("count"), F.min("cell").alias("low"), F.max("cell").alias("high"), F.sum("pos").alias("pos"), F.sum("total").alias("total"))
    rate, mean = F.col("pos") / F.col("count"), F.col("total") / F.col("count")
    return sums.select(*by, "mass", "count", "low", "high", S.r6(mean).alias("mean_probability"), S.r6(rate).alias("positive_rate"), S.r6(rate - mean).alias("gap"), S.r6(S.ratio(rate, mean)).alias("ratio"))


def segment(p: Column) -> Column:
    """The number of the report's probability segment."""
    return F.aggregate(F.array(*map(F.lit, SEGMENTS[:-1])), F.lit(0), lambda a, x: a + F.when(p >= x, 1).otherwise(0))


def reliability(rows: DataFrame, by: list[str], p: str, prediction: str) -> DataFrame:
    """(by, segment): rows, mean probability and real rate by fixed segment, rows by real quantity, and what is predicted where nothing sells."""
    t = F.col("target")
    n = lambda rule: F.count_if(F.expr(rule))
    sums = rows.groupBy(*by, segment(F.col(p)).alias("segment")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean"), F.avg(F.when(t > 0, 1.0).otherwise(0.0)).alias("rate"), n("target <= 0").alias("true_0"), n("target > 0 AND target < 2").alias("true_1"), n("target >= 2 AND target < 5").alias("true_2_4"),
        n("target >= 5 AND target < 20").alias("true_5_19"), n("target >= 20").alias("true_20_plus"), F.sum(F.when(t <= 0, F.col(prediction)).otherwise(0.0)).alias("zero"),
    )
    share = S.ratio(F.col("zero"), F.sum("zero").over(Window.partitionBy(*by)))
    return sums.select(*by, "segment", "count", S.r6(F.col("mean")).alias("mean_probability"), S.r6(F.col("rate")).alias("positive_rate"), S.r6(S.ratio(F.col("rate"), F.col("mean"))).alias("ratio"), "true_0", "true_1", "true_2_4", "true_5_19", "true_20_plus", F.round("zero", 3).alias("zero_prediction"), S.r6(share).alias("zero_share"))
