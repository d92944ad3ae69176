"""Audits of new features, of errors on high demand, and fitted choices of gates and compensation.

Rows are counted by distinct value, bin or cell first; windows run over these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S
from shelfcast.operators import evaluation as E
from shelfcast.operators import forecast
from shelfcast.sources.staging import staged

#: Top fractions looked at, and limits of the verdict.
TOPS = {"1": 0.01, "5": 0.05, "10": 0.1}
CONSTANT, CORRELATION, LIFT, MONTHS = 0.9999, 0.98, 1.1, 0.75


def _counted(rows: DataFrame, names: list[str], by: list[str], ys: list[str]) -> DataFrame:
    """(feature, *by, raw, n, *ys). Rows are not turned into a row for each feature: each is counted in a read of its own columns."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]]
    each = [rows.select(*by, *ys, F.col(n).cast("double").alias("raw")).groupBy(*by, "raw").agg(*sums).select(F.lit(n).alias("feature"), "*") for n in names]
    return reduce(DataFrame.unionByName, each)


def _clean(c: Column) -> Column:
    """Told apart to six decimals; what is not finite is null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, 6))


def tops(counts: DataFrame, by: list[str], fractions: dict[str, float]) -> DataFrame:
    """Average precision, and precision, recall and lift among the highest fractions, from (value, n, pos) by group."""
    down = Window.partitionBy(*by).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    seen = counts.withColumns({"tp": F.sum("pos").over(down), "seen": F.sum("n").over(down), "hits": F.sum("pos").over(whole), "total": F.sum("n").over(whole)})
    sums = [F.max("hits").alias("hits"), F.max("total").alias("total"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap")]
    for name, x in fractions.items():
        top = F.col("total") - F.col("seen") + F.col("n") > F.ceil(F.round((F.col("total") - 1) * (1 - x), 9))
        sums += [F.sum(F.when(top, F.col("pos")).otherwise(0)).alias(f"tp_{name}"), F.sum(F.when(top, F.col("n")).otherwise(0)).alias(f"n_{name}")]
    found = seen.groupBy(*by).agg(*sums)
    out = [S.r6(F.when(F.col("hits") < F.col("total"), S.ratio(F.col("ap"), F.col("hits")))).alias("average_precision")]
    for name in fractions:
        precision = S.ratio(F.col(f"tp_{name}"), F.col(f"n_{name}"))
        out += [S.r6(precision).alias(f"precision_{name}"), S.r6(S.ratio(F.col(f"tp_{name}"), F.col("hits"))).alias(f"recall_{name}"), S.r6(S.ratio(precision, S.ratio(F.col("hits"), F.col("total")))).alias(f"lift_{name}")]
    return found.select(*by, "hits", *out)


#: Different values, of all features together, whose ranks are broadcast: some 64 MB. Features with the most values beyond them have their ranks joined.
BROADCAST_VALUES = 4_000_000


def rank_correlations(rows: DataFrame, counts: DataFrame, new: list[str], existing: list[str]) -> DataFrame:
    """(feature, existing, correlation): Spearman's, with mean ranks for ties; ``counts`` has each feature's (raw, value, n), with no row of n 0.

    Ranks are taken from their mean, so spreads come from the counts alone and each row adds a product for each pair. Rows look the
    ranks of their raw values up where they are: they are neither rounded, turned into a row for each feature nor gathered again.
    """
    names = [*new, *existing]
    up = Window.partitionBy("feature").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    tied, whole = F.sum("n").over(Window.partitionBy("feature", "value")), F.sum("n").over(Window.partitionBy("feature"))
    ranks = staged(counts.select("feature", "raw", "n", (F.sum("n").over(up) - (tied - 1) / 2 - (whole + 1) / 2).alias("rank")), "ranks")
    figures = ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sqrt(F.sum(F.col("n") * F.col("rank") * F.col("rank"))).alias("spread")).collect()
    spread = {r["feature"]: r["spread"] for r in figures}
    near, seen = [], 0
    for r in sorted(figures, key=lambda r: (r["values"], r["feature"])):
        seen += r["values"]
        near += [r["feature"]] if seen <= BROADCAST_VALUES else []
    wide = rows.select(*[F.col(n).cast("double").alias(n) for n in names])
    for n in names:
        if n not in near:
            own = ranks.where(F.col("feature") == n).select("raw", "rank")
            wide = wide.join(own, F.col(n).eqNullSafe(own.raw)).drop(n, "raw").withColumnRenamed("rank", n)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")).cast("byte") - 1
    few = ranks.where(F.col("feature").isin(near)).select(place.alias("at"), F.coalesce("raw", F.lit(float("nan"))).alias("raw"), "rank").orderBy("at", "raw").toArrow()
    at, raws, found = (c.to_numpy() for c in few.columns)
    looked_up = rows.sparkSession.sparkContext.broadcast({int(i): (raws[at == i], found[at == i]) for i in np.unique(at)})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(new), len(existing)))
        for batch in batches:
            both = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # null as NaN, which numpy orders last, as Spark does
            for i, (raw, rank) in looked_up.value.items():
                both[i] = rank[np.searchsorted(raw, both[i])]
            total += np.stack(both[: len(new)]) @ np.stack(both[len(new) :]).T
        yield pa.RecordBatch.from_pydict({"pair": range(total.size), "product": total.ravel()}, pa.schema([("pair", pa.int32()), ("product", pa.float64())]))

    sums = wide.select(*names).mapInArrow(products, "pair int, product double").groupBy("pair").agg(F.sum("product").alias("product"))
    pairs = [(a, b, spread.get(a, 0.0) * spread.get(b, 0.0)) for a in new for b in existing]
    of = lambda c: F.get(F.array(*[F.lit(p[c]) for p in pairs]), F.col("pair"))
    return sums.select(of(0).alias("feature"), of(1).alias("existing"), S.ratio(F.col("product"), of(2)).alias("correlation"))


def audit(rows: DataFrame, groups: dict[str, list[str]], existing: list[str], labels: dict[str, Column]) -> DataFrame:
    """A row for each new feature and label: coverage, strongest existing feature, ranking against the best existing one, monthly direction, and whether feature and group are kept.

    ``rows`` has ``month`` and is read for each feature, so it should be written or follow from written rows. Counts of (feature, month, value) are written; all but the rank correlations come from these.
    """
    of = {f: g for g, features in groups.items() for f in features}
    ys = [f"y_{n}" for n in labels]
    rows = rows.select("month", *existing, *of, *[F.when(c, 1).otherwise(0).alias(f"y_{n}") for n, c in labels.items()])
    raw = staged(_counted(rows, list(of), ["month"], ys).unionByName(_counted(rows, existing, [], ys), allowMissingColumns=True), "counts")
    cleaned = raw.withColumn("value", _clean(F.col("raw")))
    counts = cleaned.withColumns({"missing": F.when(F.isnull("value"), F.col("n")).otherwise(0), "value": F.coalesce("value", F.lit(0.0))})
    sums = [F.sum(c).alias(c) for c in ("n", "missing", *ys)]
    whole = counts.groupBy("feature", "value").agg(*sums)
    labelled = lambda d: d.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"y_{n}").alias("pos")) for n in labels])).alias("l")).select("*", "l.*")
    new = F.col("feature").isin(*of)

    n = F.sum("n")
    zeros = F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)) - F.sum("missing")
    finite = F.when(F.col("n") > F.col("missing"), F.col("value"))
    shape = whole.where(new).groupBy("feature").agg(S.r6(F.sum("missing") / n).alias("missing_share"), S.r6(zeros / n).alias("zero_share"), F.min(finite).alias("low"), F.max(finite).alias("high"), S.r6(F.max("n") / n).alias("modal_share"))
    strongest = rank_correlations(rows, counts.groupBy("feature", "raw", "value").agg(F.sum("n").alias("n")), list(of), existing).groupBy("feature").agg(F.max(F.struct(S.r6(F.abs("correlation")).alias("c"), F.col("existing").alias("e"))).alias("s")).select("feature", F.col("s.c").alias("strongest_correlation"), F.col("s.e").alias("strongest_existing"))
    scored = tops(labelled(whole), ["feature", "label"], TOPS).drop("hits")
    best = scored.where(~new).groupBy("label").agg(F.max("average_precision").alias("best_existing_precision"))
    monthly = tops(labelled(counts.where(new).groupBy("feature", "month", "value").agg(*sums)), ["feature", "label", "month"], {"10": 0.1}).where("hits > 0")
    direction = monthly.groupBy("feature", "label").agg(S.r6(F.avg(F.when(F.col("lift_10") > 1, 1.0).otherwise(0.0))).alias("direction_share"))

    found = scored.where(new).join(direction, ["feature", "label"], "left").join(best, "label").join(shape, "feature").join(strongest, "feature")
    group = F.coalesce(*[F.when(F.col("feature").isin(*features), F.lit(g)) for g, features in groups.items()])
    feature, family = Window.partitionBy("feature"), Window.partitionBy("family")
    superior = F.max(F.coalesce(F.col("average_precision") > F.col("best_existing_precision"), F.lit(False))).over(feature)
    found = found.withColumns({"family": group, "direction_share": F.coalesce("direction_share", F.lit(0.0)), "constant": F.col("modal_share") >= CONSTANT, "redundant": F.coalesce(F.col("strongest_correlation") >= CORRELATION, F.lit(False)), "superior": superior})
    found = found.withColumn("kept", ~F.col("constant") & (~F.col("redundant") | F.col("superior")))
    passes = F.col("kept") & F.coalesce(F.col("lift_10") > LIFT, F.lit(False)) & (F.col("direction_share") >= MONTHS)
    return found.withColumn("family_passed", F.max(passes).over(family))


def refined_gate(swept: DataFrame, by: list[str], step: float = 0.05) -> DataFrame:
    """For each gate the best threshold within one step of the best on the coarse grid, and which gate wins. ``swept`` has method, threshold and wape."""
    method = Window.partitionBy(*by, "method")
    each = method.orderBy("wape", "threshold")
    on_grid = F.abs(F.col("threshold") / step - F.round(F.col("threshold") / step)) < 1e-6
    centred = swept.withColumn("centre", F.min(F.when(on_grid, F.struct("wape", "threshold"))).over(method)["threshold"])
    local = centred.where(F.abs(F.col("threshold") - F.col("centre")) <= step + 1e-7)
    finalists = local.withColumn("r", F.row_number().over(each)).where("r = 1").drop("r")
    return finalists.select(*by, "method", "centre", "threshold", "wape", (F.row_number().over(Window.partitionBy(*by).orderBy("wape", "method", "threshold")) == 1).alias("chosen"))


#: Top fractions of both levels, and how much worse a rule may make the rest.
MEDIUM, HIGH = (0.0025, 0.005, 0.01, 0.02, 0.05), (0.0005, 0.001, 0.0025, 0.005, 0.01)
GATES = {"five_nineteen": 0.25, "nonzero": 0.5, "zero_total": 0.01, "total_bias": 2.0}


def weighted_thresholds(rows: DataFrame, scores: dict[str, tuple[float, ...]], weight: str, by: list[str]) -> DataFrame:
    """By group, for each score an array of the thresholds at which the weight from the top reaches its fractions."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in scores]))
    sums = rows.where(F.col(weight) > 0).select(*by, F.col(weight).alias("w"), each.alias("e")).select(*by, "w", "e.*").where("value IS NOT NULL").groupBy(*by, "score", "value").agg(F.sum("w").alias("w"))
    down = Window.partitionBy(*by, "score").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumns({"upto": F.sum("w").over(down), "total": F.sum("w").over(Window.partitionBy(*by, "score"))})
    at = lambda s, x: F.max(F.when((F.col("score") == s) & (F.round("upto", 6) >= F.round(x * F.col("total"), 6)), F.col("value")))
    return ranked.groupBy(*by).agg(*[F.array(*[at(s, x) for x in fractions]).alias(f"tau_{s}") for s, fractions in scores.items()])


def compensation_rules(rows: DataFrame, by: list[str], highest: float = 1.5) -> DataFrame:
    """All pairs of a medium and a high top fraction with thresholds, multipliers, metrics and gates, and which rule is chosen.

    ``rows`` has s5, s20, target, prediction, w. Multipliers come from sums by the number of thresholds that a row reaches. Of the rules
    that pass all gates the one of lowest head WAPE is chosen; if there is none, the identity (both fractions 0) is.
    """
    taus = weighted_thresholds(rows, {"s5": MEDIUM, "s20": HIGH}, "w", by)
    reached = lambda s: F.aggregate(f"tau_{s}", F.lit(0), lambda n, x: n + F.when(F.col(s) >= x, 1).otherwise(0))
    held = [*by, "tau_s5", "tau_s20"]
    bins = rows.join(taus, by).select(*held, reached("s5").alias("b5"), reached("s20").alias("b20"), (F.col("w") * F.col("target")).alias("t"), (F.col("w") * F.col("prediction")).alias("p")).groupBy(*held, "b5", "b20").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    # fractions grow, so that who reaches the i-th threshold reaches all later ones
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("medium"), F.lit(j).alias("j"), F.lit(h).alias("high")) for i, m in enumerate(MEDIUM) for j, h in enumerate(HIGH)]))
    each = bins.withColumn("c", cells).select("*", "c.*")
    high = F.col("b20") >= len(HIGH) - F.col("j")
    medium = ~high & (F.col("b5") >= len(MEDIUM) - F.col("i"))
    factor = lambda mask: F.least(F.greatest(F.coalesce(F.sqrt(S.ratio(F.sum(F.when(mask, F.col("t"))), F.sum(F.when(mask, F.col("p"))))), F.lit(1.0)), F.lit(1.0)), F.lit(highest))
    rules = each.groupBy(*held, "i", "medium", "j", "high").agg(factor(medium).alias("c5"), factor(high).alias("c20"))
    rule = ["medium", "high", "tau5", "tau20", "c5", "c20"]
    listed = rules.select(*by, "medium", "high", F.expr("tau_s5[i]").alias("tau5"), F.expr("tau_s20[j]").alias("tau20"), "c5", "c20").groupBy(*by).agg(F.collect_list(F.struct(*rule)).alias("rules"))  # 25 a group
    none = F.lit(None).cast("double")
    identity = F.array(F.struct(F.lit(0.0).alias("medium"), F.lit(0.0).alias("high"), none.alias("tau5"), none.alias("tau20"), F.lit(1.0).alias("c5"), F.lit(1.0).alias("c20")))
    listed = listed.withColumn("rules", F.concat("rules", identity))
    # a row that reaches no threshold is the same under all rules: it counts once, as rule -1, and is added to each of them
    alike = F.array(F.struct(F.lit(-1.0).alias("medium"), F.lit(-1.0).alias("high"), none.alias("tau5"), none.alias("tau20"), F.lit(1.0).alias("c5"), F.lit(1.0).alias("c20")))
    lowest = F.array_min(F.transform("rules", lambda r: r["tau5"])), F.array_min(F.transform("rules", lambda r: r["tau20"]))
    reaches = F.coalesce(F.col("s5") >= lowest[0], F.lit(False)) | F.coalesce(F.col("s20") >= lowest[1], F.lit(False))
    judged = rows.join(listed, by).select(*by, "target", "prediction", "s5", "s20", "w", F.explode(F.when(reaches, F.col("rules")).otherwise(alike)).alias("r"))
    nothing = [F.lit(0.0).alias(c) for c in ("target", "prediction", "s5", "s20", "w")]
    judged = judged.unionByName(listed.select(*by, *nothing, F.explode("rules").alias("r"))).select("*", "r.*")
    lifted = forecast.compensated(F.col("prediction"), F.col("s5"), F.greatest("s5", "s20"), (F.col("tau5"), F.col("c5")), (F.lit(float("inf")), F.lit(1.0)))
    prediction = F.when(F.col("s20") >= F.col("tau20"), F.col("prediction") * F.col("c20")).otherwise(lifted)
    sums = E.complete_sums(judged.withColumn("prediction", prediction), [*by, *rule], F.col("w"))
    group = Window.partitionBy(*by)
    added = [(F.col(c) + F.coalesce(F.max(F.when(F.col("medium") < 0, F.col(c))).over(group), F.lit(0.0))).alias(c) for c in sums.columns if c not in (*by, *rule)]
    found = E.complete_rates(sums.select(*by, *rule, *added).where("medium >= 0"), [*by, *rule])
    kept = ["wape_overall", "wape_5_19", "wape_20_plus", "wape_nonzero", "prediction_sum_0", "total_bias", "recall_20_plus"]
    is_rule = F.col("medium") > 0
    both = found.select(*by, *rule, *kept, *[F.max(F.when(~is_rule, F.col(c))).over(group).alias(f"base_{c}") for c in kept])
    change = {
        "five_nineteen": S.r6(F.col("wape_5_19") - F.col("base_wape_5_19")), "nonzero": S.r6(F.col("wape_nonzero") - F.col("base_wape_nonzero")),
        "zero_total": S.r6(F.coalesce(S.ratio(F.col("prediction_sum_0"), F.col("base_prediction_sum_0")) - 1, F.lit(0.0))), "total_bias": S.r6(F.abs("total_bias") - F.abs("base_total_bias")),
    }
    both = both.withColumns({f"{n}_change": c for n, c in change.items()})
    both = both.withColumns({f"{n}_ok": F.coalesce(F.col(f"{n}_change") <= most, F.lit(False)) for n, most in GATES.items()})
    both = both.withColumn("eligible", reduce(lambda a, b: a & b, [F.col(f"{n}_ok") for n in GATES], is_rule))
    order = group.orderBy(F.desc("eligible"), "wape_20_plus", F.desc("recall_20_plus"), "wape_overall", F.round(F.col("medium") + F.col("high"), 9), "medium")
    both = both.withColumns({"r": F.row_number().over(order), "n_eligible": F.sum(F.col("eligible").cast("int")).over(group)})
    chosen = F.when(is_rule, (F.col("r") == 1) & F.col("eligible")).otherwise(F.col("n_eligible") == 0)
    return both.select(*by, "medium", "high", "tau5", "tau20", S.r6(F.col("c5")).alias("c5"), S.r6(F.col("c20")).alias("c20"), "wape_overall", "wape_20_plus", "recall_20_plus", *[f"{n}_change" for n in GATES], "eligible", chosen.alias("chosen"), "n_eligible")


#: What the rules have to gain on the next folds, and how much worse they may make the rest, on average.
ROLLING = {"wape20_gain": 0.5, "recall20_gain": 1.0, "wape5_worsening": -0.25, "recall5_worsening": -0.25, "nonzero_worsening": -0.5, "zero_increase": -0.01, "bias_worsening": -2.0}
RULE = ["medium", "high", "tau5", "tau20", "c5", "c20"]


def rolling_rules(rows: DataFrame, fold: str) -> DataFrame:
    """For each fold but the first: the rule fitted on all earlier folds, whom it reaches, and what it changes; means, gates and the rule of all folds.

    ``rows`` (fold, s5, s20, target, prediction, w) is written as weighted cells once. A cell belongs to the prefixes of folds that end at its own or later, so
    thresholds, multipliers and choices of all prefixes are fitted together; one pass over the cells judges them.
    """
    cells = staged(rows.groupBy(fold, "s5", "s20", "target", "prediction").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")), "cells")
    folds = sorted(r[0] for r in cells.select(fold).distinct().collect())  # a handful
    until = F.explode(F.filter(F.array(*map(F.lit, folds)) if folds else F.array().cast("array<string>"), lambda f: f >= F.col(fold)))
    rules = staged(compensation_rules(cells.withColumn("until", until).drop("n", fold), ["until"]).where("chosen").select("until", *RULE, "n_eligible"), "rules")
    after = F.create_map(*[F.lit(x) for pair in zip(folds, [*folds[1:], None], strict=True) for x in pair]) if folds else F.lit(None)
    chosen = rules.withColumn(fold, F.try_element_at(after, F.col("until")) if folds else F.lit(None).cast("string")).where(F.col(fold).isNotNull())
    high = F.coalesce(F.col("s20") >= F.col("tau20"), F.lit(False))
    medium = F.coalesce(F.col("s5") >= F.col("tau5"), F.lit(False)) & ~high
    met = cells.join(F.broadcast(chosen), fold)  # a row for each fold
    both = F.explode(F.array(F.struct(F.lit("base").alias("candidate"), F.col("prediction").alias("p")), F.struct(F.lit("rule").alias("candidate"), (F.col("prediction") * F.when(high, F.col("c20")).when(medium, F.col("c5")).otherwise(1.0)).alias("p"))))
    long = met.select(fold, "target", "w", both.alias("b")).select(fold, "target", "w", F.col("b.candidate"), F.col("b.p").alias("prediction"))
    metrics = E.complete(long, [fold, "candidate"], F.col("w"))
    reached = met.groupBy(fold).agg(F.sum(F.when(medium, F.col("n")).otherwise(0)).alias("medium_rows"), F.sum(F.when(high, F.col("n")).otherwise(0)).alias("high_rows"))
    change = {
        "wape20_gain": E.gain("wape_20_plus"), "recall20_gain": -E.gain("recall_20_plus"), "wape5_worsening": -E.gain("wape_5_19"), "recall5_worsening": E.gain("recall_5_19"), "nonzero_worsening": -E.gain("wape_nonzero"),
        "zero_increase": F.coalesce(S.ratio(F.col("c_prediction_sum_0"), F.col("b_prediction_sum_0")) - 1, F.lit(0.0)), "bias_worsening": F.abs("c_total_bias") - F.abs("b_total_bias"),
    }
    changes = E.against(metrics, [fold], "base", "rule").select(fold, *[S.r6(c).alias(n) for n, c in change.items()]).join(reached, fold)
    whole, back = Window.partitionBy(), Window.orderBy(F.desc(fold))  # over a row for each fold
    latest = F.row_number().over(back) <= 2
    better = (F.col("wape20_gain") > 0) & (F.col("recall20_gain") > 0)
    means = changes.withColumn("latest", latest).select("*", *[S.r6(F.avg(n).over(whole)).alias(f"mean_{n}") for n in change], F.coalesce(F.min(F.when(F.col("latest"), F.coalesce(better, F.lit(False)))).over(whole), F.lit(False)).alias("last_two_agree")).drop("latest")
    limits = [F.coalesce(F.col(f"mean_{n}") >= x if x > 0 else F.col(f"mean_{n}") <= -x, F.lit(False)) for n, x in ROLLING.items()]
    passed = means.withColumn("passed", reduce(lambda a, b: a & b, limits, F.col("last_two_agree")))
    final = rules.where(F.col("until") == F.lit(folds[-1] if folds else None)).select(*[F.col(c).alias(f"final_{c}") for c in RULE])
    return passed.join(F.broadcast(chosen), fold).crossJoin(F.broadcast(final))  # one row


def worse_groups(rows: DataFrame, columns: dict[str, int], first: str, second: str, most: int = 10) -> DataFrame:
    """Where the second model is materially worse: of each column the values whose share of those rows most exceeds their share of all. ``columns``: least number of worse rows."""
    worse = F.abs(F.col(second) - F.col("target")) - F.abs(F.col(first) - F.col("target")) > F.greatest(F.lit(2.0), 0.1 * F.col("target"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value"), F.lit(least).alias("least")) for c, least in columns.items()]))
    counts = rows.select(worse.alias("worse"), each.alias("e")).select("worse", "e.*").groupBy("column", "value", "least").agg(F.count(F.lit(1)).alias("all_count"), F.count_if("worse").alias("worse_count"))
    total = counts.groupBy("column").agg(F.sum("all_count").alias("n"), F.sum("worse_count").alias("n_worse"))
    share, base = S.ratio(F.col("worse_count"), F.col("n_worse")), S.ratio(F.col("all_count"), F.col("n"))
    found = counts.join(total, "column").where((F.col("worse_count") >= F.col("least")) & (F.col("worse_count") > 0)).select("column", "value", "worse_count", "all_count", S.r6(share).alias("worse_share"), S.r6(base).alias("all_share"), S.r6(S.ratio(share, base)).alias("concentration_ratio"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("concentration_ratio"), F.desc("worse_count"), "value"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def head_errors(rows: DataFrame, by: list[str], first: str, second: str, fraction: float = 0.01, least: float = 20) -> DataFrame:
    """High-demand rows by group: the threshold of the highest fraction of targets and its share of both models' errors and of the change.

    Rows are summed by distinct target; the window runs over those.
    """
    a, b = (F.abs(F.col(c) - F.col("target")) for c in (first, second))
    sums = rows.where(F.col("target") >= least).groupBy(*by, "target").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))
    up = Window.partitionBy(*by).orderBy("target").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(*by))})
    top = F.col("upto") > F.ceil(F.round((F.col("total") - 1) * (1 - fraction), 9))
    part = lambda c: F.sum(F.when(top, F.col(c)).otherwise(0.0))
    change, all_change = part("b") - part("a"), F.sum("b") - F.sum("a")
    return ranked.groupBy(*by).agg(
        F.sum("n").alias("count"), F.min(F.when(top, F.col("target"))).alias("threshold"), F.sum(F.when(top, F.col("n")).otherwise(0)).alias("top_count"), S.r6(F.coalesce(S.ratio(part("a"), F.sum("a")), F.lit(0.0))).alias("first_error_share"),
        S.r6(F.coalesce(S.ratio(part("b"), F.sum("b")), F.lit(0.0))).alias("second_error_share"), S.r6(F.when(all_change > 1e-9, change / all_change)).alias("deterioration_share"),
    )


def error_groups(rows: DataFrame, by: list[str], level: Column, features: list[str]) -> DataFrame:
    """Rows of target 5-19 by what the second model makes of them (kept, too high, too low), with the mean and extremes of each feature."""
    kind = F.when(level == 3, "kept").when(level == 4, "to_20_plus").otherwise("to_4_or_lower")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = rows.where("target >= 5 AND target < 20").select(*by, kind.alias("kind"), each.alias("f")).select(*by, "kind", "f.*")
    return long.groupBy(*by, "kind", "feature").agg(F.count(F.lit(1)).alias("count"), S.r6(F.avg("value")).alias("mean"), S.r6(F.min("value")).alias("low"), S.r6(F.max("value")).alias("high"))
