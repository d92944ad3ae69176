"""Wider evaluation: complete metric rows, gates, thresholds, monthly signals, and decisions over them.

Everything is conditional sums in one pass over the rows, then arithmetic on the few rows that come out;
windows run over score bins, distinct feature values or folds only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions import scalars as S
from shelfcast.operators import metrics, quantiles

#: Segments of the complete metrics, by target.
COMPLETE = {"overall": "true", "0": "target <= 0", "1": "target = 1", "2-4": "target >= 2 AND target < 5", "5-19": "target >= 5 AND target < 20", "20+": "target >= 20", "nonzero": "target > 0"}
CODES = range(5)


def code(c: Column) -> Column:
    return F.when(c <= 0, 0).when(c == 1, 1).when(c < 5, 2).when(c < 20, 3).otherwise(4)


def name_of(segment: str) -> str:
    return segment.replace("-", "_").replace("+", "_plus")


def complete_sums(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """The sums over (target, prediction) of which ``complete`` is made; sums of parts of a group add up to its own."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    base = rows.select(*by, S.clip_target(F.col("target")).alias("target"), S.clip_target(F.col("prediction")).alias("prediction"), w.alias("w"))
    base = base.withColumn("whole", F.floor(F.col("prediction") + 0.5).cast("double"))
    base = base.withColumns({"tc": code(F.col("target")), "pc": code(F.col("whole"))})
    sums = []
    for segment, rule in COMPLETE.items():
        n, mine = name_of(segment), F.expr(rule)
        part = lambda c, mine=mine: F.sum(F.when(mine, F.col("w") * c).otherwise(0.0))
        sums += [F.count_if(mine).alias(f"count_{n}"), part(F.lit(1.0)).alias(f"w_{n}"), part(F.col("target")).alias(f"t_{n}"), part(F.col("prediction")).alias(f"p_{n}")]
        sums += [part(F.abs(F.col("prediction") - F.col("target"))).alias(f"a_{n}"), part(F.abs(F.col("whole") - F.col("target"))).alias(f"i_{n}")]
    when = lambda mask, name: F.sum(F.when(mask, F.col("w")).otherwise(0.0)).alias(name)
    sums += [when((F.col("target") <= 0) & (F.col("prediction") > 0.5), "z5"), when((F.col("target") <= 0) & (F.col("prediction") > 1), "z1")]
    for k in CODES:
        sums += [when((F.col("tc") == k) & (F.col("pc") == k), f"hit{k}"), when(F.col("tc") == k, f"true{k}"), when(F.col("pc") == k, f"pred{k}")]
    return base.groupBy(*by).agg(*sums)


def complete(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(target, prediction) as one row for a group: by segment count, sums, WAPE raw and rounded; bias, zero rates, macro F1 and recalls in percent."""
    return complete_rates(complete_sums(rows, by, weight), by)


def complete_rates(found: DataFrame, by: list[str]) -> DataFrame:
    """``complete`` from the rows of ``complete_sums``."""
    out = []
    for segment in COMPLETE:
        n = name_of(segment)
        out += [F.col(f"count_{n}"), F.round(f"t_{n}", 3).alias(f"target_sum_{n}"), F.round(f"p_{n}", 3).alias(f"prediction_sum_{n}")]
        out += [S.r6(100 * S.ratio(F.col(f"a_{n}"), F.col(f"t_{n}"))).alias(f"wape_{n}"), S.r6(100 * S.ratio(F.col(f"i_{n}"), F.col(f"t_{n}"))).alias(f"integer_wape_{n}")]
    zero = F.lit(0.0)
    f1 = [F.coalesce(S.ratio(2 * F.col(f"hit{k}"), F.col(f"true{k}") + F.col(f"pred{k}")), zero) for k in CODES]
    recall = lambda k: S.r6(100 * F.coalesce(S.ratio(F.col(f"hit{k}"), F.col(f"true{k}")), zero))
    return found.select(
        *by, *out, S.r6(100 * S.ratio(F.col("p_overall") - F.col("t_overall"), F.col("t_overall"))).alias("total_bias"), S.r6(F.coalesce(S.ratio(F.col("z5"), F.col("w_0")), zero)).alias("zero_gt_0_5"),
        S.r6(F.coalesce(S.ratio(F.col("z1"), F.col("w_0")), zero)).alias("zero_gt_1"), S.r6(20 * reduce(lambda a, b: a + b, f1)).alias("mc_macro_f1"), recall(3).alias("recall_5_19"), recall(4).alias("recall_20_plus"),
    )


def weighted_components(rows: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """The classifier's weighted ranking, recall at a half and log loss, and the quantity's weighted errors where something sells."""
    rows = rows.withColumn("w", weight.cast("double"))
    rank = metrics.binary_rank(rows, "p", F.col("target") > 0, by, F.col("w"))
    sells, error = F.col("target") > 0, F.abs(F.col("q") - F.col("target"))
    part = lambda mask, c: F.sum(F.when(mask, F.col("w") * c).otherwise(0.0))
    one = F.lit(1.0)
    rest = rows.groupBy(*by).agg(
        S.r6(S.ratio(part(sells & (F.col("p") >= 0.5), one), part(sells, one))).alias("recall"), S.r6(S.ratio(part(sells, error), part(sells, one))).alias("positive_mae"), S.r6(100 * S.ratio(part(sells, error), part(sells, F.col("target")))).alias("positive_wape"),
    )
    return rank.join(rest, by)


def gates(rows: DataFrame, thresholds: list[float], segments: dict[str, Column], methods: tuple[str, ...] = ("original", "gate_a", "gate_b")) -> DataFrame:
    """(method, threshold, segment) with errors, sums, zero diagnostics and pass rate.

    ``original`` is p * q ungated, ``gate_a`` keeps p * q and ``gate_b`` q from the threshold on. Rows are summed once by
    segment and number of thresholds passed; a threshold then adds up bins: targets below it, errors above.
    """
    p, q = F.least(F.greatest(F.col("p").cast("double"), F.lit(0.0)), F.lit(1.0)), F.greatest(F.col("q"), F.lit(0.0))
    bins = reduce(lambda a, b: a + b, [F.when(p >= x, 1).otherwise(0) for x in thresholds])
    base = metrics.segmented(rows.select(S.clip_target(F.col("target")).alias("target"), (p * q).alias("a"), q.alias("b"), bins.alias("bin")), segments)
    t, sums = F.col("target"), [F.count(F.lit(1)).alias("n"), F.sum("target").alias("t"), F.sum(F.col("target") * F.col("target")).alias("t2")]
    for c in ("a", "b"):
        x = F.col(c)
        sums += [F.sum(F.abs(x - t)).alias(f"e_{c}"), F.sum((x - t) * (x - t)).alias(f"s_{c}"), F.sum(x).alias(f"p_{c}"), F.count_if(x > 0.5).alias(f"h_{c}"), F.count_if(x > 1).alias(f"o_{c}")]
    stats = base.groupBy("segment", "bin").agg(*sums)
    listed = [F.struct(F.lit("original").alias("method"), F.lit(None).cast("double").alias("threshold"), F.lit(-1).alias("i"), F.lit("a").alias("of"))] if "original" in methods else []
    listed += [F.struct(F.lit(m).alias("method"), F.lit(float(x)).alias("threshold"), F.lit(i).alias("i"), F.lit(m[-1]).alias("of")) for m in methods if m != "original" for i, x in enumerate(thresholds)]
    wide = stats.withColumn("g", F.explode(F.array(*listed))).select("*", "g.*")
    passes = F.col("bin") > F.col("i")
    mine = lambda c: F.when(F.col("of") == "a", F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    up = lambda c: F.sum(F.when(passes, c).otherwise(0))
    down = lambda c: F.sum(F.when(~passes, F.col(c)).otherwise(0))
    found = wide.groupBy("method", "threshold", "segment").agg(
        F.sum("n").alias("count"), F.sum("t").alias("ts"), (down("t") + up(mine("e"))).alias("e"), (down("t2") + up(mine("s"))).alias("s"), up(mine("p")).alias("ps"), up(mine("h")).alias("h"), up(mine("o")).alias("o"), up(F.col("n")).alias("passing"),
    )
    c, ts = F.col("count"), F.col("ts")
    return found.select(
        "method", "threshold", "segment", "count", S.r6(S.ratio(F.col("e"), c)).alias("mae"), S.r6(F.sqrt(S.ratio(F.col("s"), c))).alias("rmse"), S.r6(100 * S.ratio(F.col("e"), ts)).alias("wape"), F.round(ts, 3).alias("target_sum"), F.round("ps", 3).alias("prediction_sum"),
        S.r6(100 * S.ratio(F.col("ps") - ts, ts)).alias("total_bias"), S.r6(S.ratio(F.col("ps"), c)).alias("mean_prediction"), S.r6(S.ratio(F.col("h"), c)).alias("gt_0_5_rate"), S.r6(S.ratio(F.col("o"), c)).alias("gt_1_rate"), S.r6(S.ratio(F.col("passing"), c)).alias("pass_rate"),
    )


def threshold_scores(rows: DataFrame, score: str, label: Column, by: list[str], thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 from each threshold on, and which threshold has the best F1 (the lowest of equals)."""
    y = F.when(label, 1).otherwise(0)
    sums = []
    for i, x in enumerate(thresholds):
        above = F.col(score) >= x
        sums += [F.sum(F.when(above, y).otherwise(0)).alias(f"tp{i}"), F.count_if(above).alias(f"n{i}")]
    found = rows.groupBy(*by).agg(F.sum(y).alias("pos"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("n")) for i, x in enumerate(thresholds)]))
    long = found.select(*by, "pos", each.alias("e")).select(*by, "pos", "e.*")
    f1 = F.coalesce(S.ratio(2.0 * F.col("tp"), F.col("n") + F.col("pos")), F.lit(0.0))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(f1), "threshold")) == 1
    return long.select(*by, "threshold", S.r6(S.ratio(F.col("tp"), F.col("n"))).alias("precision"), S.r6(S.ratio(F.col("tp"), F.col("pos"))).alias("recall"), S.r6(f1).alias("f1"), best.alias("is_best"))


def signal_months(rows: DataFrame, features: list[str], label: Column, weight: Column, fraction: float = 0.1) -> DataFrame:
    """By month and feature: weighted average precision as a ranker of ``label``, and rate and lift among the top ``fraction`` of weight."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = rows.select("month", F.when(label, 1.0).otherwise(0.0).alias("y"), weight.cast("double").alias("w"), each.alias("f")).select("month", "y", "w", "f.*")
    values = long.groupBy("month", "feature", "value").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("all"))
    order = Window.partitionBy("month", "feature").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("month", "feature")
    seen = values.withColumns({"tp": F.sum("pos").over(order), "seen": F.sum("all").over(order), "total": F.sum("all").over(whole), "hits": F.sum("pos").over(whole)})
    # the value at which the weight from the top reaches the fraction
    top = (F.col("seen") - F.col("all")) < fraction * F.col("total")
    sums = seen.groupBy("month", "feature").agg(
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"), F.min(F.when(top, F.col("value"))).alias("threshold"), F.max("hits").alias("hits"), F.max("total").alias("total"), F.sum(F.when(top, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(top, F.col("all")).otherwise(0.0)).alias("n"),
    )
    base, rate = S.ratio(F.col("hits"), F.col("total")), F.coalesce(S.ratio(F.col("tp"), F.col("n")), F.lit(0.0))
    return sums.select("month", "feature", S.r6(S.ratio(F.col("ap"), F.col("hits"))).alias("average_precision"), S.r6(F.col("threshold")).alias("top_decile_threshold"), S.r6(base).alias("base_rate"), S.r6(rate).alias("top_decile_rate"), S.r6(S.ratio(rate, base)).alias("top_decile_lift"))


def error_summary(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Two models beside each other: mean, median, MAE and WAPE."""
    out, medians = [F.count(F.lit(1)).alias("count"), S.r6(F.avg("target")).alias("target_mean")], {"target_median": (F.col("target"), 0.5)}
    for n, c in (("first", first), ("second", second)):
        error = F.abs(F.col(c) - F.col("target"))
        medians[f"{n}_median"] = (F.col(c), 0.5)
        out += [S.r6(F.avg(c)).alias(f"{n}_mean"), S.r6(F.avg(error)).alias(f"{n}_mae"), S.r6(100 * S.ratio(F.sum(error), F.sum("target"))).alias(f"{n}_wape")]
    return rows.groupBy(*by).agg(*out).join(quantiles.wide(rows, by, medians).select(*by, *[S.r6(F.col(c)).alias(c) for c in medians]), by)


def zero_sensitivity(rows: DataFrame, by: list[str], baseline: str) -> DataFrame:
    """Where a candidate's predictions for items that do not sell are too high against the baseline's, with reasons."""
    zero, p = F.col("target") <= 0, F.col("prediction")
    stats = rows.groupBy(*by, "candidate").agg(
        F.avg(F.when(zero, p)).alias("mean_prediction"), F.avg(F.when(zero, F.when(p > 0.5, 1.0).otherwise(0.0))).alias("gt_0_5"), (100 * S.ratio(F.sum(p) - F.sum("target"), F.sum("target"))).alias("bias"),
    )
    base = stats.where(F.col("candidate") == baseline).select(*by, F.col("mean_prediction").alias("baseline_zero_mae"))  # without sales the prediction is the error
    both = stats.join(base, by)
    limit, mean = F.greatest(F.lit(0.1), 1.2 * F.col("baseline_zero_mae")), F.col("mean_prediction")
    reasons = F.concat_ws(
        ",", F.when(mean > limit + 1e-9, "zero_mean_prediction_high"), F.when(F.col("gt_0_5") > 0.05, "zero_false_positive_rate_high"), F.when(F.col("bias") > 20, "total_prediction_overestimated"), F.when(mean > 1.2 * F.col("baseline_zero_mae") + 1e-9, "zero_mae_worse_than_baseline"),
    )
    return both.select(*by, "candidate", S.r6(mean).alias("mean_prediction"), S.r6(F.col("gt_0_5")).alias("gt_0_5_rate"), S.r6(F.col("bias")).alias("total_bias"), S.r6(F.col("baseline_zero_mae")).alias("baseline_zero_mae"), reasons.alias("reasons"), (reasons != "").alias("triggered"))


def business(rows: DataFrame, by: list[str], months: Column) -> DataFrame:
    """Quantity, level and trend quality in one aggregate; levels and trend are those of the monthly mean."""
    t, p, mt, mp = F.col("target"), F.col("prediction"), F.col("target") / months, F.col("prediction") / months
    a, b = S.level(mt), S.level(mp)
    share = lambda mask, of: S.r6(S.ratio(F.count_if(mask & of), F.count_if(of)))
    same_way = F.signum(mt - F.col("current")) == F.signum(mp - F.col("current"))
    every = F.lit(True)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), S.r6(100 * S.ratio(F.sum(F.abs(p - t)), F.sum(t))).alias("wape"), share(a == b, every).alias("accuracy"), share(b >= 1, a >= 1).alias("active_recall"), share(b >= 3, a >= 3).alias("medium_high_or_high_recall"), share(b == 4, a == 4).alias("high_recall"),
        share(b <= 1, a >= 3).alias("severe_under_rate"), share(b >= 3, a <= 1).alias("severe_over_rate"), share(same_way, every).alias("trend_accuracy"),
    )


def against(found: DataFrame, by: list[str], baseline: str, candidate: str) -> DataFrame:
    """Rows of ``complete`` of two candidates side by side: columns b_ and c_."""
    measured = [c for c in found.columns if c not in (*by, "candidate")]
    side = lambda name, letter: found.where(F.col("candidate") == name).select(*by, *[F.col(c).alias(f"{letter}_{c}") for c in measured])
    return side(baseline, "b").join(side(candidate, "c"), by)


def gain(c: str) -> Column:
    """How much an error of the candidate is below the baseline's."""
    return F.col(f"b_{c}") - F.col(f"c_{c}")


def pilot(found: DataFrame, fold: str, baseline: str, candidate: str, wape: float = 0.5, recall: float = 1.0, nonzero: float = 0.5) -> DataFrame:
    """Fold by fold: does a head segment gain without the rest losing; and whether the gain is consistent over the folds."""
    both = against(found, [fold], baseline, candidate)
    passed = ((F.greatest(gain("wape_5_19"), gain("wape_20_plus")) >= wape) | (F.greatest(-gain("recall_5_19"), -gain("recall_20_plus")) >= recall)) & (-gain("wape_nonzero") <= nonzero)
    each = both.select(fold, S.r6(-gain("wape_nonzero")).alias("nonzero_worsening_pp"), S.r6(gain("wape_5_19")).alias("wape5_gain_pp"), S.r6(gain("wape_20_plus")).alias("wape20_gain_pp"), S.r6(-gain("recall_5_19")).alias("recall5_gain_pp"), S.r6(-gain("recall_20_plus")).alias("recall20_gain_pp"), F.coalesce(passed, F.lit(False)).alias("passed"))
    total = each.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("passed")).alias("__passed"))
    status = F.when(F.col("__passed") == F.col("__n"), "consistent_gain").when(F.col("__passed") > 0, "time_conditional").otherwise("no_model_increment")
    return each.crossJoin(F.broadcast(total)).withColumn("status", status).drop("__n", "__passed")  # one row


#: Default limits of the acceptance gates, in percentage points but for the share of the zero total and the number of months.
GATES = {"head_wape": 0.5, "other_wape": 0.5, "head_recall": 1.0, "other_recall": 1.0, "overall_wape": 0.2, "zero_total": 0.05, "zero_rate": 0.5, "bias": 1.0, "macro_f1": 0.2, "months": 4}


def acceptance(found: DataFrame, monthly: DataFrame, baseline: str, candidate: str, gates_: dict = GATES) -> DataFrame:
    """The nine acceptance checks of a candidate, each with its verdict, and ``passed`` for all together."""
    w, r = (gain("wape_5_19"), gain("wape_20_plus")), (-gain("recall_5_19"), -gain("recall_20_plus"))
    months = against(monthly, ["month"], baseline, candidate).agg(F.count_if((gain("wape_20_plus") > 0) | (gain("recall_20_plus") < 0)).alias("months_improved"))
    zero = (F.col("c_prediction_sum_0") <= F.col("b_prediction_sum_0") * (1 + gates_["zero_total"])) & (-100 * gain("zero_gt_0_5") <= gates_["zero_rate"]) & (-100 * gain("zero_gt_1") <= gates_["zero_rate"])
    checks = {
        "one_head_wape_improved": F.greatest(*w) >= gates_["head_wape"], "other_head_wape_protected": F.least(*w) >= -gates_["other_wape"], "one_head_recall_improved": F.greatest(*r) >= gates_["head_recall"], "other_head_recall_protected": F.least(*r) >= -gates_["other_recall"],
        "overall_protected": (-gain("wape_overall") <= gates_["overall_wape"]) & (-gain("integer_wape_overall") <= gates_["overall_wape"]), "zero_protected": zero, "bias_protected": F.abs("c_total_bias") - F.abs("b_total_bias") <= gates_["bias"],
        "mc_protected": -gain("mc_macro_f1") >= -gates_["macro_f1"], "monthly_stable": F.col("months_improved") >= gates_["months"],
    }
    side = lambda name, letter: found.where(F.col("candidate") == name).select(*[F.col(c).alias(f"{letter}_{c}") for c in found.columns if c != "candidate"])
    told = side(baseline, "b").crossJoin(F.broadcast(side(candidate, "c"))).crossJoin(F.broadcast(months)).select("months_improved", *[check.alias(name) for name, check in checks.items()])  # a row each
    return told.withColumn("passed", reduce(lambda a, b: a & b, [F.col(c) for c in checks]))


def compensation_decision(found: DataFrame, by: list[str], baseline: str, candidate: str) -> DataFrame:
    """Whether a compensated head is worth it: gains of the head and protection of everything else."""
    both = against(found, by, baseline, candidate)
    zero = F.coalesce(S.ratio(F.col("c_prediction_sum_0"), F.col("b_prediction_sum_0")) - 1, F.lit(0.0))
    bias = F.abs("c_total_bias") - F.abs("b_total_bias")
    checks = [gain("wape_20_plus") >= 0.5, -gain("recall_20_plus") >= 1.0, -gain("wape_5_19") <= 0.5, -gain("wape_nonzero") <= 0.5, zero <= 0.05, bias <= 1.0]
    names = ["head_wape", "head_recall", "five_nineteen", "nonzero", "zero_total", "total_bias"]
    told = both.select(*by, S.r6(gain("wape_20_plus")).alias("twenty_plus_wape_gain_pp"), S.r6(zero).alias("zero_prediction_total_increase"), S.r6(bias).alias("absolute_bias_worsening_pp"), *[c.alias(n) for n, c in zip(names, checks, strict=True)])
    return told.withColumn("promoted", reduce(lambda a, b: a & b, [F.col(n) for n in names]))


#: Least relative gain of one average precision and most decline of the other; least gains of a head segment and most worsening of what sells.
ADVANCES = {"ap_gain": 0.02, "ap_decline": 0.01, "wape": 0.5, "recall": 1.0, "nonzero": 0.5}


def advancing(ranks: DataFrame, errors: DataFrame, fold: str, baseline: str, limits: dict[str, float] = ADVANCES) -> DataFrame:
    """For each set of features: mean changes against the baseline over the folds, whether it passes by ranking or by errors in all folds, and whether it is selected.

    ``ranks``: (fold, candidate, ap5, ap20), ``errors``: rows of ``complete`` by fold and candidate. A change that cannot be computed does not pass. Of the sets that pass, the one with the
    largest mean gains is selected, by the head's WAPE, then by both average precisions, then by the shorter name.
    """
    kept = ["wape_5_19", "wape_20_plus", "recall_5_19", "recall_20_plus", "wape_nonzero"]
    both = ranks.select(fold, "candidate", "ap5", "ap20").join(errors.select(fold, "candidate", *kept), [fold, "candidate"])
    sides = both.where(F.col("candidate") != baseline).select(fold, "candidate", *[F.col(c).alias(f"c_{c}") for c in ("ap5", "ap20", *kept)])
    base = both.where(F.col("candidate") == baseline).select(fold, *[F.col(c).alias(f"b_{c}") for c in ("ap5", "ap20", *kept)])
    grown = lambda c: S.r6(F.coalesce(S.ratio(F.col(f"c_{c}"), F.col(f"b_{c}")) - 1, F.lit(0.0)))
    each = sides.join(base, fold).select(fold, "candidate", grown("ap5").alias("ap5"), grown("ap20").alias("ap20"), *[S.r6(c).alias(n) for n, c in (("wape5", gain("wape_5_19")), ("wape20", gain("wape_20_plus")), ("recall5", -gain("recall_5_19")), ("recall20", -gain("recall_20_plus")), ("nonzero", -gain("wape_nonzero")))])
    ap5, ap20 = F.col("ap5"), F.col("ap20")
    by_rank = (ap5 >= limits["ap_gain"]) & (ap20 >= -limits["ap_decline"]) | (ap20 >= limits["ap_gain"]) & (ap5 >= -limits["ap_decline"])
    by_error = ((F.greatest("wape5", "wape20") >= limits["wape"]) | (F.greatest("recall5", "recall20") >= limits["recall"])) & (F.col("nonzero") <= limits["nonzero"])
    held = lambda c: F.min(F.coalesce(c, F.lit(False)))
    found = each.groupBy("candidate").agg(F.count(F.lit(1)).alias("folds"), held(by_rank).alias("ap_pass"), held(by_error).alias("q_pass"), *[S.r6(F.avg(c)).alias(f"mean_{n}") for n, c in (("wape20_gain_pp", "wape20"), ("ap20_relative", "ap20"), ("ap5_relative", "ap5"))])
    passed = F.col("ap_pass") | F.col("q_pass")
    order = Window.orderBy(F.desc("passed"), F.desc_nulls_last("mean_wape20_gain_pp"), F.desc_nulls_last("mean_ap20_relative"), F.desc_nulls_last("mean_ap5_relative"), F.length("candidate"), "candidate")  # a row for each set
    return found.withColumn("passed", passed).withColumn("selected", F.col("passed") & (F.row_number().over(order) == 1))
