"""Learned forecasts on spark.ml: two-stage, tree regression, head classifiers and direct level classification.

Numbers follow from Spark's own learners; rows are keyed by (month, site_no, item_id). All learn from all training rows as weighted
cells: rows of equal features and label count once, with their number as weight. The trees of a forest draw rows with repetition: of the
n rows of a cell, which are all alike, each tree draws as many as n rows would be drawn together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import checks
from shelfcast.sources.staging import staged

FEATURES = ["current", "qty_lag_1m", "qty_lag_2m", "qty_lag_3m", "qty_mean_last_3m", "active_months_last_6m", "months_since_last_sale"]


def assembled(rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """``rows`` with a vector of finite features; targets and ids are refused."""
    checks.refuse_leaks(features)
    clean = rows.withColumns({f"__{c}": S.finite(F.col(c)) for c in features})
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features").transform(clean).drop(*[f"__{c}" for c in features])


#: Rows that decide on the split points of trees, and the most bins of a feature; both are the learners' own.
SPLIT_ROWS, BINS = 10_000, 32


def split_points(values: list[float], bins: int = BINS) -> list[float]:
    """Points between sampled values: between all different ones if these are few, else wherever about another ``bins``-th of the values has passed."""
    counts = sorted(Counter(values).items())
    middles = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:], strict=False)]
    if len(middles) < bins:
        return middles
    step = len(values) / bins
    points, seen, wanted = [], 0, step
    for middle, (_, n), (_, after) in zip(middles, counts, counts[1:], strict=False):
        seen += n
        if abs(seen - wanted) < abs(seen + after - wanted) and len(points) < bins - 1:
            points.append(middle)
            wanted += step
    return points


def draws(n: Column, key: list[str], times: int) -> Column:
    """How many of ``n`` rows that are all alike are drawn with repetition, ``times`` times anew, if a row is drawn once on average: Poisson numbers that the ``key`` decides, not the order of rows."""

    def drawn(keys: pa.Array, means: pa.Array) -> pa.Array:
        bits = np.random.Philox(key=0)
        start, numbers, found = bits.state, np.random.Generator(bits), np.empty((len(keys), times), np.int64)
        for i, (key, mean) in enumerate(zip(keys.to_numpy().view(np.uint64), means.to_numpy(), strict=True)):
            start["state"]["key"][0] = key
            bits.state = start  # a new generator for each key would take longer
            found[i] = numbers.poisson(mean, times)
        return pa.array(list(found), pa.list_(pa.int64()))

    return F.arrow_udf(drawn, "array<bigint>")(F.xxhash64(*key), n.cast("double"))


def binned(train: DataFrame, features: list[str], weight: str | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], list[str]]:
    """Training rows (of which ``weight`` are alike) as weighted cells of equal bins and ``label``, what adds ``bins`` to rows, and the bins' names.

    Features are cut at the split points of a sample, as a learner of trees would, so that trees cannot tell rows of equal bins apart. Bins are
    numbers, not the categories that ``Bucketizer`` makes them: trees split numbers by order, categories into any two sets.
    """
    checks.refuse_leaks(features)
    names = [f"__{c}" for c in features]
    numbers = lambda d: d.withColumns({f"__{c}": S.finite(F.col(c)) for c in features})
    total = train.agg(F.sum(weight)).first()[0] or 0 if weight else train.count()
    share = SPLIT_ROWS / max(total, 1)  # about SPLIT_ROWS rows are sampled
    if weight:
        alike = numbers(train).groupBy(*names).agg(F.sum(weight).alias("__n"))
        picked = (alike.withColumn("__n", draws(F.col("__n") * share, names, 1)[0]) if share < 1 else alike).where("__n > 0").collect()
        sample = [r for r in picked for _ in range(int(r["__n"]))]
    else:
        sample = numbers(train.sample(share, 1) if share < 1 else train).select(*names).collect()
    splits = [[-float("inf"), *(split_points([r[n] for r in sample]) or [0.0]), float("inf")] for n in names]
    cut = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"{n}_bin" for n in names])
    keys = [f"{n}_bin" for n in names]
    binning = lambda d: cut.transform(numbers(d)).withColumns({k: F.col(k).cast("int") for k in keys})
    cells = binning(train).groupBy(*keys, "label").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("weight"))
    bins = VectorAssembler(inputCols=keys, outputCol="bins")
    return cells, lambda d: bins.transform(d if set(keys) <= set(d.columns) else binning(d)), [*names, *keys]


def boosted(learner, train: DataFrame, rows: DataFrame, features: list[str] = FEATURES, weight: str | None = None) -> DataFrame:
    """``rows`` with the learner's outputs, fitted on the cells of ``label``."""
    cells, bins, names = binned(train, features, weight)
    model = learner.setFeaturesCol("bins").setLabelCol("label").setWeightCol("weight").fit(bins(staged(cells, "cells")))
    return model.transform(bins(rows)).drop("bins", *names)


#: Trees of a forest, and how many of them are grown at once.
TREES, AT_ONCE = 20, 4


def forest(learner, train: DataFrame, rows: DataFrame, features: list[str] = FEATURES, weight: str | None = None, trees: int = TREES) -> DataFrame:
    """``rows`` with ``trees``, what each tree says: the probabilities of the classes, or a number.

    Each tree has its own draw of all training rows and its own seed. A tree that draws no row, which only few rows can bring about, has all of them.
    """
    cells, bins, names = binned(train, features, weight)
    own, probable = [f"__drawn_{t}" for t in range(trees)], learner.hasParam("probabilityCol")
    keys = [*(n for n in names if n.endswith("_bin")), "label"]
    drawn = staged(cells.withColumn("__drawn", draws(F.col("weight"), keys, trees)).select(*keys, "weight", *[F.col("__drawn")[t].cast("double").alias(c) for t, c in enumerate(own)]), "drawn")
    none = drawn.agg(*[F.sum(c).alias(c) for c in own]).first()
    classes = {"ml_attr": {"type": "nominal", "num_vals": max(S.LEVELS.values()) + 1}} if probable else {}

    def grown(t: int):
        of = bins(drawn).select("bins", F.col("label").alias("label", metadata=classes), F.col(own[t] if none[own[t]] else "weight").alias("weight")).where("weight > 0")
        outputs = {learner.probabilityCol: f"__tree_{t}", learner.rawPredictionCol: "", learner.predictionCol: ""} if probable else {learner.predictionCol: f"__tree_{t}"}
        given = {learner.featuresCol: "bins", learner.labelCol: "label", learner.weightCol: "weight", learner.seed: t + 1, learner.numTrees: 1, learner.bootstrap: False}
        return learner.copy(given | outputs).fit(of)

    with ThreadPool(AT_ONCE) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(grown), range(trees))
    found = reduce(lambda d, m: m.transform(d), models, bins(rows))
    said = [F.col(f"__tree_{t}") for t in range(trees)]
    return found.withColumn("trees", F.array(*map(vector_to_array, said) if probable else said)).drop("bins", *names, *[f"__tree_{t}" for t in range(trees)])


def two_stage(train: DataFrame, rows: DataFrame, target: str = "target", power: float = 1.4, iterations: int = 8) -> DataFrame:
    """Probability of a sale, quantity given a sale (Tweedie, on selling rows alone), and their product."""
    labelled = train.withColumn("label", F.when(F.col(target) > 0, 1.0).otherwise(0.0))
    cells = train.where(F.col(target) > 0).groupBy(*FEATURES, target).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    stage2 = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, maxIter=25, regParam=0.01, labelCol=target, weightCol="weight", predictionCol="conditional").fit(assembled(staged(cells, "cells")))
    scored = boosted(GBTClassifier(maxIter=iterations, maxDepth=4, seed=1), labelled, rows).withColumn("p_sale", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    found = stage2.transform(scored)
    return found.withColumn("prediction", F.least(F.greatest("p_sale", F.lit(0.0)), F.lit(1.0)) * S.clip_target(F.col("conditional")))


def tree_regression(train: DataFrame, rows: DataFrame, kind: str = "boosted", target: str = "target", weight: str | None = None) -> DataFrame:
    """Trees on the logarithm of the target, back-transformed and clipped."""
    labelled = train.withColumn("label", F.log1p(S.clip_target(F.col(target))))
    if kind == "boosted":
        found = boosted(GBTRegressor(maxIter=8, maxDepth=4, seed=1, predictionCol="raw"), labelled, rows, weight=weight)
    else:
        said = forest(RandomForestRegressor(maxDepth=6, featureSubsetStrategy="onethird"), labelled, rows, weight=weight)
        found = said.withColumn("raw", F.aggregate("trees", F.lit(0.0), lambda a, x: a + x) / F.size("trees")).drop("trees")
    return found.withColumn("prediction", S.clip_target(F.expm1("raw")))


def head_classifier(train: DataFrame, rows: DataFrame, least: float, target: str = "target") -> DataFrame:
    """Probability that the target reaches ``least``."""
    found = boosted(GBTClassifier(maxIter=8, maxDepth=4, seed=1), train.withColumn("label", F.when(F.col(target) >= least, 1.0).otherwise(0.0)), rows)
    return found.withColumn("score", vector_to_array("probability")[1])


def direct_level(train: DataFrame, rows: DataFrame, target: str = "target", weight: str | None = None) -> DataFrame:
    """The demand level as a class of its own, with the probability of the true one."""
    labelled = train.withColumn("label", S.level(F.col(target)).cast("double"))
    said = forest(RandomForestClassifier(maxDepth=6, featureSubsetStrategy="sqrt"), labelled, rows, weight=weight)
    none = F.array_repeat(F.lit(0.0), max(S.LEVELS.values()) + 1)
    found = said.withColumn("sums", F.aggregate("trees", none, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    found = found.withColumn("direct", (F.array_position("sums", F.array_max("sums")) - 1).cast("int"))
    return found.withColumn("p_true", F.element_at("sums", S.level(F.col(target)) + 1) / F.size("trees")).drop("trees", "sums")


def level_logloss(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return rows.groupBy(*by).agg((F.sum(-F.log(F.greatest("p_true", F.lit(1e-15))) * w) / F.sum(w)).alias("logloss"), F.sum(w).cast("long").alias("count"))
