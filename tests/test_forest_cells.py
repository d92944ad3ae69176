"""Forests on weighted cells: what they are fitted on, how rows are drawn, and that metrics of cells are those of rows."""

import math

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import metrics, models
from shelfcast.plans import queries
from shelfcast.plans import tables as T

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def fitted(monkeypatch):
    """Rows that each fit of a forest is given."""
    sizes = []
    for learner in (RandomForestRegressor, RandomForestClassifier):
        plain = learner.fit
        monkeypatch.setattr(learner, "fit", lambda self, rows, *a, plain=plain: sizes.append(rows.count()) or plain(self, rows, *a))
    return sizes


def test_tree_regression_reads_cells_and_counts_rows(spark, fitted):
    found = {r.kind: r for r in queries.ml_tree_reg(spark, DATA).collect()}
    rows = T.forecasts(spark, DATA)
    test = rows.where("split = 'test'").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("t")).first()
    assert {k: (r["count"], r.target_sum) for k, r in found.items()} == {k: (test.n, test.t) for k in ("boosted", "forest")}
    assert 0 < max(fitted) < rows.where("split = 'train'").count() / 2


def test_forest_is_one_of_rows(spark):
    rows = spark.range(6000).select(F.pmod(F.hash("id"), F.lit(7)).cast("double").alias("a"), F.pmod(F.hash("id", F.lit(1)), F.lit(5)).cast("double").alias("b"), F.pmod(F.hash("id", F.lit(2)), F.lit(3)).cast("double").alias("noise"))
    rows = rows.withColumn("label", F.col("a") * F.col("b") + F.col("noise")).withColumn("c", F.col("a") % 2)
    names = ["a", "b", "c"]
    cells = rows.groupBy(*names, "label").agg(F.count(F.lit(1)).alias("n"))
    whole = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    want = {tuple(r[n] for n in names): r.prediction for r in RandomForestRegressor(numTrees=100, maxDepth=6, seed=1).fit(whole).transform(whole).collect()}
    said = models.forest(RandomForestRegressor(maxDepth=6, featureSubsetStrategy="onethird"), cells, cells, names, "n").collect()
    found = {tuple(r[n] for n in names): sum(r.trees) / len(r.trees) for r in said}
    assert {len(r.trees) for r in said} == {models.TREES} and any(r.trees[0] != r.trees[1] for r in said)
    assert set(found) == set(want) and sum(abs(found[k] - want[k]) for k in want) / len(want) < 1.0  # labels go up to 26


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_bins_are_split_by_order(spark, kind):
    rows = spark.range(600).select((F.col("id") % 6).cast("double").alias("a")).withColumn("label", F.col("a") % 2)
    whole = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    own = DecisionTreeRegressor(maxDepth=1, seed=1).fit(whole).transform(whole)
    if kind == "boosted":
        found = models.boosted(DecisionTreeRegressor(maxDepth=1, seed=1), rows, rows, ["a"])
        assert dict(found.select("a", "prediction").collect()) == dict(own.select("a", "prediction").collect())
    else:
        said = models.forest(RandomForestRegressor(maxDepth=1, featureSubsetStrategy="onethird"), rows.withColumn("n", F.lit(1)), rows, ["a"], "n")
        for t in range(models.TREES):  # one threshold: low ones are alike, and high ones are
            found = dict(said.select("a", F.col("trees")[t]).collect())
            assert sum(found[float(i)] != found[float(i + 1)] for i in range(5)) <= 1


def test_draws_are_those_of_rows_and_hang_on_the_key_alone(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1000, 400).otherwise(1).alias("n"))
    found = rows.repartition(3).withColumn("d", models.draws(F.col("n"), ["id"], 5))
    again = rows.orderBy(F.desc("id")).withColumn("d", models.draws(F.col("n"), ["id"], 5))
    assert {r.id: r.d for r in found.collect()} == {r.id: r.d for r in again.collect()}
    for n in (400, 1):
        drawn = [x for r in found.where(F.col("n") == n).collect() for x in r.d]
        mean = sum(drawn) / len(drawn)
        assert abs(mean - n) < 5 * math.sqrt(n / len(drawn)) and 0.85 * n < sum((x - mean) ** 2 for x in drawn) / len(drawn) < 1.15 * n  # one draw for a whole cell has n * n


def test_split_points_of_cells_are_weighted(spark):
    rows = spark.createDataFrame([(float(v), 0.0, 50_000 if v == 0 else 500) for v in range(101)], "a double, label double, n long")
    _, bins, _ = models.binned(rows, ["a"], "n")
    by = {r.a: r.bins[0] for r in bins(rows).collect()}
    assert by[0.0] == 0 and by[1.0] == 1 and 12 < len(set(by.values())) <= models.BINS


def test_tree_without_draws_has_all_rows(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 1)], "a double, label double, n long")
    found = models.forest(RandomForestRegressor(maxDepth=2, featureSubsetStrategy="onethird"), rows, rows, ["a"], "n").first().trees
    assert found == [3.0] * models.TREES


def test_model_cells_are_all_rows(spark):
    rows = T.forecasts(spark, DATA).where("split <> 'valid'").select("split", "target", "hist", *models.FEATURES)
    cells = [p.collect() for p in queries._model_cells(spark, DATA, "hist")]
    columns = rows.columns
    found = sorted(tuple(r[c] for c in columns) for p in cells for r in p for _ in range(r.rows))
    assert found == sorted(map(tuple, rows.collect())) and len(set(found)) == sum(map(len, cells))


def test_metrics_of_cells_are_those_of_rows(spark):
    cells = spark.createDataFrame([("test", 0.0, 0, 1, 0.5, 3), ("test", 7.0, 3, 1, 0.25, 2), ("test", 30.0, 4, 4, 0.0, 1)], "split string, target double, first int, direct int, p_true double, rows long")
    rows = cells.withColumn("one", F.explode(F.sequence(F.lit(1), "rows")))
    args = F.col("first"), F.col("direct"), ["split"]
    assert sorted(map(tuple, metrics.disagreement(cells, *args, F.col("rows")).collect())) == sorted(map(tuple, metrics.disagreement(rows, *args).collect()))
    a, b = models.level_logloss(cells, ["split"], F.col("rows")).first(), models.level_logloss(rows, ["split"]).first()
    assert a["count"] == b["count"] == 6 and a.logloss == pytest.approx(b.logloss) == pytest.approx((3 * math.log(2) + 2 * math.log(4) + 15 * math.log(10)) / 6)


def test_direct_levels_read_cells_and_count_rows(spark, fitted):
    found = queries.ml_mc_direct(spark, DATA).collect()
    rows = T.forecasts(spark, DATA)
    n = rows.where("split = 'test'").count()
    assert {r["count"] for r in found} == {n} == {sum(r.n for r in found)}
    assert 0 < max(fitted) < rows.where("split = 'train'").count() / 2


def test_levels_that_no_row_has_get_a_probability(spark):
    train = spark.createDataFrame([(float(i % 4), float(i % 2), 10) for i in range(8)], "a double, target double, rows long")
    train = train.select("*", *[F.col("a").alias(c) for c in models.FEATURES])
    found = models.direct_level(train, train.withColumn("target", F.lit(50.0)), weight="rows").collect()
    assert {r.p_true for r in found} == {0.0} and {r.direct for r in found} == {0, 1}
    right = models.direct_level(train, train, weight="rows").where(F.col("direct") == S.level(F.col("target"))).count()
    assert right == train.count()
