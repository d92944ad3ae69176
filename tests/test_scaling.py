"""What keeps tasks and passes bounded: parts by input, one pass for several figures, rows that are written once."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfcast.functions import scalars as S
from shelfcast.operators import audit, checks, cleaning, longtail, metrics, models, panel, reports, sampling
from shelfcast.plans import audit as audits
from shelfcast.plans import evaluation, queries
from shelfcast.plans import tables as T
from shelfcast.sources import archives

DATA = "/root/testdata/sf0.001"


def test_month_text(spark):
    rows = spark.createDataFrame([(12 * 2026 + 5,), (12 * 987,), (12 * 10_001 + 11,)], "i int")
    found = rows.select(S.month_text(F.col("i")).alias("m"))
    assert [r.m for r in found.collect()] == ["2026-06", "0987-01", "10001-12"]
    assert "format_string" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_series_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    few = T.months(spark, DATA).agg(F.sum("total_qty"), F.count(F.lit(1))).collect()
    monkeypatch.setattr(T, "TASK_LINES", 500)
    many = T.months(spark, DATA)
    assert many.rdd.getNumPartitions() == -(-n // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert many.agg(F.sum("total_qty"), F.count(F.lit(1))).collect() == few


def test_descriptors_are_carried_before_months_are_filled(spark):
    plan = panel.expand(T.months(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Generate")] and "Window" in plan


@pytest.mark.parametrize("name", ["fc_comp_rules", "fc_comp_fit"])
def test_rules_are_fitted_on_cells(spark, monkeypatch, name):
    seen = []
    fit = audit.compensation_rules
    monkeypatch.setattr(audit, "compensation_rules", lambda rows, by: seen.append(rows) or fit(rows, by))
    assert entry.queries()[name](spark, DATA).count() == 26 * 3
    cells, key = seen[0], ["split", "s5", "s20", "target", "prediction"]
    assert cells.count() == cells.select(*key).distinct().count()
    assert cells.agg(F.sum("w")).first()[0] == T.forecasts(spark, DATA).agg(F.sum(F.col("active_months_last_6m") + 1)).first()[0]


def tables_read(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_ledger_joins_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    figures = lambda rows: rows.agg(F.count(F.lit(1)), F.sum("qty"), F.sum("tsp"), F.count_distinct("item_id")).first()
    few = figures(T.lines(spark, DATA))
    monkeypatch.setattr(T, "TASK_LINES", 500)
    many = T.lines(spark, DATA)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert many.rdd.getNumPartitions() == T.parts(spark, DATA) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert figures(many) == few


def test_months_are_computed_once(spark):
    last = T.months(spark, DATA).agg(F.max("month_idx")).first()[0]
    assert T.last_month(spark, DATA) == last
    for rows in (T.history(spark, DATA), longtail.channels(T.months(spark, DATA)), longtail.buckets(T.months(spark, DATA)), sampling.distribution(queries._stratified(spark, DATA), "target", "gds_ctgry_3_lvel")):
        assert tables_read(rows) == 3  # lines, orders, parts
    assert tables_read(T.active(spark, DATA)) == 5  # and the stores, twice
    assert T.predictions(spark, DATA).select("month").distinct().first().month == T.forecasts(spark, DATA).agg(F.max("month")).first()[0]


def test_last_month_of_lines_that_join_and_of_none(spark, tmp_path):
    for name in ("orders", "part"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    late = lines.limit(1).withColumns({"l_shipdate": F.lit("2030-01-01").cast(dict(lines.dtypes)["l_shipdate"]), "l_orderkey": F.lit(-1).cast(dict(lines.dtypes)["l_orderkey"])})
    lines.unionByName(late).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert T.last_month(spark, str(tmp_path)) == T.last_month(spark, DATA)
    lines.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert T.last_month(spark, str(tmp_path)) is None and T.history(spark, str(tmp_path)).count() == T.predictions(spark, str(tmp_path)).count() == 0


def test_level_of_odd_quantities_uses_them_once(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-3.0,), (0.49,), (0.5,), (1.5,), (4.5,), (19.4,), (19.5,), (1e15,)], "x double")
    assert [r[0] for r in rows.select(S.level(F.col("x"))).collect()] == [0, 0, 0, 0, 0, 1, 2, 3, 3, 4, 4]
    assert rows.select(S.level(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0].count("x#") <= 2


def test_levels_are_counted_by_cells(spark):
    by = ["split", "candidate"]
    old, new = reports.level_counts(evaluation.horizons(spark, DATA), by), reports.level_cells(evaluation.monthly(spark, DATA), ["split"], ["hist", "wma"])
    columns = [*by, "horizon", "true_code", "pred_code", "n"]
    assert sorted(map(tuple, new.select(columns).collect())) == sorted(map(tuple, old.select(columns).collect()))


def test_top_k_ranks_each_forecast_once(spark, monkeypatch):
    by = ["horizon", "candidate", "month", "site_no"]
    old = metrics.top_k(evaluation.horizons(spark, DATA), by, "prediction", "target", (1, 3))
    monkeypatch.setattr(T, "TASK_LINES", 500)
    new = metrics.top_k_horizons(T.dealt(spark, DATA, evaluation.monthly(spark, DATA), "month", "site_no"), ["month", "site_no"], ["hist", "wma"], {1: "future_qty_1m", 2: "future_qty_2m"}, (1, 3))
    assert new.columns == old.columns and sorted(map(str, new.collect())) == sorted(map(str, old.collect()))
    assert tables_read(new) == 3


def test_shift_of_weights_is_the_shift_of_the_sample(spark):
    rows = T.forecasts(spark, DATA)
    old = checks.distribution_shift(rows, queries._stratified(spark, DATA), ["month", "site_no"])
    new = checks.weight_shift(rows, F.lit(1.0), sampling.sample_weight("target", sampling.RATES), ["month", "site_no"])
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_small_members_of_an_archive_are_read_together(spark, tmp_path):
    folder = str(tmp_path / "z")
    archives.write_zipped_csv(spark.range(100).select(F.col("id").alias("k")).repartition(2), folder, lines=10)
    found = archives.read_zipped_csv(spark, folder, ["k"], together=archives.TASK_BYTES)
    assert found.rdd.getNumPartitions() == 2 and sorted(int(r.k) for r in found.collect()) == list(range(100))
    assert found.select(*archives.ORIGIN).distinct().count() == 10
    for together in (0, 1):
        assert [len(m.names) for m in archives.MemberReader(folder, ["k"], archives.ENCODINGS, together).partitions()] == [1] * 10


def test_long_tail_is_one_pass(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.6), ("a", 0.0, 2.0), ("a", 7.0, 5.0), ("b", 3.0, 3.0)], "k string, target double, prediction double")
    found = metrics.long_tail(rows, ["k"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    by = {(r.k, r.segment): r for r in found.collect()}
    zero = by["a", "0"]
    assert (zero["count"], zero.mean_prediction, zero.prediction_gt_0_5_rate, zero.prediction_gt_1_rate, zero.wape) == (2, 1.3, 1.0, 0.5, None)
    assert by["a", "ge_5"].mean_prediction is None and by["a", "ge_5"].wape is not None and ("b", "0") not in by


def test_models_read_written_rows(spark):
    train, test = queries._model_rows(spark, DATA)
    for rows in (train, test):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
    assert train.count() + test.count() == T.forecasts(spark, DATA).where("split <> 'valid'").count()


def test_split_points():
    assert models.split_points([3.0, 1.0, 1.0, 2.0]) == [1.5, 2.5]
    many = models.split_points([0.0] * 700 + [float(i) for i in range(1, 301)])
    assert len(many) == 31 and many == sorted(set(many)) and many[0] == 0.5


def test_boosted_trees_on_cells_equal_those_on_rows(spark):
    rows = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    rows = rows.withColumn("label", F.when(F.col("a") + F.col("b") > 5, 1.0).otherwise(0.0))
    learner = lambda: GBTRegressor(maxIter=3, maxDepth=3, seed=1)
    whole = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    want = {(r.a, r.b): r.prediction for r in learner().fit(whole).transform(whole).collect()}
    sizes = []
    plain = models.staged
    models.staged = lambda df, name: sizes.append(df.count()) or plain(df, name)
    try:
        found = {(r.a, r.b): r.prediction for r in models.boosted(learner(), rows, rows, ["a", "b"]).collect()}
    finally:
        models.staged = plain
    assert sizes == [21] and found == pytest.approx(want)


@pytest.mark.parametrize("groups", [0, 1_000_000])
def test_audited_rows_read_the_ledger_once(spark, monkeypatch, groups):
    old = panel.cross_features(panel.differences(T.dataset(spark, DATA)), cleaning.cross_store(T.months(spark, DATA))).where("split = 'train'")
    monkeypatch.setattr(audits, "BROADCAST_GROUPS", groups)
    new = audits.featured(spark, DATA)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "l_orderkey" not in plan and ("Join" in plan) == ("broadcast" in plan) == (groups > 0)
    names = ["future_qty_1m", *audits.EXISTING, *audits.DIFF, *audits.CROSS]
    assert sorted(map(tuple, new.select("month", *names).collect())) == sorted(map(tuple, old.select("month_idx", *names).collect()))


def mean_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


@pytest.mark.parametrize("most", [0, 8, 4_000_000])
def test_rank_correlations_of_odd_values(spark, monkeypatch, most):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, 1, 5.0), (None, 1.0, 1, 5.0), (nan, 3.0, 2, 5.0), (inf, 3.0, 2, 5.0), (-0.0, 0.0, 3, 5.0), (0.1 + 0.2, 4.0, 3, 5.0), (0.3, -1.0, 9, 5.0), (-2.5, 7.0, None, 5.0)]
    df = spark.createDataFrame([(*r, "m", r[1]) for r in rows], "a double, b double, c int, d double, month string, t double")
    clean = lambda x: 0.0 if x is None or x != x or abs(x) == inf else round(x, 6)
    ranks = {n: mean_ranks([clean(r[i]) for r in rows]) for i, n in enumerate("abcd")}

    def corr(x, y):
        x, y = ([v - sum(z) / len(z) for v in z] for z in (x, y))
        spread = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
        return sum(v * w for v, w in zip(x, y, strict=True)) / spread if spread else None

    monkeypatch.setattr(audit, "BROADCAST_VALUES", most)
    raw = audit._counted(df, list("abcd"), [], [])
    counts = raw.withColumn("value", F.coalesce(audit._clean(F.col("raw")), F.lit(0.0)))
    found = {(r.feature, r.existing): r.correlation for r in audit.rank_correlations(df, counts, ["a", "d"], ["b", "c"]).collect()}
    assert found == {(x, y): pytest.approx(corr(ranks[x], ranks[y])) if x == "a" else None for x in "ad" for y in "bc"}
    shape = {r.feature: r for r in audit.audit(df, {"g": ["a", "d"]}, ["b", "c"], {"x": F.col("t") >= 3}).collect()}
    assert (shape["a"].missing_share, shape["a"].zero_share, shape["a"].low, shape["a"].high, shape["a"].modal_share) == (0.375, 0.125, -2.5, 1.0, 0.5)
