"""Literal cases of the retail operators."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import scalars as S
from shelfcast.operators import checks, cleaning, encoding, forecast, longtail, metrics, panel, quantiles, reports, sampling, selection, serving
from shelfcast.sources import archives
from shelfcast.sources import ledger as sources

RAW = "period string, site_no string, blt_site_no string, isbn string, gds_no string, gds_ctgry_3_lvel string, oln_or_ofln string, rtn_flag string, qty string, price string, tlp string, tsp string, cust_name string"


def raw(spark, *rows):
    base = {"period": "2023-01-02", "site_no": "S1", "blt_site_no": None, "isbn": "I", "gds_no": "G", "gds_ctgry_3_lvel": "c", "oln_or_ofln": "ofln", "rtn_flag": None, "qty": "1", "price": "10", "tlp": "10", "tsp": "9", "cust_name": "x"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RAW)


def column(df, name, order=None):
    return [r[0] for r in (df.orderBy(order) if order else df).select(name).collect()]


def test_clean_and_counts(spark):
    from pyspark.sql import Observation

    seen = Observation("clean")
    lines = cleaning.clean(raw(spark, {"isbn": "9780001"}, {"isbn": "", "gds_no": "G2"}, {"isbn": None, "gds_no": ""}, {"qty": "bad", "rtn_flag": "1"}, {"period": "no date"}), seen)
    assert "cust_name" not in lines.columns
    rows = lines.collect()
    assert [r.item_id for r in rows] == ["9780001", "G2", "I"] and rows[2].qty == 0 and rows[2].is_return
    assert seen.get == {"input_rows": 5, "output_rows": 3, "dropped_rows": 2}


def test_channels(spark):
    rows = spark.createDataFrame([(v,) for v in ("ofln", " Offline", "线下", "oln", "ONLINE", "线上", "other", None)], "v string")
    assert column(rows, S.channel(F.col("v"))) == ["offline"] * 3 + ["online"] * 3 + ["unknown"] * 2


def test_daily_and_monthly(spark):
    lines = cleaning.clean(raw(spark, {"qty": "3", "tsp": "27", "tlp": "30"}, {"qty": "-1", "tsp": "-9", "tlp": "-10"}, {"qty": "2", "oln_or_ofln": "oln", "tsp": "15", "tlp": "20"}, {"qty": "1", "period": "2023-01-05", "tsp": "9"}, {"isbn": "Z", "qty": "2"}, {"isbn": "Z", "qty": "-2", "tlp": "-10", "tsp": "-9"}))
    day = cleaning.daily(lines).where("item_id = 'I' AND period = '2023-01-02'").first()
    assert (day.total_qty, day.offline_qty, day.online_qty, day.sales_count, day.return_count, day.return_qty) == (4, 2, 2, 3, 1, 1)
    month = {r.item_id: r for r in cleaning.monthly(cleaning.daily(lines)).collect()}
    assert (month["I"].total_qty, month["I"].sales_days, month["I"].avg_real_price, month["I"].discount_rate) == (5, 2, 42 / 5, 42 / 50)
    assert month["Z"].avg_real_price is None and month["Z"].discount_rate is None


def months(spark, *rows):
    """rows: (site, item, 'yyyy-MM', qty)"""
    return cleaning.monthly(cleaning.daily(cleaning.clean(raw(spark, *[{"site_no": s, "isbn": i, "period": f"{m}-03", "qty": str(q)} for s, i, m, q in rows]))))


def test_panel_history_and_targets(spark):
    m = months(spark, ("S1", "A", "2023-01", 2), ("S1", "A", "2023-03", 5), ("S1", "A", "2023-04", 7))
    rows = panel.history(panel.expand(m))
    assert column(rows, "total_qty", "month_idx") == [2, 0, 5, 7]
    found = panel.targets(rows, "2025-06", "2025-12").orderBy("month_idx").collect()
    assert [(r.qty_lag_1m, r.qty_sum_last_3m, r.future_qty_1m, r.future_qty_2m) for r in found] == [(0, 0, 0, 5), (2, 2, 5, 12)]
    assert found[1].zero_sales_months_last_3m == 0 and found[0].months_since_last_sale == -1 and found[1].months_since_last_sale == 1
    april = rows.where("month = '2023-04'").first()
    assert april.qty_mean_last_3m == 7 / 3 and math.isclose(april.qty_std_last_3m, math.sqrt(19 / 3)) and april.zero_sales_months_last_3m == 1
    single = panel.expand(months(spark, ("S1", "A", "2026-06", 3)))
    assert single.count() == 1 and panel.targets(panel.history(single), "2025-06", "2025-12").count() == 0


def test_active_store(spark):
    m = months(spark, ("S1", "A", "2023-01", 2), ("S1", "A", "2023-03", 7), ("S2", "A", "2023-05", 1))
    act = cleaning.store_activity(m)
    one = act.where("site_no = 'S1'").first()
    assert (one.active_months, one.span_months, one.gap_months) == (2, 3, 1)
    rows = panel.active_dataset(panel.expand(m, act), act, "2025-06", "2025-12").where("site_no = 'S1'").orderBy("month_idx").collect()
    assert [(r.month, r.future_qty_1m, r.future_qty_2m, r.target_available_2m, r.target_mc_2m) for r in rows] == [("2023-01", 0, 7, 1, 2), ("2023-02", 7, None, 0, -1)]
    assert [r.site_no for r in cleaning.closures(act).collect()] == ["S1"]
    assert cleaning.closure_differences(cleaning.closures(act), cleaning.closures(act)).count() == 0
    reason = spark.createDataFrame([(i,) for i in (7, 6, 5, 4)], "m int").select(panel.exclusion_reason(F.col("m"), F.lit(6)))
    assert [r[0] for r in reason.collect()] == ["after_closure", "cross_1m", "cross_2m_extra", "unaffected"]


def test_differences(spark):
    rows = spark.createDataFrame([(8.0, 5.0, 2.0, 12.0, 18.0, 4, 2, 4, 2), (8.0, 5.0, 2.0, 12.0, 18.0, 4, 2, 1, 4)], "total_qty double, qty_lag_1m double, qty_lag_2m double, qty_sum_last_3m double, qty_sum_last_6m double, sales_days int, sales_days_lag_1m int, active_months_last_6m int, zero_sales_months_last_6m int")
    a, b = panel.differences(rows).collect()
    assert (a.qty_diff_current_lag1, a.qty_diff_lag1_lag2, a.sales_days_diff_current_lag1, a.qty_diff_recent3_previous3, a.qty_diff_6m_history_available) == (3, 3, 2, 2, 1)
    assert math.isclose(a.log_qty_diff_current_lag1, math.log1p(8) - math.log1p(5)) and (b.qty_diff_recent3_previous3, b.qty_diff_6m_history_available) == (0, 0)


def test_cross_store(spark):
    side = spark.createDataFrame([(10, "A", 10.0, 2), (9, "A", 3.0, 2), (8, "B", 5.0, 1)], "month_idx int, item_id string, group_positive_qty double, group_positive_sites long")
    rows = spark.createDataFrame([(10, "A", 4.0, 1.0, 0.0), (8, "B", 5.0, 0.0, 0.0)], "month_idx int, item_id string, total_qty double, qty_lag_1m double, qty_lag_2m double")
    a, b = panel.cross_features(rows, side).orderBy("item_id").collect()
    assert (a.xstore_qty_current, a.xstore_positive_sites_current, a.xstore_qty_per_positive_site_current, a.xstore_qty_diff_1m, a.xstore_qty_max_last_3m) == (6, 1, 6, 4, 6)
    assert b.xstore_qty_current == 0 and b.xstore_qty_per_positive_site_current == 0


def test_inference_and_readiness(spark):
    rows = [(s, i, f"2026-{m:02d}", 1 + m) for s in ("S1", "S2") for i in ("A", "B") for m in range(1, 7)] + [("S1", "A", "2025-12", 1)]
    m = months(spark, *rows)
    found = panel.inference_rows(m, "2026-07")
    assert found.count() == 4 and set(column(found, "month")) == {"2026-06"} and not [c for c in found.columns if c.startswith("future")]
    found = {r.scope: r for r in reports.readiness(m, "2026-07", [["qty_lag_1m"], ["qty_lag_6m", "qty_sum_last_3m"], ["qty_lag_6m", "active_months_last_6m"]]).collect()}
    assert (found["S2"].status, found["S2"].missing_months, found["S2"].n_missing, found["S2"].affected_features) == ("DataNotReady", "2025-12", 1, "qty_lag_6m,active_months_last_6m")
    assert {found[k].status for k in ("all", "S1")} == {"READY"} and found["all"].observation_month == "2026-06"


def test_buckets_and_levels(spark):
    value = lambda c, *v: [r[0] for r in spark.createDataFrame([(float(x),) for x in v], "x double").select(c(F.col("x"))).collect()]
    assert value(S.demand_bucket, 0, 1, 2, 5, 6, 20, 21) == ["0", "1", "2-5", "5-20", "5-20", "20+", "20+"]
    assert value(S.longtail_bucket, -1, 1, 1.5, 5, 20, 21) == ["0", "1", "2-5", "2-5", "5-20", "20+"]
    assert value(S.level, -1, 0.49, 0.5, 1.49, 1.5, 4.49, 4.5, 19.49, 19.5) == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    assert value(lambda x: S.level(x, 2), 0, 1, 2, 3, 4, 9, 10, 39, 40) == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert value(S.clip_target, "nan", "inf", "-inf", -2, 3) == [0, 0, 0, 0, 3]
    assert value(lambda x: S.level(x, levels={0: 7, 3: 8}), -2, 2.4, 2.5) == [7, 7, 8]
    assert math.isclose(spark.range(1).select(S.hash_uniform("a")).first()[0], 0.0498269632816, abs_tol=1e-12)


def judged(spark, *rows):
    return metrics.cleaned(spark.createDataFrame([tuple(map(float, r)) for r in rows], "t double, p double"), "t", "p")


def test_quantity_metrics(spark):
    assert (metrics.quantity(judged(spark, (0, 0)), []).first().wape, metrics.quantity(judged(spark, (0, 1)), []).first().wape) == (0, math.inf)
    rows = judged(spark, (0, 0), (0, 2), (1, 1.5), (5, 4), (20, 18), (25, 30))
    found = {r.segment: r for r in metrics.long_tail(rows.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert (found["overall"].target_sum, found["overall"].prediction_sum, found["nonzero"]["count"], found["ge_5"]["count"], found["ge_20"]["count"]) == (51, 55.5, 4, 3, 2)
    assert (found["0"].mean_prediction, found["0"].prediction_gt_0_5_rate, found["0"].prediction_gt_1_rate, found["0"].wape) == (1, 0.5, 0.5, None)


def test_levels_and_trend(spark):
    rows = judged(spark, (0, 0), (1, 6), (2, 2), (6, 1), (21, 20)).withColumn("g", F.lit(1))
    found = reports.level_summary(reports.level_counts(rows.withColumn("horizon", F.lit(1)), ["g"]), ["g", "horizon"]).first()
    assert (found.accuracy, found.active_recall, found.medium_high_or_high_recall, found.high_recall, found.severe_under_rate, found.severe_over_rate) == (0.6, 1, 0.5, 1, 0.5, 0.5)
    trend = metrics.trend(spark.createDataFrame([(1, 1.0, 2.0, 2.0), (1, 2.0, 2.0, 1.0), (1, 3.0, 1.0, 4.0)], "g int, current double, target double, prediction double"), ["g"]).first()
    assert (trend.trend_accuracy, trend.severe_direction_error_rate) == (0.333333, 0.333333)
    matrix = metrics.confusion(rows, S.level(F.col("target")), S.level(F.col("prediction")), ["g"])
    assert matrix.count() == 25 and metrics.classification(matrix, ["g"]).first().accuracy == 0.6


def test_gate_sweep_is_brute_force(spark):
    rows = list(zip((0, 0, 1, 3, 8, 25), (0.02, 0.4, 0.1, 0.3, 0.7, 0.9), (1, 2, 2, 4, 9, 30), strict=True))
    taus = [0.05, 0.2, 0.5, 0.8]
    found = metrics.gate_sweep(spark.createDataFrame([tuple(map(float, r)) for r in rows], "target double, p double, q double"), taus)
    for r in found.where("segment = 'overall'").collect():
        a = sum(abs((p * q if p >= r.threshold else 0) - t) for t, p, q in rows)
        b = sum(abs((q if p >= r.threshold else 0) - t) for t, p, q in rows)
        assert math.isclose(r.wape_gate_a, 100 * a / 37, abs_tol=1e-5) and math.isclose(r.wape_gate_b, 100 * b / 37, abs_tol=1e-5)
        assert r.passing == sum(p >= r.threshold for _, p, _ in rows)


def test_disagreement(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 1, 2), (2, 1, 2), (2, 0, 1)], "target int, a int, b int")
    found = dict(metrics.disagreement(rows, F.col("a"), F.col("b"), []).collect())
    assert found == {"same": 1, "first_right": 1, "second_right": 1, "both_wrong": 1}


def test_forecasts(spark):
    lags = spark.createDataFrame([(10.0, 5.0, 0.0, 2.0), (-10.0, 0.0, 0.0, -3.0), (float("nan"), 2.0, 3.0, float("nan"))], "qty_lag_1m double, qty_lag_2m double, qty_lag_3m double, qty_mean_last_3m double")
    assert [round(x, 9) for x in column(lags, forecast.weighted_average())] == [6.5, 0, 1.2]
    assert column(lags, forecast.historical_mean(2)) == [4, 0, 0]
    pairs = spark.createDataFrame([(-0.5, 10.0), (0.25, -3.0), (2.0, 4.0)], "p double, q double")
    assert column(pairs, forecast.two_stage(F.col("p"), F.col("q"))) == [0, 0, 4]
    with pytest.raises(ValueError):
        forecast.weighted_average(weights=(0.5, 0.5, 0.5))
    scores = spark.range(1, 101).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("s"))
    assert forecast.top_threshold(scores, "s", 0.05, ["g"]).first().threshold == 96
    weighted = spark.createDataFrame([(1, 0.1, 99.0), (1, 0.9, 1.0)], "g int, s double, w double")
    assert forecast.weighted_threshold(weighted, "s", "w", 0.1, ["g"]).first().threshold == 0.1
    for target, want in (((20.0, 30.0), 1.5), ((0.0, 1.0), 1.0)):
        rows = spark.createDataFrame([(1, t, p) for t, p in zip(target, (5.0, 5.0), strict=True)], "g int, t double, p double")
        assert forecast.multiplier(rows, "t", "p", F.lit(1.0), ["g"]).first().multiplier == want
    calibrated = forecast.calibrated(spark.createDataFrame([(1, 100.0, 80.0), (2, 5.0, 0.0)], "g int, t double, p double"), "t", "p", ["g"])
    assert dict(calibrated.select("g", "factor").collect()) == {1: 1.25, 2: 1.0}


def test_sampling(spark):
    rows = spark.createDataFrame([("2023-01", "S", str(i), float(t)) for i, t in enumerate((0, 1, 3, 10, 25))], "month string, site_no string, item_id string, target double")
    found = sampling.stratified(rows, "target", dict.fromkeys(S.BUCKETS, 1.0))
    assert found.count() == 5 and set(column(found, "sample_weight")) == {1.0}
    many = spark.range(4000).select(F.lit("2023-01").alias("month"), F.lit("S").alias("site_no"), F.col("id").cast("string").alias("item_id"), F.lit(0.0).alias("target"))
    one, two = (sampling.stratified(df, "target", sampling.RATES).select("item_id") for df in (many, many.orderBy(F.desc("item_id")).repartition(7)))
    assert 120 < one.count() < 290 and one.exceptAll(two).count() == 0
    sizes = {0.0: 10_000, 3.0: 400, 7.0: 100, 25.0: 50}
    bulk = spark.createDataFrame([(t, n) for t, n in sizes.items()], "target double, n int").select("target", F.explode(F.sequence(F.lit(1), F.col("n"))))
    for wanted in (20, 500, 700, 5_000, 10_600):
        found = {r.bucket: r for r in sampling.scaled_rates(bulk, "target", sampling.RATES, wanted).collect()}
        assert sum(r.n * r.rate for r in found.values()) == pytest.approx(min(wanted, sum(sizes.values())), abs=1e-3) and max(r.rate for r in found.values()) <= 1
        low = min(r.rate / sampling.RATES[b] for b, r in found.items() if r.rate < 1) if wanted < 10_000 else 0
        assert all(r.rate == pytest.approx(min(1, sampling.RATES[b] * low), abs=1e-6) for b, r in found.items()) or wanted > 10_000


def test_encoding(spark):
    rows = spark.createDataFrame([("S1", True), (None, True), ("S2", False)], "s string, train boolean")
    for first, unseen, want in ((0, -1, {"S1": 0, None: 1, "S2": -1}), (1, 0, {"S1": 1, None: 2, "S2": 0})):
        codes = encoding.category_map(rows, F.col("train"), ["s"], first)
        assert dict(encoding.apply_map(rows, codes, ["s"], unseen).select("s", "s_code").collect()) == want
    values = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert column(encoding.scaled(values, F.col("x").isNotNull(), ["x"]), "x_scaled") == [-1, 1, -2]
    assert column(encoding.scaled(values, F.col("x").isNotNull(), ["x"], True), "x_scaled") == [-1, 1, 0]


def test_selection(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, -2.0), ("a", 2, 5.0, 1.0), ("a", 3, float("nan"), 0.0), ("b", 1, None, 1.0), ("b", 2, None, 1.0)], "g string, id int, wape double, bias double")
    assert [(r.g, r.id) for r in selection.best(rows, ["g"], [("wape", "min"), ("bias", "abs_min")], ["id"]).orderBy("g").collect()] == [("a", 2), ("b", 1)]
    median = spark.createDataFrame([(1, 10, 1.0), (1, 20, 5.0), (1, 30, 1.0)], "g int, v int, w double")
    assert selection.weighted_median(median, ["g"], "v", "w").first().weighted_median == 20


def test_serving(spark):
    rows = spark.createDataFrame([("m", "S1", "A", 0.9, 21.0), ("m", "S1", "B", 0.4, 0.2), ("m", "S2", "A", 0.5, 3.0)], "model_id string, site_no string, item_id string, p_sale double, pred double")
    ready = forecast.postprocessed(rows, "pred")
    assert [(r.item_id, r.pred_qty_int) for r in serving.top_books(ready, 2).orderBy("rank").collect()] == [("A", 21), ("A", 3)]
    summary = serving.model_summary(ready).first()
    assert (summary.total_qty, summary.nonzero_count, summary.head_count, summary.mc0_count, summary.mc4_count, summary.stores) == (24, 2, 1, 1, 1, 2)
    assert serving.page(ready, F.lit(True), "p_sale", number=2, size=2).first().item_id == "B"
    with pytest.raises(ValueError):
        serving.page(ready, F.lit(True), "pred")
    hard = serving.difficult(spark.createDataFrame([(0.0, 0.4), (0.0, 1.0), (100.0, 95.0)], "target double, prediction double"))
    assert column(hard, "difficulty") == ["easy", "hard", "medium"]


def test_checks(spark):
    with pytest.raises(ValueError):
        checks.refuse_leaks(["qty_lag_1m", "future_qty_1m"])
    rows = spark.createDataFrame([("f1", "a", "1"), ("f1", " ", "x"), ("f2", None, "-2")], "f string, v string, qty string").withColumn("d", F.lit("2023-01-01"))
    found = {r.f: r for r in checks.file_profile(rows, "f", ["v"], ["qty"], "d").collect()}
    assert (found["f1"].missing_v, found["f1"].failed_qty, found["f2"].negative_qty, found["all"].n_rows, found["all"].missing_v) == (1, 1, 1, 3, 2)
    a, b = (spark.createDataFrame([(k, 1.0, p) for k, p in rows], "k int, t double, p double") for rows in ([(1, 1.0), (2, float("nan"))], [(2, 1.0), (3, 1.0)]))
    assert tuple(checks.alignment(a, b, ["k"], "t", "p").first()) == (1, 1, 0.0, 1, 1)


def test_long_tail_top_share(spark):
    rows = spark.createDataFrame([(float(x),) for x in (10, 5, 5, 1, 1, 1, 1, 1, 1, 1)], "total_qty double")
    assert dict(longtail.top_share(rows).collect()) == {0.1: round(10 / 27, 6), 0.2: round(15 / 27, 6)}
    assert {r.bucket: r.n for r in longtail.buckets(rows).collect()} == {"0": 0, "1": 7, "2-5": 2, "5-20": 1, "20+": 0}


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "﻿门店编码,ISBN,销售日期,数量,价格\nS1,I1,2023-01-02,3,10\n".encode())
        z.writestr("two.CSV", "门店编码,ISBN,销售日期,数量,价格\nS2,书,2023-01-03,1,\n".encode("gbk"))
        z.writestr("skip.txt", "x")
    columns = ["门店编码", "isbn", "销售日期", "数量", "价格"]
    rows = sources.read_zipped_csv(spark, str(tmp_path), columns)
    ledger = sources.to_ledger(rows, sources.field_mapping(columns))
    assert sorted((r.site_no, r.gds_no, r.qty, r.tlp) for r in ledger.collect()) == [("S1", "I1", "3", "10"), ("S2", "书", "1", "")]
    with pytest.raises(ValueError):
        sources.field_mapping(["isbn"])


def test_archives_by_member(spark, tmp_path):
    text = "a,b\n" + "".join(f"{i},书{i}\n" for i in range(50_000))
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, encoding in (("one.csv", "utf-8"), ("two.csv", "gb18030"), ("three.csv", "utf-8-sig")):
            z.writestr(name, text.encode(encoding))
        z.writestr("empty.csv", b"")
        z.writestr("head.csv", b"a,b\n")
        z.writestr("short.csv", b"b,c,a\n1\n\n2,3,4,5\n")
    rows = sources.read_zipped_csv(spark, str(tmp_path), ["a", "b", "none"], archives.UPLOAD_ENCODINGS)
    assert rows.rdd.getNumPartitions() == 6
    found = {r.source_member: r for r in rows.groupBy("source_member").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"), F.count("none").alias("none")).collect()}
    assert {k: (v.n, v.b, v.none) for k, v in found.items()} == {**dict.fromkeys(("one.csv", "two.csv", "three.csv"), (50_000, "书9999", 0)), "short.csv": (2, "2", 0)}
    assert sorted((r.a or "", r.b) for r in rows.where("source_member = 'short.csv'").collect()) == [("", "1"), ("4", "2")]
    with pytest.raises(ValueError, match="comma"):
        sources.read_zipped_csv(spark, str(tmp_path), ["a,b"])
    (tmp_path / "none").mkdir()
    assert sources.read_zipped_csv(spark, str(tmp_path / "none"), ["a"]).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"书 {i}, \"x\"\n") for i in range(100)], "k int, v string").repartition(3)
    folder = str(tmp_path / "out")
    archives.write_zipped_csv(rows, folder, {"v": "名称"}, ("utf-8-sig", "utf-8", "gb18030"), lines=7)
    found = archives.read_zipped_csv(spark, folder, ["k", "名称"], archives.UPLOAD_ENCODINGS)
    assert sorted((int(r.k), r["名称"] or None) for r in found.collect()) == sorted((r.k, r.v) for r in rows.collect())
    assert found.select("source_member").distinct().count() > 3
    with pytest.raises(FileExistsError):
        archives.write_zipped_csv(rows, folder)


def test_sorted_files(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sources.write_sorted(rows, str(tmp_path / "s"), [F.desc("k"), "v"], "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [r for f in sorted((tmp_path / "s").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert len(list((tmp_path / "s").glob("part-*"))) > 1
    assert [(r.k, r.v, r.place) for r in got] == [(k, v, i + 1) for i, (k, v) in enumerate(sorted(((r.k, r.v) for r in rows.collect()), key=lambda x: (-x[0], x[1])))]
    with pytest.raises(Exception, match="exists"):
        sources.write_sorted(rows, str(tmp_path / "s"), ["k"])
    assert sources.numbered(rows.limit(0), ["k"]).count() == 0


def test_counted_quantiles(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    values = {g: draw.integers(0, 30, n).astype(float).tolist() for g, n in (("a", 400), ("b", 7), ("c", 1))}
    rows = spark.createDataFrame([(g, v) for g, own in values.items() for v in own] + [("a", None), ("a", float("nan")), ("d", None)], "g string, v double")
    wanted = {"low": (F.col("v"), 0.1), "mid": (F.col("v"), 0.5), "half": (F.col("v") / 2, 0.5), "top": (F.col("v"), 0.99)}
    found = {r.g: r for r in quantiles.wide(rows, ["g"], wanted).collect()}
    assert found.keys() == values.keys()
    for g, own in values.items():
        assert [found[g][c] for c in wanted] == pytest.approx([np.quantile(own, 0.1), np.quantile(own, 0.5), np.quantile(own, 0.5) / 2, np.quantile(own, 0.99)])
    counts = quantiles.long(rows, [], {"x": F.col("v")})
    asked = spark.createDataFrame([("x", v, i) for i, v in enumerate((-1.0, 0.0, 13.5, 14.0, 99.0))] + [("y", 1.0, 9)], "name string, value double, k int")
    every = [v for own in values.values() for v in own]
    shares = {r.k: r.share for r in quantiles.shares_up_to(asked, counts, ["name"], ["k"]).collect()}
    assert shares == {**{i: sum(x <= v for x in every) / len(every) for i, v in enumerate((-1.0, 0.0, 13.5, 14.0, 99.0))}, 9: None}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sources.write_parquet(rows, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(Exception, match="exists"):
        sources.write_parquet(rows, str(tmp_path / "p"))
    sources.write_csv_report(rows, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert text.startswith("﻿k,v".encode())


def test_history_union(spark):
    a, b = (spark.createDataFrame([(k, v)], "k int, v string") for k, v in ((1, "old"), (1, "new")))
    assert [(r.v, r.source_dataset_id) for r in sources.history_union([("a", a), ("b", b)], ["k"]).collect()] == [("new", "b")]


def test_learned_forecasts(spark):
    from shelfcast.operators import models

    with pytest.raises(ValueError):
        models.assembled(spark.createDataFrame([(1.0,)], "target_qty double"), ["target_qty"])
