"""Calibration maps and rolling rules against plain versions."""

import datetime
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from shelfcast.operators import audit, calibration
from shelfcast.plans import calibration as plans

DATA = "/root/testdata/sf0.001"
KEYS = ["g"]


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(5)
    rows = []
    for g in ("a", "b", "c"):
        for _ in range(1500):
            p = draw.random() ** 2
            rows.append((g, p, draw.random() < {"a": p, "b": p**1.6, "c": 0.2 + 0.5 * p}[g]))
    return rows + [("none sold", 0.3, False)] * 20 + [("all sold", 1.0, True)] * 3 + [("one", 0.0, True), ("a", None, True)]


@pytest.fixture(scope="module")
def counts(spark, drawn):
    rows = spark.createDataFrame(drawn, "g string, p double, y boolean")
    return calibration.counted(rows, KEYS, rows["p"], rows["y"], bins=200)


def cells_by_hand(drawn, bins=200):
    cells = defaultdict(lambda: [0.0, 0.0, 0.0])
    for g, p, y in drawn:
        if p is not None:
            own = cells[g, min(int(p * bins), bins - 1)]
            own[0], own[1], own[2] = own[0] + 1, own[1] + y, own[2] + p
    return cells


def test_monotone_map_is_the_least_squares_fit(counts, drawn):
    found = defaultdict(dict)
    for r in calibration.isotonic(counts, KEYS).collect():
        for k in range(r.low, r.high + 1):
            found[r.g][k] = r.rate
    cells = cells_by_hand(drawn)
    for g in {k[0] for k in cells}:
        own = sorted((c, v[0], v[1]) for (h, c), v in cells.items() if h == g)
        for k in range(len(own)):
            best = max(min(sum(v[2] for v in own[i : j + 1]) / sum(v[1] for v in own[i : j + 1]) for j in range(k, len(own))) for i in range(k + 1))
            assert found[g][own[k][0]] == pytest.approx(best)


def test_coefficients_equal_a_fit_by_numpy(counts, drawn):
    cells = cells_by_hand(drawn)
    found = {r.g: r for r in calibration.coefficients(counts, KEYS).collect()}
    assert found.keys() == {g for g, _ in cells}
    for g, r in found.items():
        own = np.array([v for (h, _), v in cells.items() if h == g])
        n, pos, p = own[:, 0], own[:, 1], np.clip(own[:, 2] / own[:, 0], calibration.EDGE, 1 - calibration.EDGE)
        x = np.stack([np.log(p) - np.log(1 - p), np.ones(len(p))], axis=1)

        def loss(w, x=x, n=n, pos=pos):
            z = x @ w
            return (n * np.logaddexp(0, z) - pos * z).sum() + 0.5 * ((w - [1, 0]) ** 2).sum()

        w = np.array([r.slope, r.intercept])
        gradient = x.T @ (n / (1 + np.exp(-x @ w)) - pos) + (w - [1, 0])
        assert np.abs(gradient).max() < 1e-6
        assert all(loss(w) <= loss(w + d) for d in np.vstack([np.eye(2), -np.eye(2)]) * 0.01)
        power = lambda k: (-pos * k * np.log(p) - (n - pos) * np.log(-np.expm1(k * np.log(p)))).sum() + 0.5 * (k - 1) ** 2  # noqa: B023, E731
        assert power(r.gamma) <= min(power(r.gamma * 1.01), power(r.gamma * 0.99)) or r.gamma == calibration.LEAST_POWER


def test_maps_lower_the_loss(spark, counts, drawn):
    rows = spark.createDataFrame(drawn, "g string, p double, y boolean").where("p IS NOT NULL").join(calibration.maps(counts, KEYS), "g")
    found = rows.select("g", "p", "y", *[c.alias(f"m_{k}") for k, c in calibration.mapped(rows["p"], 200).items() if k != "original"]).where("g IN ('b', 'c')").collect()
    loss = lambda c, g="bc": sum((r[c] - r.y) ** 2 for r in found if r.g in g)
    assert loss("m_platt") < loss("p") and loss("m_power", "b") < loss("p", "b") and loss("m_isotonic") <= loss("m_platt")
    assert all(0 <= r.m_isotonic <= 1 for r in found)


def test_quality_by_hand(spark):
    draw = random.Random(2)
    rows = [("x", round(draw.random(), 1), draw.random() < 0.4) for _ in range(300)]
    counts = defaultdict(lambda: [0, 0])
    for _, p, y in rows:
        counts[p][0] += 1
        counts[p][1] += y
    df = spark.createDataFrame([("x", p, float(n), float(k)) for p, (n, k) in counts.items()], "g string, p double, n double, pos double")
    found = calibration.quality(df, KEYS, 4).first()
    masses, below = defaultdict(lambda: [0.0, 0.0]), 0
    for p in sorted(counts):
        own = masses[min(int(below / 300 * 4 + 1e-9), 3)]
        own[0], own[1] = own[0] + counts[p][1], own[1] + counts[p][0] * p
        below += counts[p][0]
    assert found["count"] == 300 and found.ece == pytest.approx(sum(abs(a - b) for a, b in masses.values()) / 300, abs=1e-6)
    assert found.brier == pytest.approx(sum((p - y) ** 2 for _, p, y in rows) / 300, abs=1e-6)
    assert found.log_loss == pytest.approx(-sum(math.log(k if y else 1 - k) for k, y in ((min(max(p, 1e-15), 1 - 1e-15), y) for _, p, y in rows)) / 300, abs=1e-6)
    assert calibration.quality(df.limit(0), KEYS).count() == 0


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", [*plans.QUERIES, "fc_comp_rolling", "sel_pilot_advance"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("part", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = duck.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted([plain(r[c]) for c in want.columns] for r in found.collect()) == sorted([plain(v) for v in r] for r in want.fetchall())


def test_rolling_rules_choose_one_that_pays(spark):
    draw = random.Random(8)
    rows = []
    for fold in ("q1", "q2", "q3", "q4"):
        for _ in range(4000):
            heavy = draw.random() < 0.01
            s20 = draw.random() * 0.4 + 0.6 * heavy
            target = 30.0 if heavy else 8.0 if draw.random() < 0.05 else float(draw.random() < 0.3)
            rows.append((fold, s20 + draw.random() * 0.01, s20, target, 0.7 * target if heavy else 8.0 if target == 8 else 0.3, 1.0))
    df = spark.createDataFrame(rows, "fold string, s5 double, s20 double, target double, prediction double, w double")
    found = sorted(audit.rolling_rules(df, "fold").collect(), key=lambda r: r.fold)
    assert [(r.fold, r.until) for r in found] == [("q2", "q1"), ("q3", "q2"), ("q4", "q3")]
    assert all(r.c20 > 1.15 and r.high_rows > 0 and r.wape20_gain > 5 for r in found)
    assert all(r.last_two_agree == (min(x.recall20_gain for x in found[-2:]) > 0) for r in found)
    assert audit.rolling_rules(df.where("fold = 'q1'"), "fold").count() == 0


def test_one_set_for_each_outcome(spark):
    found = {r.candidate: (r.ap_pass, r.q_pass, r.selected) for r in entry.queries()["sel_pilot_advance"](spark, DATA).collect()}
    assert found["rank"] == (True, False, False) and found["error"][:2] == (False, True) and found["near"][:2] == (True, True) and found["wma"] == (False, False, False)
    assert sum(f[2] for f in found.values()) == 1
