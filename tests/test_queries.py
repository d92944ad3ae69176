"""Queries against their SQL in DuckDB over the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ["agg_monthly", "pn_expand", "ft_roll", "as_filter", "ft_cross", "fc_comp_fit", "mt_long_tail", "mt_classification", "mt_gate_sweep", "mt_topk", "sm_audit_mix", "sel_business", "sv_results", "dq_distribution_shift", "pp_fold_seen"]
NAMES += ["mt_complete", "mt_gate_sweep_full", "mt_signal_month", "mt_zero_sensitivity", "dq_active_integrity_violated", "sel_pilot", "sel_acceptance", "fc_comp_rolling", "jn_multi_fair"]
NAMES += ["mt_feature_audit_full", "sel_gate_refined", "fc_comp_rules", "mt_concentration_groups", "mt_head_errors", "mt_error_groups"]
NAMES += ["mt_level_details", "mt_levels", "mt_fair", "dq_month_coverage", "dq_history_ready_gaps", "dq_dataset_report", "mt_migration_levels", "mt_migration_errors", "mt_concentration", "sel_business_guarded"]
NAMES += ["agg_closure_validate_violated", "dq_validate_horizon_violated", "cl_return_flag", "mt_business"]


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}" if v else "0"
    return v.strftime("%Y-%m-%d") if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in found.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
