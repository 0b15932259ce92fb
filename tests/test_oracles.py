"""Registered queries against their SQL at the smallest scale (ORACLE_ALL=1 for all)."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
SOME = ["panel_weekly", "orders_to_panel", "check_duplicates", "business_checks", "series_metrics", "decompose", "dq_distribution",
        "match_dept", "abc_xyz", "reorder_queue", "plan_week_budget", "stress_test", "supplier_scorecards", "joint_replenishment",
        "sku_table", "insights", "backtest_croston", "apply_conformal", "negbin_quantiles", "reconcile_wls", "qr_policy",
        "schedule_qr_check", "invalid_transitions", "query_grouped", "latency_summary", "stream_latency", "stream_po_state"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    msg, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert msg.startswith("ok"), msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0
