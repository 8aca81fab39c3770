"""A spread of registered queries against their SQL twins on the smallest tables (compare.py runs all)."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
KEYS = ["c01_both_stock_0_live", "c02_flag_counts", "c03_top", "c04_cases", "c05_category_scorecard", "c06_region", "c08_stock_vs_target", "c09_label_losses",
        "c10_doh_towns", "c11_basepack_summary", "c12_match_targets", "c13_town", "c14_overstock_summary", "c15_summary", "c16_retention_cohort",
        "c17_means_pct", "c07_25_replenishment_report", "j06_not_in", "w03_fill_down", "a11_cross_totals", "x01_ingest_daily"]


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, duck, key):
    ok, n, m, note = compare(spark, duck, SF, entry.queries()[key], entry.oracle_sql()[key])
    assert ok and n == m, note


def test_every_query_has_a_twin():
    from stocktide.workload import oracle_sql, queries

    assert set(queries()) == set(oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
