"""Large facts: the same rows, joined and folded in tasks of a bounded number of rows."""

import re
from datetime import datetime, timedelta

import pytest

from stocktide.plans import supply_off
from stocktide.workload import roles as R
from stocktide.workload import replenishment as W
from stocktide.workload import composites as C
from stocktide.workload.registry import Inputs

SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,
        l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp""",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}
DAY = datetime(1998, 1, 1)


def tables():
    """A hot customer and item, keys that repeat, are null or are missing on the other side."""
    customer = [(k, f"n{k}", k % 3, 900.0 * k - 1000, ("A", "B")[k % 2]) for k in range(9)] + [(3, "n3", 0, 50.0, "A"), (4, "n4", 1, 10.0, "B"), (None, "x", 1, 0.0, "A")]
    part = [(k, f"p{k}", f"Brand#{(3, 8, 14, 21, 5)[k % 5]}", ("MEDIUM", "PROMO", "SMALL")[k % 3], (2, 20, 50)[k % 3], 10.0 + k) for k in range(24)]
    part += [(5, "p5", "Brand#3", "MEDIUM", 50, 15.0), (6, "p6", None, "PROMO", 2, 16.0)]
    orders = [(k, None if k % 19 == 0 else 3 if k % 2 else k % 11, "FOP"[k % 3], 1.0, DAY + timedelta(days=k % 190), ("1-URGENT", "5-LOW")[k % 2]) for k in range(120)]
    orders += [(7, 2, "P", 1.0, DAY, "2-HIGH")]
    lines = [(k % 125, None if k % 31 == 0 else 7 if k % 3 == 0 else k % 27, 1, k % 7 + 1, None if k % 29 == 0 else float(k % 50), 100.0 + k, (k % 10) / 100, (k % 9) / 100,
              "ANR"[k % 3], "OF"[k % 2], None if k % 37 == 0 else DAY + timedelta(days=k % 200)) for k in range(500)]
    return {"region": [(0, "R0"), (1, "R1")], "nation": [(0, "N0", 0), (1, "N1", 1), (2, "N2", 0)], "customer": customer, "supplier": [(1, "s", 0, 1.0)],
            "part": part, "orders": orders, "lineitem": lines, "events": [(1, DAY, 1, "e", 1.0, "{}")]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("spread")
    for name, rows in tables().items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture
def large(monkeypatch):
    """The facts count as large: 12 tasks of 42 rows."""
    def switch():
        monkeypatch.setattr(R, "TASK_ROWS", 42)
    return switch


def sorted_rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("role", sorted(R.SPREAD))
def test_large_facts_give_the_same_role(spark, folder, large, role):
    plain = R.frame(spark, folder, role)
    few = sorted_rows(plain)
    large()
    spread = R.frame(spark, folder, role)
    assert R.tasks(spark, folder) == 12 and spread.schema == plain.schema
    assert len(few) > 10 and sorted_rows(spread) == few


@pytest.mark.parametrize("name", ["c07_08_lock_check", "c07_25_replenishment_report"])
def test_large_facts_give_the_same_result(spark, folder, large, name):
    few = sorted_rows(W.R.queries[name](spark, folder))
    large()
    assert few and sorted_rows(W.R.queries[name](spark, folder)) == few


def test_rows_are_joined_and_folded_in_tasks_that_follow_the_facts(spark, folder, large):
    """Every join by fine keys and the fold itself name their number of tasks, which merging by compressed size does not undo."""
    large()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = W.R.queries["c07_25_replenishment_report"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = {}
    for by, n in re.findall(r"Exchange hashpartitioning\(([^\n]*), (\d+)\), ", plan):
        keys.setdefault(re.sub(r"#\d+L?", "", by), set()).add(int(n))
    for by in ("o_custkey, l_partkey", "customer_code, basepack_code", "customer_code, company", "sku_code", "l_orderkey", "p_partkey"):
        assert keys[by] == {12}, by


def test_small_facts_are_left_to_spark(spark, folder):
    assert R.tasks(spark, folder) is None
    assert "REPARTITION_BY_NUM" not in W.R.queries["c07_17_oos_psl"](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_off_summary_reads_the_facts_once_for_each_side(spark, folder, monkeypatch):
    """Once for the fold of each side; tags and shares are both taken from the folds."""
    want = sorted_rows(supply_off.summary(C._tagged(i := Inputs(spark, folder)), supply_off.contribution(i.secondary_daily)))
    plans, staged = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df: plans.append(df) or staged(df))
    out = C.R.queries["c15_summary"](spark, folder)
    scans = [len(re.findall(r"Relation[^\n]*l_orderkey", df._jdf.queryExecution().optimizedPlan().toString())) for df in (*plans, out)]
    assert scans == [1, 1, 0]
    assert want and sorted_rows(out) == want


def test_contribution_of_a_fold_is_that_of_its_rows(make, rows):
    sec = make([("1998-01-01", "a", 1.0, 1.0), ("1998-01-01", "a", 2.0, None), ("1998-01-02", "b", 5.0, 0.0), (None, "b", None, 1.0), (None, None, 2.0, 1.0)],
               "report_date string, basepack string, sec_ord_qty double, sec_inv_qty double")
    want = [("a", 0.3), ("b", 0.5), (None, 0.2)]
    assert rows(supply_off.contribution(sec)) == rows(supply_off.contribution(supply_off.daily_totals(sec))) == want
