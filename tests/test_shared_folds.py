"""Large facts: the lines of the replenishment roles are folded once, and the report's rows are shuffled once by item and once by customer."""

import re

import pytest
from pyspark.sql import functions as F

from stocktide.session import DROP_SHUFFLES, bucketed
from stocktide.workload import replenishment as W
from stocktide.workload import roles as R
from test_spread import SCHEMAS, folder, large, sorted_rows, tables  # noqa: F401

SUMMARIES = ["c07_23_region_loss_reason_psl", "c07_23_one_company_nmsm_value"]


@pytest.fixture
def shuffled_joins(spark):
    """No side is small enough for a broadcast, as over large tables."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def planned(spark, folder, name):  # noqa: F811
    return W.R.queries[name](spark, folder)._jdf.queryExecution().executedPlan()


def exchanges_of_the_rows(plan):
    """Keys of the shuffles between the report's rows and their facts, from the last to the first: the left side of each join."""
    keys, node = [], plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while node.children().size():
        if node.nodeName() == "Exchange":
            keys.append(re.sub(r"#\d+L?", "", re.search(r"hashpartitioning\((.*), \d+\)", node.simpleString(50))[1]))
        node = node.children().head()
    return keys


@pytest.mark.parametrize("name", ["c07_25_replenishment_report", SUMMARIES[0]])
def test_rows_are_shuffled_once_by_item_and_once_by_customer(spark, folder, large, shuffled_joins, name):  # noqa: F811
    large()
    keys = exchanges_of_the_rows(planned(spark, folder, name))
    assert keys[-3:] == ["customer_code", "basepack_code", "l_partkey"]
    assert not [k for k in keys[:-3] if "customer" in k or "sku" in k or "basepack" in k]


def test_lines_are_read_once_for_all_folds(spark, folder, large, shuffled_joins, monkeypatch):  # noqa: F811
    """One written fold for the session; beside it only the new proposals read the lines, whose filter leaves few."""
    large()
    monkeypatch.setitem(spark.__dict__, "_stocktide_pairs", {})
    written = []
    monkeypatch.setattr(R, "bucketed", lambda df, *a: written.append(df) or bucketed(df, *a))
    plans = [planned(spark, folder, name).toString() for name in ("c07_25_replenishment_report", "c07_23_nmsm_value")]
    assert [len(re.findall(r"FileScan parquet \[l_", p)) for p in plans] == [1, 1]
    assert len(written) == 1 and len(re.findall(r"Relation[^\n]*l_orderkey", written[0]._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert all("Bucketed: true" in p and "disabled by query planner" not in p for p in plans)


def test_fold_follows_its_files(spark, large, tmp_path):  # noqa: F811
    large()
    for name, data in tables().items():
        spark.createDataFrame(data, SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    lock = lambda: sorted_rows(R.frame(spark, str(tmp_path), "lock"))
    before = lock()
    assert before and lock() == before
    lines = [(*r[:6], 0.0, *r[7:]) for r in tables()["lineitem"]]  # no discount, so no lock
    spark.createDataFrame(lines, SCHEMAS["lineitem"]).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    del spark.__dict__["_stocktide_views"][str(tmp_path)]  # the last one, so its views are made anew under their names
    assert lock() == []


@pytest.mark.parametrize("name", SUMMARIES)
def test_large_facts_give_the_same_summary(spark, folder, large, name):  # noqa: F811
    few = sorted_rows(W.R.queries[name](spark, folder))
    large()
    assert len(few) > 1 and sorted_rows(W.R.queries[name](spark, folder)) == few


def test_buckets_are_joined_in_place(spark, make, rows):
    df = make([(k % 5, k, None if k == 3 else k * 2) for k in range(40)] + [(None, 1, 1)], "a long, b long, c long")
    kept = spark.conf.get(DROP_SHUFFLES, None)
    table = spark.table(bucketed(df.repartition(3, "a"), "buckets", 3, "a", "b"))
    assert spark.conf.get(DROP_SHUFFLES, None) == kept
    assert rows(table, "a", "b", "c") == rows(df) and len(table.inputFiles()) <= 3
    plan = table.groupBy("a").agg(F.sum("c"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
