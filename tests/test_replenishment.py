from pyspark.sql import functions as F

from stocktide.plans import replenishment as P


def test_stock_cover_zero_rules(make, rows):
    df = make([(1, 5.0, 0.0, 2.0), (2, 0.0, 0.0, 2.0), (3, 5.0, 0.0, 0.0), (4, 5.0, 10.0, 0.0), (5, 5.0, 10.0, 4.0), (6, None, 10.0, 4.0)],
              "id int, on_hand double, norm_qty double, cover_days double")
    assert rows(P.stock_cover(df), "id", "stock_cover") == [(1, None), (2, 0.0), (3, 0.0), (4, 0.0), (5, 2.0), (6, 0.0)]


def test_sc_rr_loss_builds_up(make, rows):
    df = make([(1, 10.0, 0.0), (2, 10.0, 5.0), (3, 10.0, 15.0), (4, 10.0, 25.0), (5, 0.0, 5.0), (6, 0.0, 0.0), (7, None, 5.0)],
              "id int, per_day_value double, on_hand_value double")
    got = rows(P.sc_rr_loss(df), "id", "sc_rr", "zero_stock", "stock_lt1", "stock_lt2", "stock_lt3")
    assert got == [(1, 0.0, 10.0, 10.0, 20.0, 30.0), (2, 0.5, 0.0, 5.0, 15.0, 25.0), (3, 1.5, 0.0, 0.0, 5.0, 15.0), (4, 2.5, 0.0, 0.0, 0.0, 5.0),
                   (5, None, 0.0, 0.0, 0.0, 0.0), (6, 0.0, 0.0, 0.0, 0.0, 0.0), (7, 0.0, None, None, None, None)]


def test_cover_bands(make, rows):
    df = make([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 2.0), (4, 3.0, 3.0), (5, 4.0, 3.5), (6, 9.0, 1.0), (7, 1.0, None)], "id int, on_hand double, stock_cover double")
    df = df.withColumns({"per_day_qty": F.lit(8.0), "per_day_value": F.lit(80.0), "on_hand_value": F.col("on_hand") * 10})
    got = rows(P.cover_bands(df), "id", "zero", "lt1_day", "lt2_day", "lt3_day")
    assert got == [(1, 80.0, 0, 0, 0), (2, 0, 70.0, 0, 0), (3, 0, 0, 60.0, 0), (4, 0, 0, 0, 50.0), (5, 0, 0, 0, 0), (6, 0, 0.0, 0, 0), (7, 0, 0, 0, 0)]


def test_mstn_null_and_zero(make, rows):
    df = make([(1, 10.0, 4.0, 2.5), (2, 0.0, 0.0, 0.0), (3, 10.0, None, 1.0), (4, 3.0, 9.0, 0.0)], "id int, norm_qty double, on_hand double, in_transit double")
    assert rows(P.mstn(df), "id", "phy_capped", "total_capped", "phy_mstn", "total_mstn") == [
        (1, 4.0, 6.0, 40.0, 60.0), (2, 0.0, 0.0, None, None), (3, 10.0, None, 100.0, None), (4, 3.0, 3.0, 100.0, 100.0)]


def test_loss_reason_cascade(make, rows):
    data = [(1, 5.0, 5.0, 0.0, "Active", 9999.0), (2, 1.0, 5.0, 0.0, "Defaulter", 10.0), (3, 1.0, 5.0, 0.0, "Active", 9999.0), (4, 1.0, 5.0, 2.0, "Active", 9999.0),
            (5, 1.0, 5.0, 2.0, "Active", 80.0), (6, 1.0, 5.0, 2.0, "Active", 90.0), (7, 1.0, 5.0, 0.0, "Active", 90.0), (8, None, 5.0, 0.0, "Active", 90.0)]
    df = make(data, "id int, on_hand double, norm_qty double, in_transit double, defaulter string, dr_help double")
    assert [r[1] for r in rows(P.loss_reason(df), "id", "loss_reason")] == [
        "Stock available", "Defaulter", "No-Order from Customer", "Stock in transit", "Supply Issue", "Stock in transit", "No-Order from Customer", "Stock available"]


def test_dispatch_rate_sums_percentages(make, rows):
    df = make([(1, 5, 2.0, 2.0, 1.0, None), (1, 5, 4.0, None, 2.0, 2.0), (2, 5, 0.0, 0.0, 3.0, 0.0), (3, 5, 0.0, 0.0, 0.0, 0.0)],
              "customer_code int, basepack_code long, `Final Customer W1` double, `Final Customer W2` double, `Dispatched Qty W1` double, `Dispatched Qty W2` double")
    assert rows(P.dispatch_rate(df)) == [(1, 5, 125.0), (2, 5, float("inf")), (3, 5, 0.0)]


def test_lock_rules(make, rows):
    df = make([(1, 1, "A", -5.0, 5.0), (2, 1, "A", None, None), (3, 1, "X", None, None), (4, 1, "B", 0.0, 9.0)],
              "customer_code long, sku_code long, company string, lower_band double, upper_band double")
    full = df.withColumns({c: F.lit("") for c in ("sku_desc", "category", "basepack", "town")}).withColumn("basepack_code", F.lit(1))
    assert rows(P.lock_check(full), "customer_code") == [(1,), (2,), (3,)]
    assert rows(P.lock_default(df), "customer_code", "lower_band", "upper_band") == [(1, -5.0, 5.0), (2, 50.0, 100.0), (3, None, None), (4, 0.0, 9.0)]


def test_gap_list_keeps_unknown_gap(make, rows):
    df = make([(1, 10.0, 2.0, 1.0, 1.0, 6.0), (2, 10.0, 20.0, 0.0, 0.0, 3.0), (3, None, 1.0, 1.0, 1.0, 1.0)],
              "id int, norm_qty double, on_hand double, in_transit double, open_order double, proposed_qty double").withColumn("customer_name", F.lit("n"))
    assert rows(P.gap_list(df), "id", "correct_qty", "gap") == [(2, 0.0, -3.0), (3, None, None)]


def test_price_and_status_defaults(make, rows):
    df = make([(1, 7, "A", 0.0, 0.0, 2.0), (2, 7, "A", 3.0, None, 2.0), (3, 8, "A", 0.0, 5.0, 2.0)],
              "customer_code long, sku_code long, company string, price double, ppo_value double, proposed_qty double")
    assert rows(P.price_fallback(df, make([(7, 4.0, "c")], "sku_master")), "customer_code", "price", "ppo_value") == [(1, 4.0, 8.0), (2, 3.0, 0.0), (3, None, 5.0)]
    inv = make([(1, 1532, 1, "Sent"), (0, 1532, 1, "Not Update"), (2, 9, 2, "Sent"), (3, 1532, 3, None)], "inventory")
    assert rows(P.inventory_status(df, P.tag_inventory(inv)), "customer_code", "inventory_status") == [(1, "Not Update"), (2, "Not Update"), (3, "Not Update")]
    fund = make([(1, "Blocked", "A"), (2, None, "A"), (3, "Blocked", "B")], "fund")
    assert rows(P.defaulter_flag(df, fund), "customer_code", "defaulter") == [(1, "Defaulter"), (2, "Active"), (3, "Active")]


def test_pivot_total_leaves_incomplete_rows_out(make):
    cols = [c for c in dict.fromkeys(P.V + P.M + P.D + P.S)]
    data = [("A", "t", "r", "Supply Issue", "A", *[1e7] * len(cols)), ("A", "t", "r", "Supply Issue", "B", *[1e7 if c != "phy_mstn" else None for c in cols])]
    df = make(data, "classification string, nmsm_tag string, region string, loss_reason string, company string, " + ", ".join(f"{c} double" for c in cols))
    out = P.crore_pivots(df)
    assert len(out) == 12
    got = {r["classification"]: (r["psl"], r["phy_mstn"]) for r in out["classification_mstn"].collect()}
    assert got == {"A": (2.0, 1.0), "Total": (1.0, 1.0)}
    assert {r["classification"]: r["psl"] for r in P.crore_pivots(df, "B")["classification_mstn"].collect()} == {"A": 1.0, "Total": 0.0}
    two_way = {r["region"]: (r["Supply Issue"], r["Defaulter"], r["Total"]) for r in out["region_loss_reason_psl"].collect()}
    assert two_way == {"r": (2.0, None, 2.0), "Total": (2.0, None, 2.0)}


def test_written_report_feeds_the_summaries(spark, tmp_path):
    from stocktide.workload.registry import Inputs
    from stocktide.workload import replenishment as W

    i = Inputs(spark, "/root/testdata/sf0.001")
    places = P.write_replenishment(W.inputs(i), W.RUN_DATE, str(tmp_path / "out"))
    report = spark.read.parquet(places["report"])
    assert report.columns == P.REPORT_COLUMNS and len(P.REPORT_COLUMNS) == 56
    assert report.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").join(
        spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct().count()
    totals = spark.read.parquet(places["classification_value"])
    assert totals.where("classification = 'Total'").count() == 1
