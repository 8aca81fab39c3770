import datetime as dt

import pytest
from pyspark.sql import functions as F

from stocktide.plans import (
    activation, days_on_hand, loss_attribution, loss_fill, norm_value, order_cuts, outlet_growth, overstock, retention, returns,
    scorecard, supply_off, target_match, understock, zero_stock,
)


def day(s):
    return dt.date.fromisoformat(s)


def test_zero_stock_live(make, rows):
    depot = make([("d1", "p", "BF01", 0.0, 0.0), ("d1", "q", "BF01", 0.0, 4.0), ("d1", "p", "XX", 9.0, 9.0), ("d1", "dead", "BF01", 0.0, 0.0)], "depot_stock")
    norm = make([(1, "c", 10, "p", "t", "Depot", 5.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, "c", 11, "q", "t", "Depot", 5.0, 0.0, 0.0, 0.0, 0.0, 1.0),
                 (3, "c", 10, "p", "t", "Depot", 5.0, 2.0, 0.0, 0.0, 0.0, 1.0)], "norm")
    plan = make([("p", 5.0, 0.0, 1.0, "r"), ("q", 0.0, 5.0, 1.0, "r")], "plan_volval")
    kpi = make([("p", a, None, v) for a, v in (("Secondary Achievement", 0.5), ("Business Contribution", 0.2), ("Other", 9.0))], "daily_eav")
    out = zero_stock.zero_stock_live(depot, norm, make([("d1", "Depot")], "plant_map"), plan, kpi)
    assert rows(out["depot_stock_0"], "basepack") == [("p",)]  # 'dead' is not a live item
    assert rows(out["depot_stock_0_live"], "customer_code") == [(1,), (3,)]
    assert rows(out["customer_stock_0_live"], "customer_code") == [(1,), (2,)]
    assert rows(out["both_stock_0_live"], "customer_code", "secondary_achievement") == [(1, 0.5)]
    assert rows(out["plan_mismatch_live"], "customer_code") == [(1,), (3,)]
    assert rows(out["summary"]) == [(1, 0.2, 0.5)]


def test_returns_flags_stay_null(make, rows):
    visits = make([("o1", "7", 2.0), ("o9", "8", 1.0)], "outlet_code string, sku_code string, qty_pc double")
    out = returns.enrich_returns(
        visits, make([("o1", "R", "A", "T", "town", "rc")], "outlet_geo"), make([(7, "p", 1, "c", "A")], "product"),
        make(["p"], "sku string"), make(["z"], "sku string"), make(["p"], "sku string"))
    assert rows(out, "outlet_code", "region", "basepack", "ps_sku", "ns_sku", "fefo_sku", "reason") == [
        ("o1", "R", "p", 1, None, 1, None), ("o9", None, None, None, None, None, None)]
    assert rows(returns.flag_counts(out)) == [(1, None, 1, 1), (None, None, None, 1)]


def test_order_cuts_town_text_is_cut_like_the_full_list(make):
    towns = [f"town{n:03d}" for n in range(60)] + ["", "a"]
    data = [("A", "p", "c", t, "co", 1.0) for t in towns] + [("A", "q", "c", "x", "co", 100.0), ("A", "q", "c", "x", "co", 0.0), ("A", "r", "c", None, "co", 2.0)]
    data += [("A", "s", "c", t, "co", 0.0001) for t in ("c", "b", "b", "c", "b")]
    out = order_cuts.order_cuts(make(data, "hht_orders"), width=20)
    full = {r["basepack"]: r["order_towns"] for r in out["basepack"].collect()}
    assert full["p"] == ", ".join(sorted(towns)) and full["s"] == "b, c" and full["r"] is None
    for r in out["top"].collect():  # one entry per order row
        text = ", ".join(sorted(t for _, p, _, t, _, q in data if p == r["basepack"] and q > 0 and t is not None)) or None
        assert r["order_towns"] == (text[:20] + " ..." if text and len(text) > 20 else text)
    top = {r["basepack"]: (r["order_qty"], r["order_pct"], r["order_town_count"]) for r in out["top"].collect()}
    assert top["q"] == (100.0, "60.98%", 1) and top["p"] == (62.0, "37.8%", 62)


def test_activation_null_code_blocks_not_in(make, rows):
    active = make([(1, 11)], "active")
    product = make([(11, "P1", 1, "c", "A"), (21, "P2", 2, "c", "A")], "product")
    alloc = make([(1, "P1", 12, "m12", 5.0), (2, "P2", 21, "m21", 5.0), (1, "P1", 11, "m11", 0.0)], "allocation")
    price = make([(1, 11, "m11", 5.0), (1, 12, "m12", 8.0), (2, 21, "m21", 3.0)], "price")
    p2 = make([("P1", 1, "d", 11, 1)], "activation_2")
    known = activation.activation_exceptions(make([("P2", 99, "d", 1), ("P2", 98, "d", 0)], "activation_1"), p2, product, active, alloc, price)
    assert rows(known["plan_1"], "activity_code") == [(99,)]
    assert rows(known["plan_2"]) == []
    assert rows(known["allocation"], "material_code") == [(12,)]
    assert rows(known["dearer_allocation"], "material_code", "active_material_code") == [(12, 11)]
    assert rows(known["price"], "material_code", "seq") == [(11, 2), (12, 1), (21, 1)]
    assert rows(known["cases"], "remarks") == [("allocation price > active price",), ("plan sheet 1",)]
    unknown = activation.activation_exceptions(make([("P9", 99, "d", 1)], "activation_1"), p2, product, active, alloc, price)
    assert rows(unknown["allocation"]) == []  # a null code in the list rejects every row


def test_scorecard_excludes_after_top_k(make, rows):
    data = []
    for pack, con in (("pep powder", 9.0), ("pep gel", 8.0), ("close up", 7.0), ("other", 99.0)):
        for d in range(15, 23):
            date = day(f"2023-03-{d:02d}")
            data += [(pack, "Business Contribution", date, con), (pack, "National Stock in CS", date, 50.0), (pack, "Order Qnt in CS", date, float(d)),
                     (pack, "Secondary Target in CS", date, 30.0), (pack, "Primary In CS", date, 1.0 if pack != "close up" or d != 16 else None)]
    out = scorecard.category_scorecard(make(data, "daily_eav"), "2023-03-22", ["PEP", "close"], "%powder%", k=2)
    assert rows(out) == [("pep gel", 8.0, 50.0, 19.0, 30.0, 8.0, 22.0)]
    more = scorecard.category_scorecard(make(data, "daily_eav"), "2023-03-22", ["PEP", "close"], None, k=3)
    assert rows(more.where("basepack = 'close up'"), "primary_cs", "monthly_remaining_vol_cs") == [(None, None)]


def test_loss_fill_zero_orders_and_type_default(make, rows):
    sccf = make([("m1", "t", "o1", "c", 0.0, 0.0, 0.0, None, "r"), ("m2", "t", "o1", "c", 4.0, 1.0, 3.0, None, "r"), ("m2", "t", "o2", "c", 6.0, 6.0, 0.0, None, "r")], "sccf_outlet")
    out = loss_fill.loss_fill_cuts(sccf, make([("O1", "big")], "outlet_type"), ["M1", "M2"])
    assert rows(out["region"]) == [("R", 0.0, 0.0, 3.0, 0.7)]
    assert rows(out["outlet_type"]) == [("big", 0.0, 0.0, 3.0, 0.25), ("unspecified", None, None, 0.0, 1.0)]
    assert rows(out["outlet"], "outlet", "M2_loss") == [("O1", 3.0), ("O2", 0.0)]


def test_norm_value(make, rows):
    depot = make([("d", "X Shampoo", "BF01", 1.0, 2.0), ("d", "Clinic Shampoo", "BF01", 1.0, 2.0)], "depot_stock")
    norm = make([(1, "c", 1, "X Shampoo", "t", "d", 10.0, 1.0, 1.0, 1.0, 0.0, 1e7), (2, "c", 1, "X Shampoo", "t", "d", 10.0, 1.0, 1.0, None, 0.0, 3e7)], "norm")
    out = norm_value.stock_vs_target(depot, norm, make([("X Shampoo", 1.0, 1.0, 7.0, "r")], "plan_volval"), "%shampoo%", "%clinic%")
    assert rows(out) == [("X Shampoo", 20.0, 40.0, 3.0, 6.0, 3.0, 6.0, 7.0)]


def sccf_rows():
    r = lambda d, m, o, i: (d, "r", "t", m, "desc", "pk", o, i, i / o * 100)
    return [r("01.01.2023", 1, 10.0, 10.0), r("05.01.2023", 1, 10.0, 4.0), r("05.01.2023", 2, 5.0, 5.0),
            r("09.01.2023", 1, 10.0, 2.0), r("09.01.2023", 2, 10.0, 9.0), r("09.01.2023", 3, 3.0, 0.0), r("09.01.2023", 4, 3.0, 3.0)]


@pytest.mark.parametrize("order_side,given", [(False, 0.0), (True, 4.0)])
def test_loss_labels(make, rows, order_side, given):
    master = make([(1, "F070"), (2, "F070"), (3, "OTHER")], "cp_master")
    closing = make([("r", "t", 1, "d", "pk", day("2023-01-01"), 7.0), ("r", "t", 2, "d", "pk", day("2023-01-01"), 20.0), ("r", "t", 2, "d", "pk", day("2023-01-05"), 99.0)], "closing_stock")
    out = loss_attribution.label_losses(make(sccf_rows(), "sccf_daily"), closing, master, running=(1, 3), order_side_running=order_side)
    got = {r["material"]: (r["cp_status"], r["clstock_vol_cs"], r["given_order_qty"], r["stock_loss_qty"], r["loss_label"]) for r in out.collect()}
    revised = 7.0 - given
    assert got[1] == ("running CP", 7.0, given, min(8.0, 10.0 - revised), "partial stock loss")
    assert got[2] == ("old CP", 20.0, 5.0 if order_side else 9.0, None, "service loss")
    assert got[3] == ("non CP", 0.0, 0.0, 3.0, "full stock loss")  # listed as running but not in the master
    assert set(got) == {1, 2, 3}
    assert rows(loss_attribution.rows_per_day(out)) == [("09.01.2023", 3)]
    assert out.where("stock_loss_qty > sccf_loss_qty").count() == 0


def test_potential_fill(make, rows):
    lab = make([("01.01.2023", "t", "p", 4.0, 2.0), ("01.02.2023", "t", "p", 4.0, None), ("01.02.2023", "u", "q", 0.0, None)],
               "report_date string, town string, pack_size string, sccf_loss_qty double, stock_loss_qty double")
    sccf = make([("01.01.2023", "r", "t", 1, "d", "p", 10.0, 6.0, 60.0)], "sccf_daily")
    assert rows(loss_attribution.potential_by_town(lab, sccf, "p"), "town", "stock_loss_qty_pct", "potential_sccf") == [("t", 0.5, 0.8)]
    dr = make([("p", 1.0, 2.0)], "primary_dr")
    assert rows(loss_attribution.potential_by_pack(lab, sccf, dr), "pack_size", "stock_loss_qty_pct", "prim_dr") == [("p", 0.25, 0.5)]
    assert rows(loss_attribution.potential_by_month(lab, make([("01.2023", 0.5)], "scorecard")), "report_month", "potential_sccf") == [("01.2023", 0.75)]


def test_understock(make, rows):
    rpl = make([("t1", "p", "09 Nov 2023", 5.0, "u", "Winter", 20.0, 1.0, "n", 0.0), ("t1", "q", "09 Nov 2023", 30.0, "u", "Winter", 20.0, 0.0, "n", 0.0),
                ("t1", "z", "09 Nov 2023", 0.0, "u", "A", 20.0, 1.0, "n", 0.0)], "rpl_slim")
    target = make([("T1", "P", 3.0), ("T1", "Q", 1.0), ("T1", "Z", 50.0)], "town_sku_target")
    plan = make([("r", "a", "c", "T1", 2.0, None, None, None, None)], "lifting_plan")
    for rule, lag in (("norm", 15.0), ("doh", 5.0)):
        out = understock.understock_push(rpl, target, plan, make([("T1", 1e7)], "confirmed"), rule=rule)
        assert rows(out["lines"], "basepack", "doh", "bc") == [("P", 5.0, 0.75)]
        assert rows(out["towns"]) == [("T1", lag, 0.75, 2.0, 1.0, "yes", 1.0)]


def test_outlet_growth(make, rows):
    cols = ", ".join(f"{m} double" for m in outlet_growth.YTD)
    now = make([("o1", "p", *[2.0] * 9, 18.0), ("o2", "p", *[1.0] + [None] * 8, 1.0)], f"outlet_code string, basepack string, {cols}, total double")
    then = make([("o1", "p", *[1.0] * 9, 5.0), ("o3", "q", *[1.0] * 9, 0.0)], f"outlet_code string, basepack string, {cols}, dec double")
    out = outlet_growth.outlet_growth(now, then)
    assert rows(out["detail"].where("typ = 1"), "outlet_code", "total_ty", "total_ly", "growth") == [("o1", 18.0, 9.0, 1.0), ("o2", 1.0, 0.0, None), ("o3", 0.0, 9.0, -1.0)]
    assert rows(out["detail"].where("typ = 2"), "outlet_code", "dec_ly", "jan_ty", "feb_ty", "total_ty") == [("o1", 0.0, -3.0, 0.0, -3.0), ("o2", 0.0, 1.0, -1.0, 0.0), ("o3", 0.0, 0.0, 0.0, 0.0)]
    assert abs(sum(r["outlet_bc"] for r in out["outlet"].collect()) - 1) < 1e-12
    assert rows(out["basepack"], "basepack", "total", "total_diff", "basepack_growth") == [("p", 19.0, -3.0, 10 / 9), ("q", 0.0, 0.0, -1.0)]


def test_target_match_over_allocated_town(make, rows):
    plan = make([("D", "t1", "3"), ("D", "t2", "\n"), ("D", "D TOTAL", "99"), ("D", "total small", "1")], "depot_plan")
    alloc = make([("t2", 2e7)], "alloc_value")
    gaps = target_match.target_gaps(plan, alloc)
    assert rows(gaps, "town", "gap", "total_gap_pct") == [("t1", 3.0, 1.5), ("t2", -2.0, -1.0), ("total small", 1.0, 0.5)]
    stock = make([("B1", "p", "BF01", 0.0, 5.0), ("B1", "p", "BF01", 0.0, 7.0), ("B1", "q", "BF01", 0.0, 9.0)], "depot_stock")
    out = target_match.match_targets(plan, alloc, make([("D", "p"), ("D", "p")], "c_class"), stock, make([("B1", "D")], "plant_map"))
    assert rows(out, "town", "basepack", "to_fulfil", "to_fulfil_rounded") == [("t1", "p", 10.5, 10.0), ("t2", "p", -7.0, -7.0), ("total small", "p", 3.5, 3.0)]


def test_days_on_hand_quirks(make, rows):
    rpl = make([("t", "p", 10.0, "c", "A"), ("t", "p", 8.0, "c", "A"), ("t", "q", 4.0, "c", "A")], "rpl_stock")
    sccf = make([("T", "P", 8.0, 8.0)], "sccf_month")
    alloc = make([("p", "bg", "cat", 3.0), ("q", "bg", "cat", 1.0)], "sku_target")
    town = days_on_hand.doh_operational(rpl, sccf, alloc, make([("t", "p", 1, 1.0, 1.0, "A"), ("t", "q", 1, 1.0, 1.0, None)], "town_class"),
                                        make([("t", "p", 2.0, 3.0)], "town_rr"), 4, "town")
    assert rows(town, "basepack", *days_on_hand.ATTRS) == [("P", 9.0, 6.0, 36.0, 9.0, 18.0)]  # q has no class: left out
    swapped = days_on_hand.doh_operational(rpl, sccf, alloc, make([("t", "p", 1, 1.0, 1.0, "A")], "town_class"), make([("t", "p", 2.0, 3.0)], "town_rr"), 4,
                                           "town", swap_town_rr=True, distinct_target=True)
    assert rows(swapped, "DOH_3_months", "DOH_6_months", "DOH_target") == [(6.0, 9.0, 18.0)]
    nation = days_on_hand.doh_operational(rpl, sccf, alloc, make([("p", "A"), ("q", "B")], "national_class"), make([("p", 0.0, 3.0)], "national_rr"), 4)
    assert rows(nation, "basepack", *days_on_hand.ATTRS) == [("P", 0.0, 6.0, 18.0, 9.0, 18.0), ("Q", None, None, 18.0, None, 4.0)]


def test_overstock(make, rows):
    rpl = make([("t", "p", 1.0, 4.0, 2.0), ("t", "q", 3.0, 4.0, 8.0), ("x", "p", 1.0, 0.0, 1.0)], "town string, basepack string, proposed_qty double, norm_qty double, on_hand double")
    cls = make([("t", "p", 1, 0.0, 0.0, "A"), ("t", "q", 1, 0.0, 0.0, "A"), ("x", "p", 1, 0.0, 0.0, "D")], "town_class")
    out = overstock.overstock_index(rpl, cls, ["t"])
    assert rows(out, "portfolio", "sku_count", "value_index", "qmix") == [("A", 2, 1.25, 0.5), ("overall", 2, 1.25, 0.5), ("p", 1, 0.5, 0.75), ("q", 1, 2.0, 0.25)]
    wide = overstock.overstock_summary(overstock.overstock_index(rpl, cls))
    assert rows(wide, "town", "value_index_A", "value_index_D", "qmix_overall") == [("t", 1.25, None, 0.5), ("x", None, None, None)]


def test_supply_off(make, rows):
    win = lambda rs: make(rs, "basepack string, s string, e string").select("basepack", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))
    wins = supply_off.off_windows(win([("p", "2023-01-02", "2023-01-03"), ("p", "2023-01-03", "2023-01-04")]), win([("p", "2023-01-02", "2023-01-03")]))
    prim = make([(day("2023-01-01"), "p", 4.0, 2.0), (day("2023-09-01"), "p", 4.0, 2.0), (day("2023-01-02"), "z", 1.0, 1.0)], "primary_daily")
    sec = make([(day("2023-01-01"), "p", 10.0, 5.0), (day("2023-01-03"), "p", 10.0, -1.0), (day("2023-01-05"), "p", 0.0, 0.0), (day("2023-01-01"), "z", 20.0, 20.0)],
               "report_date date, basepack string, sec_ord_qty double, sec_inv_qty double")
    out = supply_off.primary_off_impact(wins, prim, sec, ["2023-01-01", "2023-01-03", "2023-01-05"], "2023-01-01", "2023-07-01")
    tagged = [(r["report_date"].day, r["status"]) for r in out["tagged"].orderBy("report_date", "status").collect()]
    assert tagged == [(1, None), (3, "constraint"), (3, "removed"), (5, None)]  # two windows overlap on the 3rd
    assert rows(out["status"]) == [(0.5, "p", "on", "removed", "no data")]
    daily = {r["measure"]: r for r in out["daily"].collect()}
    assert daily["2. Secondary Invoiced Qty"]["2023-01-03"] == -1.0  # a real -1 stays a number
    assert daily["3. SCCF"]["2023-01-05"] is None and daily["3. SCCF"]["SCCF - not Constrainted/Removed"] == 0.5
    s = out["summary"].first()
    assert (s["contribution"], s["days_cons"], s["days_rem"], s["days_consrem"], s["sccf_not_consrem"]) == (0.5, 1, 1, 2, 0.5)
    assert len(out["summary"].columns) == 20


def test_retention(make, rows):
    claim = lambda d, who, amt, reason="Expired": (day(d), who, "m", reason, amt)
    claims = make([claim("2022-01-31", 1, 5.0), claim("2022-02-01", 1, 5.0), claim("2022-03-05", 1, 4.0), claim("2022-01-05", 2, 9.0), claim("2022-03-05", 2, 10.0),
                   claim("2022-02-05", 3, 1.0, "Broken")], "claims")
    product = make([(1, "DOVE BAR", 1, "c", "A")], "product").withColumn("material_desc", F.lit("m"))
    listed = make([("Dove Bar", "c", "bg", "YES"), ("Lux", "c", "bg", "no")], "focus_list")
    out = retention.retention_cohort(claims, product, listed)
    got = rows(out, "claim_month_from", "claim_month_to", "month_diff", "distributors_ret", "distributors_init")
    assert got == [("2022-01", "2022-01", 0, 2, 2), ("2022-01", "2022-02", 1, 1, 2), ("2022-01", "2022-03", 2, 1, 2), ("2022-02", "2022-02", 0, 1, 1), ("2022-03", "2022-03", 0, 2, 2)]
    assert all(r["distributors_ret_pct"] == 1 for r in out.where("month_diff = 0").collect())
    assert ("avg.", 5 / 3, 1.0, 1.0) in rows(retention.cohort_pivot(out, [0, 1, 2]))
    brands = retention.retention_cohort(claims, product, listed, amount_rule=False, reason=None, by="brand")
    assert rows(retention.brand_means(brands, [0, 1, 2])) == [("DOVE", 2.0, 1.0, 2.0)]


def test_stages_do_not_change_results(make, rows):
    from stocktide.session import cut_lineage

    sccf = make([("m1", "t", "o1", "c", 8.0, 2.0, 6.0, None, "r"), ("m2", "t", "o2", "c", 4.0, 1.0, 3.0, None, "r")], "sccf_outlet")
    types = make([("O1", "big")], "outlet_type")
    plain, staged = (loss_fill.loss_fill_cuts(sccf, types, ["M1", "M2"], stage=s) for s in (lambda d: d, cut_lineage))
    assert all(rows(plain[k]) == rows(staged[k]) for k in plain)
