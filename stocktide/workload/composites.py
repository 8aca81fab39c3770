"""The seventeen analyses on the given tables, each sheet with a SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.plans import (
    activation, days_on_hand, loss_attribution, loss_fill, norm_value, order_cuts, outlet_growth, overstock, retention, returns,
    scorecard, supply_off, target_match, understock, zero_stock,
)
from stocktide.operators.reshaping import unpivot_days
from stocktide.operators.windows import fill_down
from stocktide.session import staged
from stocktide.sources.readers import literal_table
from stocktide.workload.registry import Inputs, Registry

R = Registry()
add = R.add


def rounded(df, *cols, digits=9):
    """Sums of inexact doubles depend on the order of addition; both engines round them."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- zero stock but live --------------------------------------------------------------------------------------------------

def _c01(i: Inputs):
    return zero_stock.zero_stock_live(i.depot_stock, i.norm, i.plant_map, i.plan_item, i.daily_kpi)


_DEPOTS = """select depot_code, basepack, sum(in_transit + available) as depot_stock from {depot_stock}
    where storage_loc = 'BF01' group by 1, 2"""
_CUST = """select customer_code, customer_name, basepack_code, basepack, norm_qty, town, depot_name,
    on_hand + in_transit + open_order as customer_stock from {norm}"""
_KPI = """select basepack, sum(case when attribute = 'Secondary Achievement' then value end) as secondary_achievement,
    sum(case when attribute = 'Business Contribution' then value end) as business_contribution from {daily_kpi}
    where attribute in ('Secondary Achievement', 'Business Contribution') group by 1"""
_ZERO = f"""select * from ({_DEPOTS} having sum(in_transit + available) = 0) t0
    join (select distinct basepack from {{norm}}) t1 using (basepack) join {{plant_map}} t2 using (depot_code)"""
_BOTH = f"""select * from ({_CUST} where on_hand + in_transit + open_order = 0) t1 join {{plant_map}} t2 using (depot_name)
    join ({_DEPOTS} having sum(in_transit + available) = 0) t3 using (depot_code, basepack)
    left join ({_KPI}) t4 using (basepack) where secondary_achievement < 1 and business_contribution is not null"""
for _name, _sql in {
    "depot_stock_0": _ZERO,
    "depot_stock_0_live": f"select * from ({_CUST}) t1 join {{plant_map}} t2 using (depot_name) "
                          f"join (select basepack, depot_code, depot_stock from ({_ZERO}) z) t3 using (depot_code, basepack)",
    "customer_stock_0_live": f"select * from ({_CUST} where on_hand + in_transit + open_order = 0) t1 "
                             f"join {{plant_map}} t2 using (depot_name) join ({_DEPOTS}) t3 using (depot_code, basepack)",
    "both_stock_0_live": _BOTH,
    "plan_mismatch_live": f"select * from ({_CUST}) t1 join (select basepack, primary_vol, secondary_vol, remark from {{plan_item}} "
                          f"where secondary_vol = 0 and primary_vol > 0) t2 using (basepack)",
    "summary": f"""select count(basepack) as basepacks, sum(business_contribution) as business_contribution,
        avg(secondary_achievement) as secondary_achievement
        from (select distinct basepack, secondary_achievement, business_contribution from ({_BOTH}) b) d""",
}.items():
    add(f"c01_{_name}", lambda i, n=_name: _c01(i)[n], _sql)


# --- trade returns --------------------------------------------------------------------------------------------------------

FEFO = ["PROMO Brand#1", "SMALL Brand#2", "LARGE Brand#3", "PROMO Brand#11", "ECONOMY Brand#5"]


def _c02(i: Inputs):
    fefo = literal_table(i.spark, FEFO, "sku string")
    return returns.enrich_returns(i.visits, i.outlet_geo, i.product_pack, i.ps_list, i.ns_list, fefo)


_ABSENT = {"outlet_name": "varchar", "route": "varchar", "sso": "varchar", "pack_size": "varchar", "qty_ctn": "double", "price_ctn": "double",
           "secondary_sales": "double", "damage_pct": "double", "company_code": "varchar"}
_C02 = f"""with packs as (select cast(material as varchar) as code, basepack from {{product_pack}}),
    v as (select v.*, g.* exclude (outlet_code), p.basepack from {{visits}} v left join {{outlet_geo}} g on g.outlet_code = v.outlet_code
      left join packs p on p.code = v.sku_code)
    select region, area, territory, town, outlet_code, channel, route_code, sku_code, sku_desc, basepack, reason, qty_pc, value,
      case when exists (from {{ps_list}} l where l.sku = v.basepack) then 1 end as ps_sku, case when exists (from {{ns_list}} l where l.sku = v.basepack) then 1 end as ns_sku,
      case when basepack in ({", ".join(f"'{f}'" for f in FEFO)}) then 1 end as fefo_sku, {", ".join(f"cast(null as {t}) as {c}" for c, t in _ABSENT.items())} from v"""
add("c02_enrich_returns", _c02, _C02)
add("c02_flag_counts", lambda i: returns.flag_counts(_c02(i)),
    f"select ps_sku, ns_sku, fefo_sku, count(*) as instances from ({_C02}) e group by 1, 2, 3")


# --- order cuts -----------------------------------------------------------------------------------------------------------

_LIVE = "select * from {hht_orders} where order_qty > 0"
_TOWNS = f"(select distinct basepack, town from ({_LIVE}) l)"
_PACKS = f"""select basepack, order_qty, order_town_count, order_towns from
    (select basepack, sum(order_qty) as order_qty, count(town) as order_town_count from ({_LIVE}) l group by 1) a
    join (select basepack, string_agg(town, ', ' order by town) as order_towns from {_TOWNS} t group by 1) b using (basepack)"""
add("c03_basepack", lambda i: order_cuts.order_cuts(i.hht_orders)["basepack"], _PACKS)
for _dim in order_cuts.CUTS:
    add(f"c03_{_dim}", lambda i, n=_dim: order_cuts.order_cuts(i.hht_orders)[n],
        f"select {_dim}, sum(order_qty) as order_qty from ({_LIVE}) l group by 1")
add("c03_top", lambda i: order_cuts.order_cuts(i.hht_orders)["top"],
    f"""select basepack, order_qty, concat(round(order_qty * 100.0e0 / (select sum(order_qty) from ({_LIVE}) w), 2), '%') as order_pct,
    order_town_count, case when length(every) > 40 then concat(left(every, 40), ' ...') else every end as order_towns
    from (select basepack, sum(order_qty) as order_qty, count(town) as order_town_count, string_agg(town, ', ' order by town) as every from ({_LIVE}) l group by 1) p
    order by order_qty desc, basepack limit 7""")


# --- activation -----------------------------------------------------------------------------------------------------------

def _c04(i: Inputs):
    return activation.activation_exceptions(i.activation_1, i.activation_2, i.family_product, i.active, i.allocation, i.price)


_P_WITH = """codes as (select distinct basepack as d, basepack_code as pack_code from {family_product}), prices as (select distinct basepack_code, material_code, material_desc,
      retail_price from {price}), running as (select distinct basepack_code, material_code from {active}),
    p1 as (select a.basepack, activity_code, description, subs, pack_code from {activation_1} a left join codes on d = a.basepack
      where subs = 1 and not exists (from running r where r.basepack_code = pack_code and r.material_code = activity_code)),
    p2 as (select a.basepack, activity_code_remove, description, post_code, post_subs, pack_code from {activation_2} a left join codes on d = a.basepack
      where post_subs = 1 and not exists (from running r where r.basepack_code = pack_code and r.material_code = post_code)),
    given as (select distinct basepack_code, basepack_desc, material_code, material_desc from {allocation}
      where allocated_qty > 0 and basepack_code <> all (select pack_code from p1 union all select pack_code from p2)),
    dearer as (select g.material_code, g.basepack_code, g.basepack_desc, g.material_desc, mine.retail_price as alloc_price, o.material_code as active_material_code,
        o.material_desc as active_material_desc, o.retail_price as active_price
      from given g, prices mine, running r, prices o where mine.material_code = g.material_code and r.basepack_code = g.basepack_code
        and o.material_code = r.material_code and o.retail_price < mine.retail_price)"""


def _c04_sql(body: str) -> str:
    return f"with {_P_WITH} {body}"


_AS_TEXT = "cast({0} as varchar) as basepack_code, {1} as basepack_desc, cast({2} as varchar) as material_code, {3} as material_desc"
for _name, _sql in {
    "plan_1": "from p1", "plan_2": "from p2", "allocation": "from given", "dearer_allocation": "from dearer",
    "price": "select p.*, 1 + (select count(*) from prices q where q.basepack_code = p.basepack_code and q.retail_price > p.retail_price) as seq from prices p",
    "cases": f"""select {_AS_TEXT.format("pack_code", "basepack", "activity_code", "description")}, cast(null as varchar) as active_material_code,
        cast(null as varchar) as active_material_desc, 'plan sheet 1' as remarks from p1
      union all by name select {_AS_TEXT.format("pack_code", "basepack", "post_code", "description")}, 'plan sheet 2' as remarks from p2
      union all by name select {_AS_TEXT.format("basepack_code", "basepack_desc", "material_code", "material_desc")}, cast(active_material_code as varchar) as active_material_code,
        active_material_desc, 'allocation price > active price' as remarks from dearer""",
}.items():
    add(f"c04_{_name}", lambda i, n=_name: _c04(i)[n], _c04_sql(_sql))


# --- category scorecard ---------------------------------------------------------------------------------------------------

RUN_DATE = "1998-03-22"
MTD_DAYS = [f"1998-03-{d:02d}" for d in range(1, 23)]
_EAV_COLS = {"Business Contribution": "contrib", "National Stock in CS": "stock", "Order Qnt in CS": "orders",
             "Secondary Target in CS": "target", "Primary In CS": "prim"}


def _daily_eav(i: Inputs):
    """Wide daily table (one column per day and attribute row), unpivoted to long form."""
    days = i.brand_day.where(F.col("ship_day").between("1998-03-01", RUN_DATE)).withColumn("target", F.col("orders") * 2)
    cells = days.select("basepack", F.date_format("ship_day", "yyyy-MM-dd").alias("day"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(c).alias("v")) for a, c in _EAV_COLS.items()])).alias("x"))
    wide = cells.groupBy("basepack", "x.attribute").pivot("day", MTD_DAYS).agg(F.sum("x.v")).fillna(0)
    return unpivot_days(wide, ["basepack", "attribute"], MTD_DAYS)


def _attr(col, cond, name):
    return f"(select basepack, sum(case when {cond} then {col} else 0 end) as {name} from {{brand_day}} where ship_day between date '1998-03-01' and date '{RUN_DATE}' group by 1)"


add("c05_category_scorecard", lambda i: scorecard.category_scorecard(_daily_eav(i), RUN_DATE, ["brand#1", "BRAND#2"], "%#13%"),
    f"""select *, secondary_target_cs - primary_cs as monthly_remaining_vol_cs from
    (select * from {_attr('contrib', f"ship_day = date '{RUN_DATE}'", 'biz_contribution')} k
     where basepack ilike 'brand#1%' or basepack ilike 'brand#2%' order by biz_contribution desc, basepack limit 10) t1
    join {_attr('stock', f"ship_day = date '{RUN_DATE}'", 'national_stock_cs')} t2 using (basepack)
    join (select basepack, s / 5 as last_5_day_avg_orders_cs from {_attr('orders', "ship_day between date '1998-03-17' and date '1998-03-21'", 's')} o) t3 using (basepack)
    join {_attr('orders * 2', f"ship_day = date '{RUN_DATE}'", 'secondary_target_cs')} t4 using (basepack)
    join {_attr('prim', "true", 'primary_cs')} t5 using (basepack)
    where basepack not ilike '%#13%'""")


# --- loss and fill --------------------------------------------------------------------------------------------------------

YEARS = [str(y) for y in range(1995, 2002)]


def _c06(i: Inputs):
    return loss_fill.loss_fill_cuts(i.sccf_outlet, i.outlet_type, YEARS)


_TYPED = """select month, upper(f.town) as town, upper(f.outlet) as outlet, upper(f.channel) as channel, upper(f.region) as region,
    ord_qty, inv_qty, loss_qty, case when t.type is null then 'unspecified' else t.type end as outlet_type
    from {sccf_outlet} f left join {outlet_type} t on upper(f.outlet) = upper(t.outlet)"""


def _year_pivot(keys: str) -> str:
    cells = ", ".join(
        f"""sum(case when month = '{y}' then loss_qty end) as "{y}_loss", """
        f"""case when count(case when month = '{y}' then 1 end) > 0 then coalesce(sum(case when month = '{y}' then inv_qty end)
        / nullif(sum(case when month = '{y}' then ord_qty end), 0), 0) end as "{y}_SCCF" """ for y in YEARS)
    return f"select {keys}, {cells} from ({_TYPED}) t group by {keys}"


add("c06_full", lambda i: _c06(i)["full"], _year_pivot("region, town, channel, outlet_type, outlet"))
for _dim in loss_fill.FULL_KEY:
    add(f"c06_{_dim}", lambda i, n=_dim: _c06(i)[n], _year_pivot(_dim))
add("c06_long", lambda i: loss_fill.loss_fill_long(loss_fill.with_type(i.sccf_outlet, i.outlet_type)),
    f"""select month, 'loss' as attr, region, town, channel, outlet_type, outlet, sum(loss_qty) as val from ({_TYPED}) t group by all
    union all select month, 'SCCF' as attr, region, town, channel, outlet_type, outlet, sum(inv_qty) / nullif(sum(ord_qty), 0) as val
    from ({_TYPED}) t group by all""")


# --- norm, stock and target value -----------------------------------------------------------------------------------------

add("c08_stock_vs_target", lambda i: norm_value.stock_vs_target(i.depot_name_stock, i.norm_name, i.plan_name, "%RING%", "%small%"),
    """select basepack, norm_qty, norm_qty * p / 10000000 as norm_val_crore, depot_stock_qty, depot_stock_qty * p / 10000000 as depot_stock_val_crore,
    customer_stock_qty, customer_stock_qty * p / 10000000 as customer_stock_val_crore, tgt_crore from
    (select basepack, sum(in_transit + available) as depot_stock_qty from {depot_name_stock}
     where storage_loc = 'BF01' and basepack ilike '%ring%' and basepack not ilike '%small%' group by 1) t1
    join (select basepack, sum(norm_qty) as norm_qty, sum(on_hand + in_transit + open_order) as customer_stock_qty,
          cast(sum(price) as double) / count(price) as p from {norm_name}
          where basepack ilike '%ring%' and basepack not ilike '%small%' group by 1) t2 using (basepack)
    join (select basepack, sum(month_value) as tgt_crore from {plan_name} group by 1) t3 using (basepack)""")


# --- loss attribution -----------------------------------------------------------------------------------------------------

RUNNING = tuple(range(0, 60))


def _labelled(i: Inputs):
    return loss_attribution.label_losses(i.sccf_daily, i.closing_stock, i.cp_master, RUNNING)


def _status(running: bool) -> str:
    listed = ", ".join(str(m) for m in RUNNING)
    first = f"when cp is not null and f.material in ({listed}) then 'running CP' " if running else ""
    return f"case {first}when cp is not null then 'old CP' else 'non CP' end as cp_status"


_CP = "(select distinct material as cp from {cp_master} where material_group = 'F070')"
_DAYS = """(select day, lag(day, 1) over (order by day) as p1, lag(day, 2) over (order by day) as p2
    from (select distinct strptime(report_date, '%d.%m.%Y')::date as day from {sccf_daily}) d)"""
_F = "(select *, strptime(report_date, '%d.%m.%Y')::date as day from {sccf_daily})"
_LABEL = f"""select *, case when final_order_qty > revised_stock and sccf_loss_qty <= final_order_qty - revised_stock then sccf_loss_qty
        when final_order_qty > revised_stock and sccf_loss_qty > final_order_qty - revised_stock then final_order_qty - revised_stock end as stock_loss_qty,
    case when final_order_qty > revised_stock and sccf_loss_qty <= final_order_qty - revised_stock then 'full stock loss'
        when final_order_qty > revised_stock and sccf_loss_qty > final_order_qty - revised_stock then 'partial stock loss'
        when final_order_qty <= revised_stock then 'service loss' else 'unidentified loss' end as loss_label
    from (select report_date, day, cp_status, region, town, pack_size, material, material_desc, final_order_qty, invoiced_qty,
        final_order_qty - invoiced_qty as sccf_loss_qty, case_fill_pct as sccf, coalesce(stock, 0) as clstock_vol_cs,
        coalesce(given, 0) as given_order_qty, coalesce(stock, 0) - coalesce(given, 0) as revised_stock
    from (select f.*, p1, p2, {_status(True)} from {_F} f join {_DAYS} d using (day) left join {_CP} c on f.material = cp
          where p2 is not null and case_fill_pct < 100) x
    left join (select date as p2, cp_status, region, town, pack_size, sum(stock_cs) as stock from
          (select f.*, {_status(True)} from {{closing_stock}} f left join {_CP} c on f.material = cp) y group by all) s
        using (p2, cp_status, region, town, pack_size)
    left join (select day as p1, cp_status, region, town, pack_size, sum(invoiced_qty) as given from
          (select f.*, {_status(False)} from {_F} f left join {_CP} c on f.material = cp) y group by all) o
        using (p1, cp_status, region, town, pack_size)) r"""
_PCT = """sum(sccf_loss_qty) as sccf_loss_qty, sum(stock_loss_qty) as stock_loss_qty,
    sum(stock_loss_qty) / nullif(sum(sccf_loss_qty), 0) as stock_loss_qty_pct"""
_FILL = "sum(invoiced_qty) / nullif(sum(final_order_qty), 0) as sccf"
add("c09_report_calendar", lambda i: loss_attribution.report_calendar(loss_attribution.dated(i.sccf_daily), "day"),
    """select day, lag(day, 1) over (order by day) as prev_1, lag(day, 2) over (order by day) as prev_2, lead(day, 1) over (order by day) as next_1,
    lead(day, 2) over (order by day) as next_2 from (select distinct strptime(report_date, '%d.%m.%Y')::date as day from {sccf_daily}) d""")
add("c09_cp_status", lambda i: loss_attribution.with_cp_status(
        i.sccf_daily, loss_attribution.cp_materials(i.cp_master), RUNNING).groupBy("cp_status", "report_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("final_order_qty").alias("qty")),
    f"""select cp_status, report_date, count(*) as n, sum(final_order_qty) as qty from
    (select f.*, {_status(True)} from {{sccf_daily}} f left join {_CP} c on f.material = cp) x group by 1, 2""")
add("c09_label_losses", _labelled, _LABEL)
add("c09_rows_per_day", lambda i: loss_attribution.rows_per_day(_labelled(i)),
    f"select report_date, count(*) as rows_found from ({_LABEL}) l group by 1")
add("c09_potential_by_town", lambda i: loss_attribution.potential_by_town(_labelled(i), i.sccf_daily, "Brand#12"),
    f"""select *, sccf + stock_loss_qty_pct * (1 - sccf) as potential_sccf from
    (select town, {_PCT} from ({_LABEL}) l where pack_size = 'Brand#12' and stock_loss_qty > 0 group by 1) t1
    left join (select town, {_FILL} from {{sccf_daily}} where pack_size = 'Brand#12' group by 1) t2 using (town)""")
add("c09_potential_by_pack", lambda i: loss_attribution.potential_by_pack(_labelled(i), i.sccf_daily, i.primary_dr),
    f"""select *, sccf + stock_loss_qty_pct * (1 - sccf) as potential_sccf from
    (select pack_size, {_PCT} from (select pack_size, coalesce(stock_loss_qty, 0) as stock_loss_qty, sccf_loss_qty from ({_LABEL}) l
      where sccf_loss_qty > 0) a group by 1) t1
    join (select pack_size, sum(dispatched_qty) / nullif(sum(expected_order_qty), 0) as prim_dr from {{primary_dr}} group by 1) t2 using (pack_size)
    join (select pack_size, {_FILL} from {{sccf_daily}} group by 1) t3 using (pack_size)
    order by sccf_loss_qty desc, stock_loss_qty_pct desc, pack_size limit 50""")
add("c09_potential_by_month", lambda i: loss_attribution.potential_by_month(_labelled(i), i.scorecard),
    f"""select *, sccf_card + stock_loss_qty_pct * (1 - sccf_card) as potential_sccf from
    (select right(report_date, 7) as report_month, {_PCT} from ({_LABEL}) l group by 1) t1
    join (select month as report_month, sccf_card from {{scorecard}}) t2 using (report_month)""")


# --- understock -----------------------------------------------------------------------------------------------------------

def _c10(i: Inputs, rule: str):
    return understock.understock_push(i.rpl_slim, i.town_sku_target, i.lifting_plan, i.confirmed, rule=rule)


_WINTER = """select strptime(date, '%d %b %Y') as rpl_date, upper(town) as town, upper(basepack) as basepack, class as cls,
    on_hand / nullif(per_day_sales, 0) as doh, norm_qty, on_hand as stock, norm_qty - on_hand as stock_to_norm_diff,
    on_hand / nullif(norm_qty, 0) as stock_to_norm_pct from {rpl_slim} where class = 'Winter'"""
_TGT = f"""select upper(town) as town, upper(basepack) as basepack, tgt_cr from {{town_sku_target}}
    where upper(basepack) in (select basepack from ({_WINTER}) w)"""
_LOW = {rule: f"""select * from (select * from ({_WINTER}) w where {cond}) t1
    join (select *, tgt_cr / (select sum(tgt_cr) from ({_TGT}) a) as bc from ({_TGT}) b) t2 using (town, basepack)"""
        for rule, cond in {"norm": "stock_to_norm_diff > 0", "doh": "doh < 10"}.items()}
for _rule, _lag, _as in (("norm", "stock_to_norm_diff", "stock_to_norm_diff"), ("doh", "10 - doh", "doh_lag_from_floor")):
    add(f"c10_{_rule}_lines", lambda i, r=_rule: _c10(i, r)["lines"], _LOW[_rule])
    add(f"c10_{_rule}_towns", lambda i, r=_rule, a=_as: rounded(_c10(i, r)["towns"], a, "winter_bc_of_low_stock", "confirmed_val", "push_val"),
        f"""select town, round({_as}, 9) as {_as}, round(winter_bc_of_low_stock, 9) as winter_bc_of_low_stock, plan,
        round(confirmed_val, 9) as confirmed_val, case when plan > confirmed_val then 'yes' else 'no' end as if_push_eligible,
        round(plan - confirmed_val, 9) as push_val from
        (select town, sum({_lag}) as {_as}, sum(bc) as winter_bc_of_low_stock from ({_LOW[_rule]}) l group by 1) t1
        join (select town, plan from {{lifting_plan}}) t2 using (town)
        join (select town, sum(cast(confirmed_value as decimal(18,2)))::double / 10000000 as confirmed_val from {{confirmed}} group by 1) t3 using (town)""")


# --- outlet growth --------------------------------------------------------------------------------------------------------

YTD = list(outlet_growth.YTD)


def _year(i: Inputs, year: int, last: bool):
    months = dict(enumerate(outlet_growth.MONTHS, 1))
    wanted = {n: m for n, m in months.items() if m in YTD or (last and m == "dec")}
    wide = i.outlet_month.where(F.col("yr") == year).groupBy("outlet_code", "basepack").pivot("mon", list(wanted)).agg(F.sum("qty"))
    wide = wide.withColumnsRenamed({str(n): m for n, m in wanted.items()})
    if last:
        return wide
    total = F.coalesce(F.col(YTD[0]), F.lit(0.0))
    for m in YTD[1:]:
        total = total + F.coalesce(F.col(m), F.lit(0.0))
    return wide.withColumn("total", total)


def _c11(i: Inputs):
    return outlet_growth.outlet_growth(_year(i, 1998, False), _year(i, 1997, True))


def _mon(n: int) -> str:
    return f"coalesce(sum(case when mon = {n} then qty end), 0)"


_TY = "select outlet_code, basepack, " + ", ".join(f"{_mon(n)} as {m}_ty" for n, m in enumerate(YTD, 1)) + \
    ", coalesce(sum(case when mon <= 9 then qty end), 0) as total_ty from {outlet_month} where yr = 1998 group by 1, 2"
_LY = f"select outlet_code, basepack, {_mon(12)} as dec_ly, coalesce(sum(case when mon <= 9 then qty end), 0) as total_ly " \
      "from {outlet_month} where yr = 1997 group by 1, 2"
_VALS = ["dec_ly"] + [f"{m}_ty" for m in YTD]
_PAIR = "select outlet_code, basepack, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in [*_VALS, "total_ty", "total_ly"]) + \
    f" from ({_TY}) a full join ({_LY}) b using (outlet_code, basepack)"
_STEPS = [f"{b} - {a} as {b}" for a, b in zip(_VALS, _VALS[1:])]
_TBL = f"""select outlet_code, basepack, {', '.join(_VALS)}, total_ty, total_ly, (total_ty - total_ly) / nullif(total_ly, 0) as growth, 1 as typ
    from ({_PAIR}) p union all
    select *, {' + '.join(_VALS[1:])} as total_ty, 0 as total_ly, 0 as growth, 2 as typ from
    (select outlet_code, basepack, 0 as dec_ly, {', '.join(_STEPS)} from ({_PAIR}) q) d"""
_BC = "select {k}, sum(total_ty) / (select sum(total_ty) from ({t}) w where typ = 1) as {n}_bc from ({t}) x where typ = 1 group by 1"
_OBC = _BC.replace("{k}", "outlet_code").replace("{n}", "outlet").replace("{t}", _TBL)
_BBC = _BC.replace("{k}", "basepack").replace("{n}", "basepack").replace("{t}", _TBL)
_DETAIL = f"select * from ({_TBL}) t join ({_OBC}) o using (outlet_code) join ({_BBC}) b using (basepack)"
add("c11_fill_down", lambda i: fill_down(
        i.events.select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "signup", F.col("user_id")).alias("outlet_code"), "value"),
        "outlet_code", "pos", block_rows=4096),
    """select pos, outlet_code, value from (select event_id as pos, value, last_value(case when event_type = 'signup' then user_id end ignore nulls)
    over (order by event_id rows between unbounded preceding and current row) as outlet_code from {events}) e where outlet_code is not null""")
add("c11_year_pair", lambda i: outlet_growth.year_pair(_year(i, 1998, False), _year(i, 1997, True)).select("outlet_code", "basepack", *_VALS, "total_ty", "total_ly"),
    _PAIR)
add("c11_detail", lambda i: _c11(i)["detail"], _DETAIL)
for _k, _n in (("outlet_code", "outlet"), ("basepack", "basepack")):
    add(f"c11_{_n}_summary", lambda i, n=_n: _c11(i)[n],
        f"""select {_k}, total, total_diff, {_n}_bc, {_n}_growth from
        (select {_k}, sum(total_ty) as total, max({_n}_bc) as {_n}_bc from ({_DETAIL}) d where typ = 1 group by 1) t1
        join (select {_k}, sum(total_ty) as total_diff from ({_DETAIL}) d where typ = 2 group by 1) t2 using ({_k})
        join (select {_k}, sum(total_ty - total_ly) / nullif(sum(total_ly), 0) as {_n}_growth from ({_TBL}) t where typ = 1 group by 1) t3 using ({_k})""")


# --- target match ---------------------------------------------------------------------------------------------------------

_GAP = """select depot, town, plan, alloc, gap, gap / nullif(sum(cast(gap as decimal(28,12))) over (partition by depot), 0) as total_gap_pct from
    (select depot, town, plan, coalesce(alloc, 0) as alloc, cast(plan as double) - coalesce(alloc, 0) / 10000000 as gap from
     (select depot, town, cast(case when plan <> '\n' then plan else '0' end as decimal(18,3)) as plan from {depot_plan}
      where town not like '%TOTAL%') lp
     left join (select town, cast(sum(allocated_value) as double) as alloc from {alloc_value} group by 1) al using (town)) g"""


def _c12_gaps(i: Inputs):
    return rounded(target_match.target_gaps(i.depot_plan, i.alloc_value), "gap", "total_gap_pct")


def _c12(i: Inputs):
    out = target_match.match_targets(i.depot_plan, i.alloc_value, i.c_class, i.depot_brand_stock, i.plant_region)
    return rounded(out, "gap", "total_gap_pct", "to_fulfil", digits=6)


add("c12_gaps", _c12_gaps, f"select depot, town, plan, alloc, round(gap, 9) as gap, round(total_gap_pct, 9) as total_gap_pct from ({_GAP}) x")
add("c12_match_targets", _c12, f"""select depot, town, plan, alloc, round(gap, 6) as gap, round(total_gap_pct, 6) as total_gap_pct, basepack, stock,
    round(stock * total_gap_pct, 6) as to_fulfil, floor(stock * total_gap_pct) as to_fulfil_rounded
    from ({_GAP}) g join
    (select depot, basepack, stock from (select depot_name as depot, basepack, max(available) as stock from {{depot_brand_stock}}
      join {{plant_region}} using (depot_code) where storage_loc = 'BF01' group by 1, 2) s
     join (select distinct depot, basepack from {{c_class}}) c using (depot, basepack)) k using (depot)""")


# --- days on hand ---------------------------------------------------------------------------------------------------------

DAYS = 32


def _doh_sql(level: str) -> str:
    """One row per key with its stock, each rate beside it; a measure is there where its rate has the key."""
    town = level == "town"
    key = ["town", "basepack"] if town else ["basepack"]
    up, by = ", ".join(f"upper({k}) as {k}" for k in key), ", ".join(key)
    rates, classes = ("{town_rr}", "{town_class}") if town else ("{national_rr}", "{national_class}")
    cover = lambda rate: f"case when {rate}_known then coalesce(soh / nullif({rate}, 0), 0) end"
    return f"""with stock as (select {up}, sum(on_hand) as soh, count(*) as lines from {{rpl_stock}} group by all),
      slow as (select {up}, sum(rr_3m) as rr_3m, sum(rr_6m) as rr_6m, true as rr_3m_known, true as rr_6m_known from {rates} group by all),
      fast as (select {up}, sum(ord_qty) / {DAYS} as rr, true as rr_known from {{sccf_month}} group by all),
      goods as (select upper(business_group) as business_group, upper(category) as category, upper(basepack) as basepack, sum(tgt_cr) as part from {{sku_target}} group by all),
      shared as (select business_group, category, basepack, part / sum(part) over () as basepack_bc from goods)
    select business_group, category, upper(classification) as classification, basepack_bc, s.*  exclude (soh, lines), coalesce(soh, 0) as stock_on_hand,
      {cover("rr_3m")} as "DOH_3_months", {cover("rr_6m")} as "DOH_6_months", {cover("rr")} as "DOH_this_month", 18 * {"lines" if town else "1"} as "DOH_target"
    from stock s left join slow using ({by}) left join fast using ({by}) join shared using (basepack)
    join (select {up}, classification from {classes}) c using ({by})
    where business_group is not null and category is not null and classification is not null and basepack_bc is not null"""


add("c13_national", lambda i: days_on_hand.doh_operational(i.rpl_stock, i.sccf_month, i.sku_target, i.national_class, i.national_rr, DAYS),
    _doh_sql("national"))
add("c13_town", lambda i: days_on_hand.doh_operational(i.rpl_stock, i.sccf_month, i.sku_target, i.town_class, i.town_rr, DAYS, "town"),
    _doh_sql("town"))


# --- overstock ------------------------------------------------------------------------------------------------------------

_INDEX = """select town, portfolio, count(*) as sku_count, sum(norm_qty) as norm_qty, sum(proposed_qty) as proposed_qty, sum(on_hand) as stock_on_hand,
      sum(on_hand) / nullif(sum(norm_qty), 0) as value_index, 1 - sum(proposed_qty) / nullif(sum(norm_qty), 0) as qmix
    from (select r.*, unnest(['overall', basepack, classification]) as portfolio from {rpl_town} r join {town_class} c using (town, basepack)) l group by town, portfolio"""


def overstock_flagship(i: Inputs):
    return overstock.overstock_index(i.rpl_town, i.town_class)


add("c14_overstock_index", overstock_flagship, _INDEX)
add("c14_overstock_summary", lambda i: overstock.overstock_summary(overstock_flagship(i)),
    "select town, " + ", ".join(f"max(case when portfolio = '{p}' then {m} end) as \"{m}_{p}\"" for m in ("value_index", "qmix")
                                for p in ("A", "B", "C", "D", "overall"))
    + f" from ({_INDEX}) x where portfolio in ('A', 'B', 'C', 'D', 'overall') group by 1")


# --- supply off -----------------------------------------------------------------------------------------------------------

CONSTRAINTS = [("Brand#3", "1998-01-05", "1998-01-20"), ("Brand#3", "1998-03-01", "1998-03-31"), ("Brand#8", "1998-02-01", "1998-02-10"),
               ("Brand#14", "1998-01-01", "1998-06-30")]
REMOVALS = [("Brand#3", "1998-01-15", "1998-02-05"), ("Brand#8", "1998-02-01", "1998-02-10"), ("Brand#21", "1998-05-10", "1998-05-10")]
START, STOP = "1998-01-01", "1998-07-01"


def _windows(i: Inputs):
    def listed(rows):
        return literal_table(i.spark, rows, "basepack string, s string, e string").select(
            "basepack", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))
    return supply_off.off_windows(listed(CONSTRAINTS), listed(REMOVALS))


def _tagged(i: Inputs):
    return supply_off.tagged_days(_windows(i), i.primary_daily, i.secondary_daily, START, STOP)


def _off_parts(i: Inputs):
    """Tagged days and shares from the folds of the facts, each written once."""
    primary, secondary = staged(supply_off.daily_totals(i.primary_daily, START, STOP)), staged(supply_off.daily_totals(i.secondary_daily))
    return supply_off.tagged_days(_windows(i), primary, secondary, START, STOP), supply_off.contribution(secondary)


def _off_long(i: Inputs):
    return supply_off.measures_long(*_off_parts(i))


_WIN = "(select distinct basepack, cast(a as date) as start_date, cast(z as date) as end_date, status from (values " + ", ".join(
    f"('{b}', '{a}', '{z}', '{m}')" for m, rows in (("removed", REMOVALS), ("constraint", CONSTRAINTS)) for b, a, z in rows) + ") l(basepack, a, z, status))"
_TAG = f"""with facts as (select report_date, basepack, prim_ord_qty, prim_inv_qty from {{primary_daily}} where report_date between date '{START}' and date '{STOP}' - 1
      union all by name select report_date, basepack, sec_ord_qty, sec_inv_qty from {{secondary_daily}}),
    spans as (select basepack, start_date, end_date, max(status) as status from {_WIN} w group by all),
    off as (select distinct basepack, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as report_date, status from spans),
    days as (select report_date, basepack, sum(columns(['prim_ord_qty', 'prim_inv_qty', 'sec_ord_qty', 'sec_inv_qty'])) from facts
      where basepack in (select basepack from spans) group by 1, 2)
    select d.*, off.status from days d left join off using (report_date, basepack)"""
_CONTRIB = """select distinct basepack, sum(sec_ord_qty) over (partition by basepack) / sum(sec_ord_qty) over () as contribution from {secondary_daily}"""
_FILLED = "sum(sec_inv_qty){0} / nullif(sum(sec_ord_qty){0}, 0)"
_LONG = f"""with tag as ({_TAG}), con as ({_CONTRIB}),
    cells as (select strftime(report_date, '%Y-%m-%d') as report_date, basepack, unnest([
        {{'m': '1. Secondary Order Qty', 'v': sec_ord_qty, 't': null}}, {{'m': '2. Secondary Invoiced Qty', 'v': sec_inv_qty, 't': null}},
        {{'m': '3. SCCF', 'v': sec_inv_qty / nullif(sec_ord_qty, 0), 't': null}}, {{'m': '4. Primary Order Qty', 'v': prim_ord_qty, 't': null}},
        {{'m': '5. Dispatched Qty', 'v': prim_inv_qty, 't': null}}, {{'m': '6. DR', 'v': prim_inv_qty / nullif(prim_ord_qty, 0), 't': null}},
        {{'m': '7. Primary Status', 'v': null, 't': coalesce(map {{'constraint': 'constrainted', 'removed': 'removed'}}[status], if(prim_ord_qty is null, 'no data', 'on'))}}]) as c from tag),
    wholes as (select basepack, unnest([{{'r': 'Overall SCCF', 'v': {_FILLED.format("")}, 'n': count(*)}},
        {{'r': 'SCCF - Constrainted/Removed', 'v': {_FILLED.format(" filter (where status is not null)")}, 'n': count(status)}},
        {{'r': 'SCCF - not Constrainted/Removed', 'v': {_FILLED.format(" filter (where status is null)")}, 'n': count(*) - count(status)}}]) as c from tag group by basepack)
    select l.*, contribution from (select report_date, basepack, c.m as measure, c.v as val, c.t as status_text from cells
      union all select c.r, basepack, '3. SCCF', c.v, null from wholes where c.n > 0) l join con using (basepack)"""
add("c15_off_windows", lambda i: _windows(i).join(i.part.groupBy(F.col("p_brand").alias("basepack")).agg(F.count(F.lit(1)).alias("parts")), "basepack"),
    f"""select w.*, parts from {_WIN} w
    join (select p_brand as basepack, count(*) as parts from {{part}} group by 1) p using (basepack)""")
add("c15_tagged_days", _tagged, _TAG)
add("c15_contribution", lambda i: supply_off.contribution(i.secondary_daily), _CONTRIB)
add("c15_measures_long", _off_long, _LONG)
# the days of both sides come from the data, each by its own engine
add("c15_daily_pivot", lambda i: supply_off.daily_pivot(staged(_off_long(i))),
    f"select * from (pivot (select * from ({_LONG}) x where val is not null) on report_date using avg(val) group by contribution, basepack, measure)")
add("c15_status_pivot", lambda i: supply_off.status_pivot(staged(_off_long(i))),
    f"""select * from (pivot (select * from ({_LONG}) x where measure = '7. Primary Status') on report_date using max(status_text)
    group by contribution, basepack)""")


def _cond(tag: str, cond: str) -> str:
    o, v = f"sum(case when {cond} then sec_ord_qty end)", f"sum(case when {cond} then sec_inv_qty end)"
    return f"{o} as sec_ord_qty_{tag}, {v} as sec_inv_qty_{tag}, {v} / nullif({o}, 0) as sccf_{tag}"


add("c15_summary", lambda i: supply_off.summary(*_off_parts(i)),
    f"""select contribution, basepack, sum(sec_ord_qty) as sec_ord_qty, sum(sec_inv_qty) as sec_inv_qty, sum(sec_inv_qty) / nullif(sum(sec_ord_qty), 0) as sccf,
    {_cond('consrem', 'status is not null')}, {_cond('cons', "status = 'constraint'")}, {_cond('rem', "status = 'removed'")},
    {_cond('not_consrem', 'status is null')}, count(case when status = 'constraint' then 1 end) as days_cons,
    count(case when status = 'removed' then 1 end) as days_rem, count(case when status is not null then 1 end) as days_consrem
    from ({_TAG}) t join ({_CONTRIB}) c using (basepack) group by 1, 2""")


# --- retention cohorts ----------------------------------------------------------------------------------------------------

DIFFS = list(range(84))
_RET = """select left(cast(claim_date as varchar), 7) as claim_month, distributor_code, split_part(basepack, ' ', 1) as brand, reason, received_amount
    from {claims} join (select distinct * from {claim_product}) p using (material_desc)
    join (select distinct upper(sku) as basepack, category, business_group from {focus_list} where in_list ilike '%yes%') f using (basepack)"""


def _cohort_sql(by: str, where: str, amount: bool) -> str:
    """Each distributor's months are one list, paired within itself."""
    b, later = (f"{by}, " if by else ""), " and x.amt >= f.amt" if amount else ""
    return f"""with months as (select {b}distributor_code, claim_month as m, sum(received_amount) as amt from ({_RET}) r where {where} group by all),
      seen as (select {b}distributor_code, list({{'m': m, 'amt': amt}}) as every from months where distributor_code is not null group by all),
      firsts as (select *, unnest(every) as f from seen),
      pairs as (select {b}f.m as claim_month_from, unnest([x.m for x in every if x.m >= f.m{later}]) as claim_month_to from firsts),
      cells as (select {b}claim_month_from, claim_month_to, count(*) as distributors_ret, cast(12 * (left(claim_month_to, 4)::int - left(claim_month_from, 4)::int)
        + right(claim_month_to, 2)::int - right(claim_month_from, 2)::int as int) as month_diff from pairs group by all)
    select *, max(distributors_ret) filter (where month_diff = 0) over (partition by {b}claim_month_from) as distributors_init,
      distributors_ret / distributors_init as distributors_ret_pct from cells"""


def _c16(i: Inputs):
    return retention.retention_cohort(i.claims, i.claim_product, i.focus_list)


def _c17(i: Inputs):
    return retention.retention_cohort(i.claims, i.claim_product, i.focus_list, amount_rule=False, reason=None, by="brand")


_COH16, _COH17 = _cohort_sql("", "reason ilike '%expire%'", True), _cohort_sql("brand", "true", False)
add("c16_retention_cohort", _c16, _COH16)
add("c17_retention_by_brand", _c17, _COH17)
for _value, _name in (("distributors_ret", "number"), ("distributors_ret_pct", "pct")):
    _cells = ", ".join(f"sum(case when month_diff = {d} then {_value} end) as \"{d}\"" for d in DIFFS)
    _means = ", ".join(f"round(avg(\"{d}\"), 9) as \"{d}\"" for d in DIFFS)
    add(f"c16_pivot_{_name}", lambda i, v=_value: rounded(retention.cohort_pivot(_c16(i), DIFFS, v), *[str(d) for d in DIFFS]),
        f"""with piv as (select claim_month_from, {_cells} from ({_COH16}) c where month_diff is not null group by 1)
        select claim_month_from, {', '.join(f'round("{d}", 9) as "{d}"' for d in DIFFS)} from piv union all select 'avg.', {_means} from piv""")
    add(f"c17_means_{_name}", lambda i, v=_value: rounded(retention.brand_means(_c17(i), DIFFS, v), *[str(d) for d in DIFFS]),
        f"""with piv as (select brand, claim_month_from, {_cells} from ({_COH17}) c where month_diff is not null group by 1, 2)
        select brand, {_means} from piv group by 1""")
