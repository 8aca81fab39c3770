"""Input roles derived from the star-schema tables.

A role is one portable SELECT over whole tables. ``{name}`` stands for another role or a
table, so the same text gives Spark its input frame and the check engine its subquery.
Quantities are whole numbers and divisors powers of two where sums follow, so sums are
exact in both engines; money is decimal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.session import SHARED_KEY, bucketed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SIZE_CLASS = "case when p_size <= 12 then 'A' when p_size <= 25 then 'B' when p_size <= 38 then 'C' else 'D' end"
BRAND_CLASS = ("case when length(p_brand) = 7 then 'A' when p_brand < 'Brand#15' then 'B' when p_brand < 'Brand#2' then 'C' "
               "else 'D' end")

ROLES = {
    # --- shared facts -----------------------------------------------------------------------------------------------------
    "lines": """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity as qty, l_tax, l_discount,
        cast(l_extendedprice as decimal(18,2)) as value, l_returnflag as rf, l_linestatus as ls,
        cast(l_shipdate as date) as ship_day, o_custkey, o_orderstatus as os, cast(o_orderdate as date) as order_day,
        o_orderpriority from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "towns": """select c_custkey, c_name, c_mktsegment, c_acctbal, n_nationkey, n_name, r_name
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "sales": """select s.*, t.c_name, t.c_mktsegment, t.n_nationkey, t.n_name, t.r_name, p.p_name, p.p_brand, p.p_type, p.p_size,
        cast(p.p_retailprice as decimal(18,2)) as p_retailprice
        from {lines} s join {towns} t on s.o_custkey = t.c_custkey join {part} p on s.l_partkey = p.p_partkey""",
    "supply": """select l_partkey, l_quantity as qty, l_tax, l_linenumber, l_returnflag as rf, l_linestatus as ls, s_nationkey, n_name,
        r_name, p_name, p_brand, p_type, p_size
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
        join {region} on n_regionkey = r_regionkey join {part} on l_partkey = p_partkey""",
    # --- stock and norm by item -------------------------------------------------------------------------------------------
    "depot_stock": """select cast(s_nationkey as string) as depot_code, 'ITEM-' || cast(l_partkey as string) as basepack,
        case when rf = 'A' then 'BF02' else 'BF01' end as storage_loc,
        case when ls = 'O' and l_tax > 0.04 then qty else 0.0 end as in_transit,
        case when ls = 'O' and l_tax <= 0.04 then qty else 0.0 end as available from {supply}""",
    "norm": """select o_custkey as customer_code, c_name as customer_name, l_partkey as basepack_code,
        'ITEM-' || cast(l_partkey as string) as basepack, n_name as town, n_name as depot_name, sum(qty) as norm_qty,
        sum(case when ls = 'O' then qty else 0.0 end) as on_hand,
        sum(case when ls = 'O' and os = 'P' then qty else 0.0 end) as in_transit,
        sum(case when ls = 'O' and rf = 'A' then qty else 0.0 end) as open_order,
        sum(case when rf = 'N' then qty else 0.0 end) as proposed_qty, max(p_retailprice) as price
        from {sales} group by o_custkey, c_name, l_partkey, n_name""",
    "plant_map": "select cast(n_nationkey as string) as depot_code, n_name as depot_name from {nation}",
    "plan_item": """select 'ITEM-' || cast(l_partkey as string) as basepack, sum(case when ls = 'F' then qty else 0.0 end) as primary_vol,
        sum(case when ls = 'O' and rf = 'N' then qty else 0.0 end) as secondary_vol, p_name as remark
        from {sales} group by l_partkey, p_name""",
    "item_kpi": """select 'ITEM-' || cast(l_partkey as string) as basepack, sum(qty) as contribution,
        floor(sum(case when rf = 'R' then 0.0 else qty end) / sum(qty) * 1024) / 1024.0e0 as achievement
        from {lines} group by l_partkey""",
    "daily_kpi": """select basepack, 'Secondary Achievement' as attribute, cast(achievement as double) as value from {item_kpi}
        union all select basepack, 'Business Contribution' as attribute, cast(contribution as double) as value from {item_kpi}""",
    # --- returns ----------------------------------------------------------------------------------------------------------
    "visits": """select 'C' || cast(o_custkey as string) as outlet_code, c_mktsegment as channel, cast(l_partkey as string) as sku_code,
        p_name as sku_desc, o_orderpriority as reason, qty as qty_pc, cast(value as double) as value from {sales} where rf = 'R'""",
    "outlet_geo": """select 'C' || cast(c_custkey as string) as outlet_code, r_name as region, c_mktsegment as area,
        n_name as territory, n_name as town, 'R' || cast(n_nationkey as string) as route_code from {towns}""",
    "product_pack": "select p_partkey as material, p_type || ' ' || p_brand as basepack from {part}",
    "ps_list": "select distinct p_type || ' ' || p_brand as sku from {part} where p_type = 'PROMO'",
    "ns_list": "select distinct p_type || ' ' || p_brand as sku from {part} where p_type in ('SMALL', 'LARGE')",
    # --- orders by brand --------------------------------------------------------------------------------------------------
    "hht_orders": """select c_mktsegment as class, p_brand as basepack, p_type as category, n_name as town, o_orderpriority as company,
        case when rf = 'R' then 0.0 else qty end as order_qty from {sales}""",
    # --- activation -------------------------------------------------------------------------------------------------------
    "families": "select p_partkey, cast(floor(p_partkey / 4.0e0) as bigint) as code, p_name, p_size, p_retailprice from {part}",
    "family_product": "select p_partkey as material, 'FAMILY-' || cast(code as string) as basepack, code as basepack_code from {families}",
    "activation_1": """select distinct 'FAMILY-' || cast(code as string) as basepack, p_partkey as activity_code, p_name as description,
        case when p_size < 10 then 1 else 0 end as subs from {lines} join {families} on l_partkey = p_partkey where os = 'P'""",
    "activation_2": """select distinct 'FAMILY-' || cast(code as string) as basepack, p_partkey as activity_code_remove, p_name as description,
        p_partkey as post_code, case when p_size > 42 then 1 else 0 end as post_subs
        from {lines} join {families} on l_partkey = p_partkey where os = 'F'""",
    "active": """select code as basepack_code, p_partkey as material_code from {lines} join {families} on l_partkey = p_partkey
        where os = 'O' and ls = 'O' and rf = 'N'""",
    "allocation": """select code as basepack_code, 'FAMILY-' || cast(code as string) as basepack_desc, p_partkey as material_code,
        p_name as material_desc, case when rf = 'A' then qty else 0.0 end as allocated_qty
        from {lines} join {families} on l_partkey = p_partkey""",
    "price": "select code as basepack_code, p_partkey as material_code, p_name as material_desc, p_retailprice as retail_price from {families}",
    # --- scorecard --------------------------------------------------------------------------------------------------------
    "brand_day": """select p_brand as basepack, ship_day, sum(qty) as orders, sum(case when ls = 'O' then qty else 0.0 end) as stock,
        sum(case when ls = 'F' then qty else 0.0 end) as prim, sum(case when rf = 'N' then qty else 0.0 end) as contrib
        from {sales} group by p_brand, ship_day""",
    # --- loss and fill ----------------------------------------------------------------------------------------------------
    "sccf_outlet": """select cast(year(ship_day) as string) as month, n_name as town, 'outlet ' || cast(o_custkey as string) as outlet,
        c_mktsegment as channel, qty as ord_qty, case when rf = 'R' then 0.0 else qty end as inv_qty,
        case when rf = 'R' then qty else 0.0 end as loss_qty, r_name as region from {sales}""",
    "outlet_type": """select 'Outlet ' || cast(c_custkey as string) as outlet, case when c_acctbal < 5000 then 'Small' else 'Large' end as type
        from {customer} where c_acctbal >= 0""",
    # --- norm value by name -----------------------------------------------------------------------------------------------
    "depot_name_stock": """select cast(s_nationkey as string) as depot_code, p_name as basepack,
        case when rf = 'A' then 'BF02' else 'BF01' end as storage_loc, case when ls = 'O' then qty else 0.0 end as in_transit,
        case when l_tax <= 0.04 then qty else 0.0 end as available from {supply}""",
    "norm_name": """select p_name as basepack, qty as norm_qty, case when ls = 'O' then qty else 0.0 end as on_hand,
        case when os = 'P' then qty else 0.0 end as in_transit, case when rf = 'A' then qty else 0.0 end as open_order,
        p_retailprice as price from {sales}""",
    "plan_name": "select p_name as basepack, cast(sum(value) as double) as month_value from {sales} group by p_name",
    # --- loss attribution -------------------------------------------------------------------------------------------------
    "month_lines": """select s.*, cast(date_trunc('month', ship_day) as date) as month_day from {sales} s""",
    "sccf_daily": """select '01.' || lpad(cast(month(month_day) as string), 2, '0') || '.' || cast(year(month_day) as string) as report_date,
        r_name as region, n_name as town, l_partkey as material, p_name as material_desc, p_brand as pack_size, qty as final_order_qty,
        case when rf = 'R' then cast(floor(qty / 2) as double) else qty end as invoiced_qty,
        case when rf = 'R' then cast(floor(qty / 2) as double) else qty end / qty * 100.0e0 as case_fill_pct from {month_lines}""",
    "cp_master": "select p_partkey as material, case when p_size <= 10 then 'F070' else 'F001' end as material_group from {part}",
    "closing_stock": """select r_name as region, n_name as town, l_partkey as material, p_name as material_desc, p_brand as pack_size,
        month_day as date, qty as stock_cs from {month_lines} where ls = 'O'""",
    "primary_dr": """select p_brand as pack_size, case when os = 'F' then qty else 0.0 end as dispatched_qty, qty as expected_order_qty
        from {sales}""",
    "scorecard": """select distinct substr(report_date, 4, 7) as month, 0.5e0 + month(month_day) / 32.0e0 as sccf_card
        from (select '01.' || lpad(cast(month(month_day) as string), 2, '0') || '.' || cast(year(month_day) as string) as report_date, month_day
        from {month_lines}) as m""",
    # --- understock -------------------------------------------------------------------------------------------------------
    "rpl_slim": """select lower(n_name) as town, 'item-' || cast(l_partkey as string) as basepack, '09 Nov 2001' as date,
        sum(case when ls = 'O' then qty else 0.0 end) as on_hand, case when p_type = 'PROMO' then 'Winter' else 'A' end as class,
        sum(qty) as norm_qty, sum(case when rf = 'R' then 0.0 else qty end) / 16 as per_day_sales
        from {sales} group by n_name, l_partkey, p_type""",
    "town_sku_target": """select n_name as town, 'Item-' || cast(l_partkey as string) as basepack, sum(qty) / 1024 as tgt_cr
        from {sales} group by n_name, l_partkey""",
    "lifting_plan": "select n_name as town, count(*) / 16.0e0 as plan from {towns} group by n_name",
    "confirmed": "select n_name as town, cast(value as double) as confirmed_value from {sales} where rf = 'A' and ls = 'O'",
    # --- outlet growth ----------------------------------------------------------------------------------------------------
    "outlet_month": """select 'C' || cast(o_custkey as string) as outlet_code, p_brand as basepack, cast(year(ship_day) as int) as yr,
        cast(month(ship_day) as int) as mon, sum(qty) as qty from {sales} group by o_custkey, p_brand, year(ship_day), month(ship_day)""",
    # --- target match -----------------------------------------------------------------------------------------------------
    "depot_plan": """select r_name as depot, n_name as town, case when count(*) < 55 then '\n' else cast(count(*) * 3 as string) end as plan
        from {towns} group by r_name, n_name
        union all select r_name as depot, r_name || ' TOTAL' as town, cast(count(*) * 3 as string) as plan from {towns} group by r_name""",
    "alloc_value": "select n_name as town, value as allocated_value from {sales} where rf = 'A'",
    "c_class": "select r_name as depot, p_brand as basepack from {supply} where p_size <= 5 and rf = 'R'",
    "plant_region": """select cast(n_nationkey as string) as depot_code, r_name as depot_name
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "depot_brand_stock": """select cast(s_nationkey as string) as depot_code, p_brand as basepack,
        case when rf = 'A' then 'BF02' else 'BF01' end as storage_loc, 0.0e0 as in_transit, qty * l_linenumber as available from {supply}""",
    # --- days on hand -----------------------------------------------------------------------------------------------------
    "rpl_stock": """select lower(n_name) as town, p_brand as basepack, sum(case when ls = 'O' then qty else 0.0 end) as on_hand
        from {sales} group by n_name, p_brand, os""",
    "sccf_month": "select n_name as town, lower(p_brand) as basepack, qty as ord_qty, case when rf = 'R' then 0.0 else qty end as inv_qty from {sales}",
    "sku_target": """select p_brand as basepack, case when p_size < 25 then 'food' else 'care' end as business_group, p_type as category,
        qty / 64 as tgt_cr from {sales}""",
    "national_class": f"select distinct lower(p_brand) as basepack, {BRAND_CLASS} as classification from {{part}}",
    "town_class": f"select distinct n_name as town, p_brand as basepack, {BRAND_CLASS} as classification from {{sales}}",
    "national_rr": """select p_brand as basepack, case when p_brand = 'Brand#7' then 0.0 else sum(qty) / 64 end as rr_3m, sum(qty) / 128 as rr_6m
        from {sales} where p_brand <> 'Brand#9' group by p_brand""",
    "town_rr": """select n_name as town, p_brand as basepack, qty / 64 as rr_3m, qty / 128 as rr_6m from {sales} where os = 'F'""",
    # --- overstock --------------------------------------------------------------------------------------------------------
    "rpl_town": """select n_name as town, p_brand as basepack, case when rf = 'N' then qty else 0.0 end as proposed_qty, qty as norm_qty,
        case when ls = 'O' then qty else 0.0 end as on_hand from {sales}""",
    # --- supply off -------------------------------------------------------------------------------------------------------
    "primary_daily": """select order_day as report_date, p_brand as basepack, qty as prim_ord_qty, case when ls = 'F' then qty else 0.0 end as prim_inv_qty
        from {sales}""",
    "secondary_daily": """select ship_day as report_date, p_brand as basepack, qty as sec_ord_qty, case when rf = 'R' then 0.0 else qty end as sec_inv_qty
        from {sales}""",
    # --- retention --------------------------------------------------------------------------------------------------------
    "claims": """select ship_day as claim_date, o_custkey as distributor_code, 'M' || cast(l_partkey as string) as material_desc,
        case when ls = 'O' then 'Expired in store' else 'Damaged' end as reason, value as received_amount from {lines} where rf = 'R'""",
    "claim_product": "select 'M' || cast(p_partkey as string) as material_desc, upper(p_type || ' ' || p_brand) as basepack from {part}",
    "focus_list": """select lower(p_type) || ' ' || p_brand as sku, p_type as category, 'bg' as business_group,
        case when p_type in ('PROMO', 'SMALL', 'MEDIUM') then 'Yes - core' else 'No' end as in_list from {part}""",
    # --- replenishment ----------------------------------------------------------------------------------------------------
    "rpl_yesterday": """select cast(o_custkey as bigint) as customer_code, c_name as customer_name, l_partkey as sku_code,
        p_name as sku_desc, sum(case when rf = 'N' then qty else 0.0 end) as proposed_qty,
        case when p_size <= 3 then 0.0e0 else cast(p_retailprice as double) end as price,
        sum(case when rf = 'A' then 0.0 else qty end) as norm_qty, cast(max(l_linenumber) - 1 as double) as cover_days,
        sum(case when ls = 'O' then qty else 0.0 end) as on_hand, sum(case when os = 'P' and ls = 'F' then qty else 0.0 end) as in_transit,
        sum(case when rf = 'A' and ls = 'O' then qty else 0.0 end) as open_order,
        cast(sum(case when rf = 'N' then value else 0 end) as double) as ppo_value, min(l_orderkey) as ingest_pos
        from {sales} group by o_custkey, c_name, l_partkey, p_name, p_size, p_retailprice""",
    "rpl_product": """select p_partkey as material, p_type || ' ' || p_brand as basepack, cast(floor(p_partkey / 8.0e0) as bigint) as basepack_code,
        p_type as category, case when p_type = 'MEDIUM' then 'B' else 'A' end as company from {part}""",
    "proposed_order": """select o_custkey as customer_code, l_partkey as sku_code, max(qty) as new_proposed_qty
        from {lines} where l_tax >= 0.07 group by o_custkey, l_partkey""",
    "cust_pack": """select o_custkey as customer_code, cast(floor(l_partkey / 8.0e0) as bigint) as basepack_code, max(l_linenumber) as top_line,
        sum(qty) as qty, sum(case when rf = 'R' then qty else 0.0 end) as returned,
        sum(case when ls = 'F' then qty else 0.0 end) as closed, min(l_partkey) as low_part
        from {lines} group by o_custkey, cast(floor(l_partkey / 8.0e0) as bigint)""",
    "cover_days": "select customer_code, basepack_code, cast(top_line as double) as new_cover_days from {cust_pack} where top_line > 4",
    "sku_master_1": "select p_partkey as sku_code, cast(p_retailprice as double) as price, p_type as category from {part}",
    "sku_master_2": "select p_partkey as sku_code, cast(p_retailprice as double) + 1 as price, p_type as category from {part}",
    "sku_master": """select sku_code, price, category, 'A' as company from {sku_master_1} where category <> 'MEDIUM' or category is null
        union all select sku_code, price, category, 'B' as company from {sku_master_2} where category = 'MEDIUM'""",
    "inventory": """select o_custkey as customer_code, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1532 else 1500 end as company_code,
        case when o_orderstatus = 'P' then 'Not Update' else 'Sent' end as status, o_orderkey as ingest_pos from {orders}
        where o_orderstatus <> 'F'""",
    "lock": """select o_custkey as customer_code, l_partkey as sku_code, min(l_linenumber) * 10.0e0 - 20 as lower_band, max(qty) * 2 as upper_band
        from {lines} where l_discount >= 0.03 group by o_custkey, l_partkey""",
    "dr": """select customer_code, basepack_code, qty as `Final Customer Qty W1`, returned as `Final Customer Qty W2`,
        closed as `Dispatched Qty W1`, cast(null as double) as `Dispatched Qty W2` from {cust_pack} where top_line > 2""",
    "fund": """select c_custkey as customer_code, case when c_acctbal < 0 then 'Blocked' when c_acctbal < 2000 then 'Active' end as comment,
        'A' as company from {customer} where c_acctbal < 4000
        union all select c_custkey, 'Low balance' as comment, 'B' as company from {customer} where c_acctbal < 500""",
    "pdp": """select *, 'A' as company from {pdp_base} union all select *, 'B' as company from {pdp_base}""",
    "pdp_base": """select c_custkey as customer_code, r_name as region, c_mktsegment as area, n_name as town, 'D-' || n_name as depot_name,
        'N' as SAT, 'Y' as SUN, c_mktsegment as MON, 'Y' as TUE, n_name as WED, 'N' as THU, r_name as FRI
        from {towns} where c_acctbal > -500""",
    "rr": "select customer_code, basepack_code, returned / 16 as l6_daily_rr from {cust_pack} where returned > 0 or top_line > 5",
    "abc": """select customer_code, basepack_code, case when qty > 60 then 'A' when qty > 35 then 'B' else 'C' end as classification
        from {cust_pack} where qty > 10""",
    "winter": """select distinct cast(floor(p_partkey / 8.0e0) as bigint) as basepack_code, 'Winter' as winter from {part}
        where p_size = 50""",
    "nmsm": """select customer_code, basepack_code, 'A' as company, 'NMSM' as nmsm_tag from {cust_pack} where closed > 20""",
}

_NAME = re.compile(r"\{(\w+)\}")


#: Rows of one task where large tables are joined or folded by fine keys: what it sorts and hashes then stays within a page or two of
#: memory for each step. Spark merges partitions by their compressed size, and rows that pack well take many times that in memory; a number
#: of partitions that is given stays.
TASK_ROWS = 200_000
#: Tables whose facts make fewer tasks than this are left to Spark.
FEW_TASKS = 10
#: Most tasks, as many as a table of Spark's may have buckets.
MOST_TASKS = 100_000

_PAIR = ("o_custkey", "l_partkey")
_PACK = ("o_custkey", "cast(floor(l_partkey / 8.0e0) as bigint)")
#: Roles over the facts that are hashed as a whole before they are folded: the facts' role and the keys of the fold.
SPREAD = {"rpl_yesterday": ("sales", _PAIR), "proposed_order": ("lines", _PAIR), "lock": ("lines", _PAIR), "cust_pack": ("lines", _PACK),
          **{role: ("lines", _PACK) for role in ("cover_days", "dr", "rr", "abc", "nmsm")},
          "primary_daily": ("sales", ()), "secondary_daily": ("sales", ())}
#: The lines of a customer and item, folded once for the roles that large tables take from them. Sums of sums, least and greatest values give
#: these roles the same rows as the lines do.
PAIRS = """select o_custkey, l_partkey, min(l_orderkey) as first_order, max(l_linenumber) as top_line, sum(qty) as qty,
    sum(case when rf = 'N' then qty else 0.0 end) as fresh, sum(case when rf = 'A' then 0.0 else qty end) as kept,
    sum(case when rf = 'R' then qty else 0.0 end) as returned, sum(case when ls = 'O' then qty else 0.0 end) as open,
    sum(case when ls = 'F' then qty else 0.0 end) as closed, sum(case when os = 'P' and ls = 'F' then qty else 0.0 end) as sent,
    sum(case when rf = 'A' and ls = 'O' then qty else 0.0 end) as ordered, sum(case when rf = 'N' then value else 0 end) as fresh_value,
    bool_or(l_discount >= 0.03) as locked, min(case when l_discount >= 0.03 then l_linenumber end) as lock_line,
    max(case when l_discount >= 0.03 then qty end) as lock_qty from {lines} group by o_custkey, l_partkey"""
PAIRED = {
    "rpl_yesterday": """select cast(o_custkey as bigint) as customer_code, c_name as customer_name, l_partkey as sku_code, p_name as sku_desc,
        sum(fresh) as proposed_qty, case when p_size <= 3 then 0.0e0 else cast(p_retailprice as double) end as price,
        sum(kept) as norm_qty, cast(max(top_line) - 1 as double) as cover_days, sum(open) as on_hand, sum(sent) as in_transit,
        sum(ordered) as open_order, cast(sum(fresh_value) as double) as ppo_value, min(first_order) as ingest_pos
        from (select s.*, c_name, p_name, p_size, cast(p_retailprice as decimal(18,2)) as p_retailprice
        from {pairs} s join {towns} t on o_custkey = c_custkey join {part} p on l_partkey = p_partkey) x
        group by o_custkey, c_name, l_partkey, p_name, p_size, p_retailprice""",
    "lock": """select o_custkey as customer_code, l_partkey as sku_code, lock_line * 10.0e0 - 20 as lower_band, lock_qty * 2 as upper_band
        from {pairs} where locked""",
    "cust_pack": """select o_custkey as customer_code, cast(floor(l_partkey / 8.0e0) as bigint) as basepack_code, max(top_line) as top_line,
        sum(qty) as qty, sum(returned) as returned, sum(closed) as closed, min(l_partkey) as low_part
        from {pairs} group by o_custkey, cast(floor(l_partkey / 8.0e0) as bigint)""",
}
#: Roles read from these.
FROM_PAIRS = {"rpl_yesterday", "lock", "cust_pack", "cover_days", "dr", "rr", "abc", "nmsm"}

#: Tables hashed by the key of their join with the facts.
_HASHED = {"lineitem": "l_orderkey", "customer": "c_custkey", "part": "p_partkey"}


def expand(text: str, table, held: dict[str, str] | None = None) -> str:
    """Replace every ``{name}`` by its role's subquery or the table's reference; ``held`` names views that stand for a role."""
    def sub(m):
        name = m.group(1)
        if held and name in held:
            return held[name]
        if name in ROLES:
            return "(" + expand(ROLES[name], table, held) + ")"
        return table(name)
    return _NAME.sub(sub, text)


def frame(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """The role as a frame; a table name gives the table itself."""
    views = _views(spark, sf_dir)
    n = tasks(spark, sf_dir) if role in SPREAD else None
    held = (_paired_views(spark, sf_dir, n) if role in FROM_PAIRS else {SPREAD[role][0]: _spread_view(spark, sf_dir, *SPREAD[role], n)}) if n else None
    return spark.sql(expand("select * from {" + role + "}", views.__getitem__, held))


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the rows of the facts (counted from the file footers, once per session); none if they are few."""
    known = spark.__dict__.setdefault("_stocktide_rows", {})
    if sf_dir not in known:
        known[sf_dir] = spark.table(_views(spark, sf_dir)["lineitem"]).count()
    n = -(-known[sf_dir] // TASK_ROWS)
    return min(n, MOST_TASKS) if n >= FEW_TASKS else None


def _spread_view(spark: SparkSession, sf_dir: str, role: str, keys: tuple[str, ...], n: int) -> str:
    """A view with the rows of ``lines`` or ``sales``, joined in ``n`` tasks at each step and hashed by ``keys``."""
    views = _hashed_views(spark, sf_dir, n)
    if role == "sales":
        towns = expand("select o.*, t.* except (c_custkey, c_acctbal) from {orders} o join {towns} t on o_custkey = c_custkey", views.__getitem__)
        lines = ROLES["lines"].replace(" from {lineitem} join {orders}", f", c_name, c_mktsegment, n_nationkey, n_name, r_name from {{lineitem}} join ({towns})")
        text = """select l.* except (c_name, c_mktsegment, n_nationkey, n_name, r_name), c_name, c_mktsegment, n_nationkey, n_name, r_name, p_name, p_brand,
            p_type, p_size, cast(p_retailprice as decimal(18,2)) as p_retailprice from (""" + lines + ") l join {part} on l_partkey = p_partkey"
    else:
        text = ROLES[role]
    rows = spark.sql(expand(text, views.__getitem__))
    name = f"{views['orders']}_{role}_{n}_{'_'.join(re.findall(r'[a-z]_[a-z]+', ' '.join(keys)))}{'_pack' if keys == _PACK else ''}"
    return _named(name, rows.repartition(n, *map(F.expr, keys)) if keys else rows)


def _hashed_views(spark: SparkSession, sf_dir: str, n: int) -> dict[str, str]:
    views = dict(_views(spark, sf_dir))
    for t, key in _HASHED.items():
        views[t] = _named(f"{views[t]}_{n}", spark.table(views[t]).repartition(n, key))
    return views


def _paired_views(spark: SparkSession, sf_dir: str, n: int) -> dict[str, str]:
    """Views of the roles over ``PAIRS``, which is written once per session and state of the files, in ``n`` buckets by customer: what is
    joined or folded by customer (and item, or pack) reads its buckets, and the lines are joined and shuffled once for all these roles."""
    for key, value in SHARED_KEY.items():
        spark.conf.set(key, value)
    known = spark.__dict__.setdefault("_stocktide_pairs", {})
    made_of = (sf_dir, n, *_state(spark, sf_dir))
    if made_of not in known:
        lines = _spread_view(spark, sf_dir, "lines", ("o_custkey",), n)
        pairs = bucketed(spark.sql(expand(PAIRS, {}.__getitem__, {"lines": lines})), "stocktide_pairs", n, "o_custkey", "l_partkey")
        views = _hashed_views(spark, sf_dir, n)
        known[made_of] = {role: _named(f"{pairs}_{role}", spark.sql(expand(text, views.__getitem__, {"pairs": pairs}))) for role, text in PAIRED.items()}
    return known[made_of]


def _state(spark: SparkSession, sf_dir: str):
    """Number, bytes and newest time of the files of the lines, from their listing."""
    files = [spark.read.format("binaryFile").load(f"{sf_dir}/{t}.parquet").select("length", "modificationTime") for t in ("lineitem", "orders")]
    return files[0].union(files[1]).agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first()


def _named(name: str, df: DataFrame) -> str:
    df.createOrReplaceTempView(name)
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, name)


def _views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """One temp view per table and folder, so a table's footer is read once per session."""
    known = spark.__dict__.setdefault("_stocktide_views", {})
    if sf_dir not in known:
        names = {}
        for t in TABLES:
            names[t] = f"stocktide_{len(known)}_{t}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(names[t])
        known[sf_dir] = names
    return known[sf_dir]


def oracle(text: str) -> str:
    """SQL over the registered views."""
    return expand(text, lambda t: t).replace("`", '"')
