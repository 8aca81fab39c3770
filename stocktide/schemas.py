"""Input roles: one schema per table the operators read."""

from __future__ import annotations

from pyspark.sql.types import StructType

ROLES: dict[str, str] = {
    "depot_stock": "depot_code string, basepack string, storage_loc string, in_transit double, available double",
    "norm": "customer_code long, customer_name string, basepack_code long, basepack string, town string, "
            "depot_name string, norm_qty double, on_hand double, in_transit double, open_order double, "
            "proposed_qty double, price double",
    "rpl_slim": "town string, basepack string, date string, on_hand double, inv_status string, class string, "
                "norm_qty double, per_day_sales double, defaulter string, ppo_value double",
    "rpl_stock": "town string, basepack string, on_hand double, category string, classification string",
    "plan_volval": "basepack string, primary_vol double, secondary_vol double, month_value double, remark string",
    "plant_map": "depot_code string, depot_name string",
    "daily_eav": "basepack string, attribute string, date date, value double",
    "visits": "outlet_code string, outlet_name string, channel string, route string, sso string, sku_code string, "
              "sku_desc string, pack_size string, reason string, qty_ctn double, qty_pc double, price_ctn double, "
              "value double, secondary_sales double, damage_pct double, company_code string",
    "outlet_geo": "outlet_code string, region string, area string, territory string, town string, route_code string",
    "product": "material long, basepack string, basepack_code long, category string, company string",
    "sku_list": "sku string",
    "hht_orders": "class string, basepack string, category string, town string, company string, order_qty double",
    "activation_1": "basepack string, activity_code long, description string, subs int",
    "activation_2": "basepack string, activity_code_remove long, description string, post_code long, post_subs int",
    "active": "basepack_code long, material_code long",
    "allocation": "basepack_code long, basepack_desc string, material_code long, material_desc string, "
                  "allocated_qty double",
    "price": "basepack_code long, material_code long, material_desc string, retail_price double",
    "sccf_outlet": "month string, town string, outlet string, channel string, ord_qty double, inv_qty double, "
                   "loss_qty double, ccf double, region string",
    "outlet_type": "outlet string, type string",
    "sccf_daily": "report_date string, region string, town string, material long, material_desc string, "
                  "pack_size string, final_order_qty double, invoiced_qty double, case_fill_pct double",
    "cp_master": "material long, material_group string",
    "closing_stock": "region string, town string, material long, material_desc string, pack_size string, "
                     "date date, stock_cs double",
    "primary_dr": "pack_size string, dispatched_qty double, expected_order_qty double",
    "scorecard": "month string, sccf_card double",
    "lifting_plan": "region string, area string, cust_code string, town string, plan double, manual_plan double, "
                    "full_manual double, inv_date string, opd string",
    "confirmed": "town string, confirmed_value double",
    "town_sku_target": "town string, basepack string, tgt_cr double",
    "sku_target": "basepack string, business_group string, category string, tgt_cr double",
    "outlet_sku_year": "source string, pos long, outlet_code string, basepack string, month int, qty double",
    "depot_plan": "depot string, town string, plan string",
    "alloc_value": "town string, allocated_value double",
    "c_class": "depot string, basepack string",
    "sccf_month": "town string, basepack string, ord_qty double, inv_qty double",
    "national_class": "basepack string, classification string",
    "town_class": "town string, basepack string, basepack_code long, sale_val double, contrib double, "
                  "classification string",
    "national_rr": "basepack string, rr_3m double, rr_6m double",
    "town_rr": "town string, basepack string, rr_3m double, rr_6m double",
    "off_windows": "basepack string, start_date date, end_date date, status string",
    "primary_daily": "report_date date, basepack string, prim_ord_qty double, prim_inv_qty double",
    "claims": "claim_date date, distributor_code long, material_desc string, reason string, received_amount double",
    "focus_list": "sku string, category string, business_group string, in_list string",
    "rpl_yesterday": "ingest_pos long, customer_code long, customer_name string, sku_code long, sku_desc string, "
                     "proposed_qty double, price double, norm_qty double, cover_days double, on_hand double, "
                     "in_transit double, open_order double, ppo_value double",
    "nmsm": "customer_code long, basepack_code long, company string, nmsm_tag string",
    "pdp": "customer_code long, company string, region string, area string, town string, depot_name string, "
           "SAT string, SUN string, MON string, TUE string, WED string, THU string, FRI string",
    "sku_master": "sku_code long, price double, category string",
    "rr": "customer_code long, basepack_code long, l6_daily_rr double",
    "abc": "customer_code long, basepack_code long, classification string",
    "winter": "basepack_code long, winter string",
    "cover_days": "customer_code long, basepack_code long, new_cover_days double",
    "inventory": "ingest_pos long, company_code int, customer_code long, status string",
    "lock": "customer_code long, sku_code long, lower_band double, upper_band double",
    "fund": "customer_code long, comment string, company string",
    "proposed_order": "customer_code long, sku_code long, new_proposed_qty double",
}


def schema(role: str) -> StructType:
    return StructType.fromDDL(ROLES[role])
