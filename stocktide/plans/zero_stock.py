"""Items with no stock that can still be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import STORAGE_LOC
from stocktide.functions import mean, sum_strict, total, total_when
from stocktide.operators.joining import semi
from stocktide.session import as_is

ACHIEVEMENT, CONTRIBUTION = "Secondary Achievement", "Business Contribution"
SHEET_ORDER = {"both_stock_0_live": ["-business_contribution", "secondary_achievement"]}


def kpi_table(daily: DataFrame) -> DataFrame:
    """Attribute rows to one row per basepack, in one pass."""
    attr = F.col("attribute")
    return daily.where(attr.isin(ACHIEVEMENT, CONTRIBUTION)).groupBy("basepack").agg(
        total_when(attr == ACHIEVEMENT, "value").alias("secondary_achievement"),
        total_when(attr == CONTRIBUTION, "value").alias("business_contribution"))


def depot_totals(depot_stock: DataFrame, loc: str = STORAGE_LOC) -> DataFrame:
    return depot_stock.where(F.col("storage_loc") == loc).groupBy("depot_code", "basepack").agg(
        total(sum_strict("in_transit", "available")).alias("depot_stock"))


def customer_rows(norm: DataFrame) -> DataFrame:
    return norm.select("customer_code", "customer_name", "basepack_code", "basepack", "norm_qty", "town", "depot_name",
                       sum_strict("on_hand", "in_transit", "open_order").alias("customer_stock"))


def zero_stock_live(depot_stock: DataFrame, norm: DataFrame, plant_map: DataFrame, plan: DataFrame,
                    daily_kpi: DataFrame, loc: str = STORAGE_LOC, stage=as_is) -> dict[str, DataFrame]:
    """Six sheets: depot zero, depot zero by customer, customer zero, both zero, plan mismatch, summary."""
    depots = stage(depot_totals(depot_stock, loc))
    plants = plant_map.select("depot_code", "depot_name")
    customers = customer_rows(norm)
    empty_depots = depots.where(F.col("depot_stock") == 0)
    empty_customers = customers.where(F.col("customer_stock") == 0)
    kpis = kpi_table(daily_kpi)

    depot_zero = semi(empty_depots, norm, ["basepack"]).join(plants, "depot_code")
    located = customers.join(plants, "depot_name")
    located_empty = empty_customers.join(plants, "depot_name")
    both_zero = stage(located_empty.join(empty_depots, ["depot_code", "basepack"]).join(kpis, "basepack", "left")
                 .where((F.col("secondary_achievement") < 1) & F.col("business_contribution").isNotNull()))
    mismatch = plan.where((F.col("secondary_vol") == 0) & (F.col("primary_vol") > 0)).select(
        "basepack", "primary_vol", "secondary_vol", "remark")
    summary = both_zero.select("basepack", "secondary_achievement", "business_contribution").distinct().agg(
        F.count("basepack").alias("basepacks"), total("business_contribution").alias("business_contribution"),
        mean("secondary_achievement").alias("secondary_achievement"))
    return {
        "depot_stock_0": depot_zero,
        "depot_stock_0_live": located.join(depot_zero.drop("depot_name"), ["depot_code", "basepack"]),
        "customer_stock_0_live": located_empty.join(depots, ["depot_code", "basepack"]),
        "both_stock_0_live": both_zero,
        "plan_mismatch_live": customers.join(mismatch, "basepack"),
        "summary": summary,
    }
