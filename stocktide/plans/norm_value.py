"""Norm, depot stock and customer stock value against the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import CRORE, STORAGE_LOC
from stocktide.functions import mean, sum_strict, total


def stock_vs_target(depot: DataFrame, norm: DataFrame, plan: DataFrame, include: str, exclude: str,
                    loc: str = STORAGE_LOC) -> DataFrame:
    """Each side is aggregated to basepack before the joins."""
    picked = F.col("basepack").ilike(include) & ~F.col("basepack").ilike(exclude)
    stock = depot.where((F.col("storage_loc") == loc) & picked).groupBy("basepack").agg(
        total(sum_strict("in_transit", "available")).alias("depot_stock_qty"))
    norms = norm.where(picked).groupBy("basepack").agg(
        total("norm_qty").alias("norm_qty"), total(sum_strict("on_hand", "in_transit", "open_order")).alias("customer_stock_qty"),
        mean("price").alias("_price"))
    target = plan.groupBy("basepack").agg(total("month_value").alias("tgt_crore"))

    def crore(c):
        return (F.col(c) * F.col("_price") / float(CRORE))

    return stock.join(norms, "basepack").join(target, "basepack").select(
        "basepack", "norm_qty", crore("norm_qty").alias("norm_val_crore"),
        "depot_stock_qty", crore("depot_stock_qty").alias("depot_stock_val_crore"),
        "customer_stock_qty", crore("customer_stock_qty").alias("customer_stock_val_crore"), "tgt_crore")
