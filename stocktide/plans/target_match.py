"""Month-end matching of depot stock to the towns' open targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import CRORE, STORAGE_LOC
from stocktide.functions import floor_number, or_zero, total
from stocktide.operators.joining import salted_join, share_of_group


def clean_plan(plan: DataFrame) -> DataFrame:
    """A newline placeholder counts as zero; TOTAL rows (case-sensitive) are dropped."""
    value = F.when(F.col("plan") != "\n", F.col("plan")).otherwise(F.lit("0")).cast("decimal(18,3)")
    return plan.where(~F.col("town").like("%TOTAL%")).select("depot", "town", value.alias("plan"))


def target_gaps(plan: DataFrame, alloc: DataFrame) -> DataFrame:
    """gap = plan - allocated / 1e7, and its share of the depot's gap (negative when over-allocated)."""
    given = alloc.groupBy("town").agg(total("allocated_value").alias("alloc"))
    gaps = clean_plan(plan).join(given, "town", "left").withColumn("alloc", or_zero("alloc")).withColumn(
        "gap", F.col("plan").cast("double") - F.col("alloc") / float(CRORE))
    return share_of_group(gaps, ["depot"], "gap", "total_gap_pct")


def listed_stock(stock: DataFrame, plant_map: DataFrame, c_class: DataFrame, loc: str = STORAGE_LOC) -> DataFrame:
    """Largest available stock per depot and listed basepack."""
    held = (stock.where(F.col("storage_loc") == loc).join(plant_map.select("depot_code", F.col("depot_name").alias("depot")), "depot_code")
            .groupBy("depot", "basepack").agg(F.max("available").alias("stock")))
    return held.join(c_class.select("depot", "basepack").distinct(), ["depot", "basepack"], "left_semi")


def match_targets(plan: DataFrame, alloc: DataFrame, c_class: DataFrame, stock: DataFrame, plant_map: DataFrame,
                  loc: str = STORAGE_LOC, salts: int = 8) -> DataFrame:
    """Every town of a depot gets its share of each listed basepack.

    The depot is a coarse key (a handful of values), so the stock rows are spread over
    ``salts`` buckets per depot.
    """
    gaps = target_gaps(plan, alloc)
    held = listed_stock(stock, plant_map, c_class, loc)
    qty = F.col("stock") * F.col("total_gap_pct")
    return salted_join(held, gaps, ["depot"], ["basepack"], salts).select(
        "depot", "town", "plan", "alloc", "gap", "total_gap_pct", "basepack", "stock",
        qty.alias("to_fulfil"), floor_number(qty).alias("to_fulfil_rounded"))
