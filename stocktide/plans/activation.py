"""Materials that should be activated but are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.operators.joining import not_in
from stocktide.operators.windows import rank_in_group
from stocktide.session import as_is


def _codes(product: DataFrame) -> DataFrame:
    return product.select(F.col("basepack_code").alias("pack_code"), F.col("basepack").alias("_desc")).distinct()


def _inactive(plan: DataFrame, codes: DataFrame, active: DataFrame, material: str) -> DataFrame:
    coded = plan.join(codes, F.col("basepack") == F.col("_desc"), "left").drop("_desc")
    live = active.select(F.col("basepack_code").alias("_b"), F.col("material_code").alias("_m"))
    return coded.join(live, (F.col("pack_code") == F.col("_b")) & (F.col(material) == F.col("_m")), "left_anti")


def price_ranks(price: DataFrame) -> DataFrame:
    """Distinct prices with their rank inside the basepack, dearest first."""
    rows = price.select("basepack_code", "material_code", "material_desc", "retail_price").distinct()
    return rank_in_group(rows, ["basepack_code"], "retail_price", "seq")


def activation_exceptions(plan1: DataFrame, plan2: DataFrame, product: DataFrame, active: DataFrame, alloc: DataFrame,
                          price: DataFrame, stage=as_is) -> dict[str, DataFrame]:
    active = active.select("basepack_code", "material_code").distinct()
    codes = _codes(product)
    first = stage(_inactive(plan1.where(F.col("subs") == 1), codes, active, "activity_code"))
    second = stage(_inactive(plan2.where(F.col("post_subs") == 1), codes, active, "post_code"))

    named = first.select("pack_code").union(second.select("pack_code")).distinct()
    # the order filter runs before the list test: fewer rows reach the anti-join
    open_alloc = not_in(alloc.where(F.col("allocated_qty") > 0), "basepack_code", named, "pack_code").select(
        "basepack_code", "basepack_desc", "material_code", "material_desc").distinct()

    prices = price.select("basepack_code", "material_code", "material_desc", "retail_price").distinct()
    dearer = (
        open_alloc.withColumn("material_code", F.col("material_code").cast("long"))
        .join(prices.select("material_code", F.col("retail_price").alias("alloc_price")), "material_code")
        .join(active.select("basepack_code", F.col("material_code").alias("active_material_code")), "basepack_code", "left")
        .join(prices.select(F.col("material_code").alias("active_material_code"),
                            F.col("material_desc").alias("active_material_desc"),
                            F.col("retail_price").alias("active_price")), "active_material_code", "left")
        .where(F.col("alloc_price") > F.col("active_price"))
        .select("material_code", "basepack_code", "basepack_desc", "material_desc", "alloc_price",
                "active_material_code", "active_material_desc", "active_price"))

    def case(df, code, desc, material, material_desc, remark, active_code=None, active_desc=None):
        text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
        return df.select(text(code).alias("basepack_code"), text(desc).alias("basepack_desc"),
                         text(material).alias("material_code"), text(material_desc).alias("material_desc"),
                         text(active_code).alias("active_material_code"), text(active_desc).alias("active_material_desc"),
                         F.lit(remark).alias("remarks"))

    cases = case(dearer, "basepack_code", "basepack_desc", "material_code", "material_desc",
                 "allocation price > active price", "active_material_code", "active_material_desc")
    cases = cases.unionByName(case(first, "pack_code", "basepack", "activity_code", "description", "plan sheet 1"))
    cases = cases.unionByName(case(second, "pack_code", "basepack", "post_code", "description", "plan sheet 2"))
    return {"plan_1": first, "plan_2": second, "allocation": open_alloc, "price": price_ranks(price),
            "dearer_allocation": dearer, "cases": cases}
