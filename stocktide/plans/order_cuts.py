"""Handheld-order distribution in several cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocktide.constants import TOP_ORDERED, TOWN_LIST_WIDTH
from stocktide.functions import percent_text, ratio, total
from stocktide.operators.joining import with_total
from stocktide.operators.ordering import top_k
from stocktide.operators.reshaping import joined_list
from stocktide.session import as_is

CUTS = ("class", "category", "town", "company")
SHEET_ORDER = {name: ["-order_qty"] for name in ("basepack", *CUTS)}


def town_grain(orders: DataFrame) -> DataFrame:
    """One row per basepack and town: the pre-aggregate behind every town text."""
    return orders.groupBy("basepack", "town").agg(total("order_qty").alias("order_qty"), F.count("town").alias("rows"))


def basepack_cut(grain: DataFrame) -> DataFrame:
    """Sum, order-row count and the sorted list of towns; a list holds each town once,
    so its size is bounded by the number of towns."""
    return grain.groupBy("basepack").agg(
        total("order_qty").alias("order_qty"), F.sum("rows").alias("order_town_count"),
        F.when(F.count("town") > 0, joined_list("town")).alias("order_towns"))


def short_town_list(grain: DataFrame, width: int) -> DataFrame:
    """Text of one sorted town per order row, cut to ``width`` without building it: every further entry adds at
    least two characters, so the first ``width / 2 + 2`` entries decide the visible part."""
    most = width // 2 + 2
    order = Window.partitionBy("basepack").orderBy("town")
    head = (grain.where(F.col("town").isNotNull()).select("basepack", "town", F.least("rows", F.lit(most)).cast("int").alias("n"), F.row_number().over(order).alias("rn"))
            .where(F.col("rn") <= most)
            .groupBy("basepack").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rn", "town", "n"))),
                                                                        lambda x: F.array_repeat(x["town"], x["n"]))), ", ").alias("_head")))
    sizes = grain.groupBy("basepack").agg(
        (F.sum((F.length("town") + 2) * F.col("rows")) - 2).alias("_length"))
    text = F.when(F.col("_length") > width, F.concat(F.left("_head", F.lit(width)), F.lit(" ..."))).otherwise(F.col("_head"))
    return sizes.join(head, "basepack", "left").select("basepack", text.alias("order_towns"))


def order_cuts(orders: DataFrame, dims=CUTS, top: int = TOP_ORDERED, width: int = TOWN_LIST_WIDTH,
               stage=as_is) -> dict[str, DataFrame]:
    """Positive orders per basepack and per dimension, plus the top table."""
    live = orders.where(F.col("order_qty") > 0)
    grain = stage(town_grain(live))
    sheets = {"full": live, "basepack": basepack_cut(grain)}
    for dim in dims:
        sheets[dim] = live.groupBy(dim).agg(total("order_qty").alias("order_qty"))
    packs = grain.groupBy("basepack").agg(total("order_qty").alias("order_qty"), F.sum("rows").alias("order_town_count"))
    whole = packs.agg(total("order_qty").alias("_whole"))
    best = top_k(with_total(packs, whole), top, ["-order_qty", "basepack"])
    sheets["top"] = best.join(short_town_list(grain, width), "basepack", "left").select(
        "basepack", "order_qty", percent_text(ratio(F.col("order_qty") * 100.0, "_whole")).alias("order_pct"),
        "order_town_count", "order_towns")
    return sheets
