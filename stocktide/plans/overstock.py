"""Value index against Q-mix per town and portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import PORTFOLIOS
from stocktide.functions import ratio, total
from stocktide.operators.reshaping import gid, pivot_single, sets_of

KEYS = ["town", "basepack", "cls"]


def overstock_index(rpl: DataFrame, cls: DataFrame, towns: list[str] | None = None) -> DataFrame:
    """Rows per (town, basepack), (town, overall) and (town, class) from one grouping-sets pass.

    The facts are folded to (town, basepack) before the class joins them, so a hot item sends
    one row per task and the sets expand small rows. A repeated class row counts again.
    """
    facts = rpl.where(F.col("town").isin(*towns)) if towns else rpl
    folded = facts.groupBy("town", "basepack").agg(F.count("basepack").alias("_n"), total("norm_qty").alias("_norm"),
                                                   total("proposed_qty").alias("_prop"), total("on_hand").alias("_stock"))
    base = folded.join(cls.select("town", "basepack", F.col("classification").alias("cls")), ["town", "basepack"])
    sets = sets_of(base, [["town", "basepack"], ["town"], ["town", "cls"]],
                   [F.sum("_n").alias("sku_count"), total("_norm").alias("norm_qty"), total("_prop").alias("proposed_qty"),
                    total("_stock").alias("stock_on_hand")], KEYS)
    name = (F.when(F.col("_gid") == gid(KEYS, ["town"]), F.lit("overall"))
            .when(F.col("_gid") == gid(KEYS, ["town", "cls"]), F.col("cls")).otherwise(F.col("basepack")))
    return sets.select("town", name.alias("portfolio"), "sku_count", "norm_qty", "proposed_qty", "stock_on_hand",
                       ratio("stock_on_hand", "norm_qty").alias("value_index"),
                       (1 - ratio("proposed_qty", "norm_qty")).alias("qmix"))


def overstock_summary(index: DataFrame, portfolios=PORTFOLIOS) -> DataFrame:
    """One row per town: value index and Q-mix of each class and overall."""
    picked = index.where(F.col("portfolio").isin(*portfolios))
    return pivot_single(picked, ["town"], "portfolio", list(portfolios), ["value_index", "qmix"])
