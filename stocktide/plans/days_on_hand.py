"""Days on hand against run rates, nationally and per town."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import TARGET_DOH
from stocktide.functions import ratio, total, upper_text
from stocktide.operators.joining import with_total
from stocktide.operators.reshaping import melt, pivot_sum

ATTRS = ("DOH_3_months", "DOH_6_months", "DOH_target", "DOH_this_month", "stock_on_hand")


def month_run_rate(sccf: DataFrame, days: int) -> DataFrame:
    """Ordered quantity per day so far, per town and basepack."""
    facts = upper_text(sccf.select("town", "basepack", "ord_qty"))
    return facts.groupBy("town", "basepack").agg((total("ord_qty") / float(days)).alias("rr_this_month"))


def target_share(alloc: DataFrame) -> DataFrame:
    """Share of the whole target per (business group, category, basepack)."""
    facts = upper_text(alloc)
    whole = facts.agg(total("tgt_cr").alias("_whole"))
    sums = facts.groupBy("business_group", "category", "basepack").agg(total("tgt_cr").alias("_tgt"))
    return with_total(sums, whole).select("business_group", "category", "basepack", ratio("_tgt", "_whole").alias("basepack_bc"))


def doh_long(rpl: DataFrame, sccf: DataFrame, alloc: DataFrame, cls: DataFrame, rr: DataFrame, days: int,
             level: str = "national", target: float = TARGET_DOH, swap_town_rr: bool = False,
             distinct_target: bool | None = None) -> DataFrame:
    """Long attributes: stock, DOH over 3 and 6 months and this month, and the target.

    Stock is aggregated once; the run-rate sides join to that. ``swap_town_rr`` reproduces
    the exchanged 3 and 6 month town rates of the original sheet. The town target is added
    once per stock row there (``distinct_target=False``), the national one once per basepack.
    """
    by = ["basepack"] if level == "national" else ["town", "basepack"]
    once = (level == "national") if distinct_target is None else distinct_target
    stock = upper_text(rpl.select("town", "basepack", "on_hand")).groupBy(*by).agg(
        total("on_hand").alias("stock_on_hand"), F.count(F.lit(1)).alias("_rows"))
    stock = stock.withColumn("_target", F.lit(float(target)) * (F.lit(1) if once else F.col("_rows")))

    if level == "national":
        rates = upper_text(rr.select("basepack", "rr_3m", "rr_6m"))
        month = month_run_rate(sccf, days).groupBy("basepack").agg(total("rr_this_month").alias("rr_this_month"))
    else:
        named = rr.select("town", "basepack", *([F.col("rr_6m").alias("rr_3m"), F.col("rr_3m").alias("rr_6m")]
                                                if swap_town_rr else ["rr_3m", "rr_6m"]))
        rates = upper_text(named.groupBy("town", "basepack").agg(total("rr_3m").alias("rr_3m"), total("rr_6m").alias("rr_6m")))
        month = month_run_rate(sccf, days)

    paced = stock.join(rates, by).select(*by, ratio("stock_on_hand", "rr_3m").alias("d3"), ratio("stock_on_hand", "rr_6m").alias("d6"))
    now = stock.join(month, by).select(*by, ratio("stock_on_hand", "rr_this_month").alias("dm"))
    long = (melt(stock, by, {"stock_on_hand": "stock_on_hand", "DOH_target": "_target"})
            .unionByName(melt(paced, by, {"DOH_3_months": "d3", "DOH_6_months": "d6"}))
            .unionByName(melt(now, by, {"DOH_this_month": "dm"})))
    classes = upper_text(cls.select(*by, "classification"))
    return long.join(target_share(alloc), "basepack", "left").join(classes, by, "left")


def doh_operational(rpl: DataFrame, sccf: DataFrame, alloc: DataFrame, cls: DataFrame, rr: DataFrame, days: int,
                    level: str = "national", **options) -> DataFrame:
    """The long attributes pivoted to one row per item (rows with an unknown key are left out)."""
    long = doh_long(rpl, sccf, alloc, cls, rr, days, level, **options)
    index = ["business_group", "category", "classification", "basepack_bc", "basepack"] + ([] if level == "national" else ["town"])
    return pivot_sum(long, index, "attr", list(ATTRS))
