"""Seasonal lines below norm or below a stock cover, and the towns they can be pushed to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import CLASS_WINTER, CRORE, LOW_DOH
from stocktide.functions import DAY_WORDED, parse_moment, ratio, total
from stocktide.operators.joining import semi, share_of_total

SHEET_ORDER = {"norm": {"towns": ["-stock_to_norm_diff"]}, "doh": {"towns": ["-doh_lag_from_floor"]}}


def season_lines(rpl: DataFrame, cls: str = CLASS_WINTER) -> DataFrame:
    """Lines of the season's class with days on hand and the gap to norm."""
    return rpl.where(F.col("class") == cls).select(
        parse_moment("date", DAY_WORDED).alias("rpl_date"), F.upper("town").alias("town"), F.upper("basepack").alias("basepack"),
        F.col("class").alias("cls"), ratio("on_hand", "per_day_sales").alias("doh"), "norm_qty", F.col("on_hand").alias("stock"),
        (F.col("norm_qty") - F.col("on_hand")).alias("stock_to_norm_diff"),
        ratio("on_hand", "norm_qty").alias("stock_to_norm_pct"))


def season_targets(target: DataFrame, lines: DataFrame) -> DataFrame:
    """Targets of the season's items with their share of the whole."""
    named = target.select(F.upper("town").alias("town"), F.upper("basepack").alias("basepack"), "tgt_cr")
    return share_of_total(semi(named, lines, ["basepack"]), "tgt_cr", "bc")


def low_lines(lines: DataFrame, targets: DataFrame, rule: str = "norm", floor: float = LOW_DOH) -> DataFrame:
    """``norm``: stock below norm; ``doh``: fewer than ``floor`` days on hand."""
    cond = F.col("stock_to_norm_diff") > 0 if rule == "norm" else F.col("doh") < floor
    return lines.where(cond).join(targets, ["town", "basepack"])


def push_towns(low: DataFrame, plan: DataFrame, confirmed: DataFrame, rule: str = "norm", floor: float = LOW_DOH) -> DataFrame:
    """Towns with their shortfall, contribution and the plan still open."""
    lag = F.col("stock_to_norm_diff") if rule == "norm" else F.lit(floor) - F.col("doh")
    name = "stock_to_norm_diff" if rule == "norm" else "doh_lag_from_floor"
    towns = low.groupBy("town").agg(total(lag).alias(name), total("bc").alias("winter_bc_of_low_stock"))
    given = confirmed.groupBy("town").agg((total("confirmed_value") / float(CRORE)).alias("confirmed_val"))
    out = towns.join(plan.select("town", "plan"), "town").join(given, "town")
    eligible = F.when(F.col("plan") > F.col("confirmed_val"), F.lit("yes")).otherwise(F.lit("no"))
    return out.select("*", eligible.alias("if_push_eligible"), (F.col("plan") - F.col("confirmed_val")).alias("push_val"))


def understock_push(rpl: DataFrame, target: DataFrame, plan: DataFrame, confirmed: DataFrame, cls: str = CLASS_WINTER,
                    rule: str = "norm", floor: float = LOW_DOH) -> dict[str, DataFrame]:
    lines = season_lines(rpl, cls)
    low = low_lines(lines, season_targets(target, lines), rule, floor)
    return {"lines": low, "towns": push_towns(low, plan, confirmed, rule, floor)}
