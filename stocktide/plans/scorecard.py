"""Category scorecard: contribution leaders with stock, orders, target and remaining volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.constants import TOP_SCORECARD, TRAILING_DAYS
from stocktide.functions import count_when, matches_any, total_when
from stocktide.operators.ordering import top_k
from stocktide.operators.windows import month_to_date, trailing_mean

ATTRIBUTES = {
    "contribution": "Business Contribution", "stock": "National Stock in CS", "orders": "Order Qnt in CS",
    "target": "Secondary Target in CS", "primary": "Primary In CS",
}
SHEET_ORDER = ["-biz_contribution"]


def category_scorecard(eav: DataFrame, date: str, prefixes: list[str], exclude: str | None = None, k: int = TOP_SCORECARD,
                       days: int = TRAILING_DAYS, attributes: dict[str, str] = ATTRIBUTES) -> DataFrame:
    """``eav`` is (basepack, attribute, date, value). The exclusion applies after the top-k,
    so fewer than ``k`` rows may return. A basepack needs all five attributes."""
    at = F.lit(date).cast("date")
    is_a = {name: F.col("attribute") == label for name, label in attributes.items()}
    first_day = F.least(F.trunc(at, "month"), F.date_sub(at, days))
    span = eav.where((F.col("date") >= first_day) & (F.col("date") <= at) & F.col("attribute").isin(*attributes.values()))
    today = F.col("date") == at

    leaders = top_k(
        span.where(is_a["contribution"] & today & matches_any("basepack", [f"{p}%" for p in prefixes]))
        .select("basepack", F.col("value").alias("biz_contribution")), k, ["-biz_contribution", "basepack"])

    # one pass over the long table instead of one join per attribute
    measures = span.groupBy("basepack").agg(
        total_when(is_a["stock"] & today, "value").alias("national_stock_cs"),
        trailing_mean("date", "value", date, days, is_a["orders"]).alias("last_5_day_avg_orders_cs"),
        total_when(is_a["target"] & today, "value").alias("secondary_target_cs"),
        month_to_date("date", "value", date, is_a["primary"]).alias("primary_cs"),
        *[count_when(is_a[n]).alias(f"_has_{n}") for n in ("stock", "orders", "target", "primary")])
    present = measures.where((F.col("_has_stock") > 0) & (F.col("_has_orders") > 0) & (F.col("_has_target") > 0)
                             & (F.col("_has_primary") > 0))
    out = leaders.join(present, "basepack").select(
        "basepack", "biz_contribution", "national_stock_cs", "last_5_day_avg_orders_cs", "secondary_target_cs", "primary_cs",
        (F.col("secondary_target_cs") - F.col("primary_cs")).alias("monthly_remaining_vol_cs"))
    return out.where(~F.col("basepack").ilike(exclude)) if exclude else out
