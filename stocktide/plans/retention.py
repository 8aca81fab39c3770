"""Return-retention cohorts of distributors, overall or per brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions import first_word, month_key, month_start, months_apart, ratio, total
from stocktide.operators.joining import later_pairs
from stocktide.operators.reshaping import all_known, append_mean_row, listed, pivot_sum

SHEET_ORDER = ["claim_month_from", "claim_month_to"]


def focus_items(listed: DataFrame, pattern: str = "%yes%") -> DataFrame:
    """Upper-cased listed items with the brand (first word)."""
    return listed.where(F.col("in_list").ilike(pattern)).select(
        F.upper("sku").alias("basepack"), "category", "business_group").distinct().withColumn("brand", first_word("basepack"))


def listed_claims(claims: DataFrame, product: DataFrame, listed: DataFrame) -> DataFrame:
    """Claims of listed items, one row per claim and matching item. The two small tables join first."""
    names = product.select("basepack", "material_desc").distinct()
    items = names.join(focus_items(listed), "basepack").select("material_desc", "brand")
    return claims.join(items, "material_desc").select(
        month_key("claim_date").alias("claim_month"), "distributor_code", "brand", "reason", "received_amount")


def retention_cohort(claims: DataFrame, product: DataFrame, listed: DataFrame, amount_rule: bool = True,
                     reason: str | None = "%expire%", by: str | None = None) -> DataFrame:
    """Distributors of a first month seen again in each later month.

    Claims fold to one row per (brand,) distributor and month first. With ``amount_rule`` the
    later month's amount must not be lower. All brands run in one job with ``by="brand"``.
    """
    rows = listed_claims(claims, product, listed)
    if reason is not None:
        rows = rows.where(F.col("reason").ilike(reason))
    keys = [by] if by else []
    per_month = rows.groupBy(*keys, "distributor_code", "claim_month").agg(total("received_amount").alias("_amount"))
    pairs = later_pairs(per_month, [*keys, "distributor_code"], "claim_month", "_amount" if amount_rule else None)
    # one row per distributor and pair, so counting known codes counts distinct distributors
    counts = pairs.groupBy(*keys, F.col("period_from").alias("claim_month_from"), F.col("period_to").alias("claim_month_to")).agg(
        F.count("distributor_code").alias("distributors_ret"))
    cohort = counts.withColumn("month_diff", months_apart(month_start("claim_month_from"), month_start("claim_month_to")))
    # at most one row per month pair (and brand) is left here
    start = Window.partitionBy(*keys, "claim_month_from")
    sized = cohort.withColumn("distributors_init", F.max(F.when(F.col("month_diff") == 0, F.col("distributors_ret"))).over(start))
    return sized.where(all_known([*keys, "distributors_init"])).select(
        *keys, "claim_month_from", "claim_month_to", "month_diff", "distributors_ret", "distributors_init",
        ratio("distributors_ret", "distributors_init").alias("distributors_ret_pct"))


def cohort_pivot(cohort: DataFrame, diffs: list[int], value: str = "distributors_ret") -> DataFrame:
    """First month by month difference, with a mean row."""
    wide = pivot_sum(cohort, ["claim_month_from"], "month_diff", diffs, value)
    return append_mean_row(wide, "claim_month_from", [str(d) for d in diffs])


def brand_means(cohort: DataFrame, diffs: list[int], value: str = "distributors_ret") -> DataFrame:
    """Only the mean row of each brand's pivot: the mean over its first months."""
    known = cohort.where(F.col("month_diff").isNotNull() & F.col("claim_month_from").isNotNull() & F.col("brand").isNotNull())
    cells = known.groupBy("brand", "claim_month_from", "month_diff").agg(total(value).alias("_v"))
    return listed(cells, "month_diff", diffs).groupBy("brand").pivot("month_diff", diffs).agg(F.avg("_v"))
