"""Growth of items at outlets: two years side by side, monthly deltas, contribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.functions import or_zero, ratio, ratio_of_sums, sum_strict, total
from stocktide.operators.joining import full_zero, with_total
from stocktide.operators.windows import column_deltas, fill_down
from stocktide.session import staged

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
YTD = MONTHS[:9]
KEYS = ["outlet_code", "basepack"]
DETAIL_ORDER = ["-outlet_bc", "outlet_code", "-basepack_bc", "basepack", "typ"]
SHEET_ORDER = {"detail": DETAIL_ORDER, "outlet": ["-outlet_bc"], "basepack": ["-basepack_bc"]}


def block_outlets(sheet: DataFrame, pos: str = "pos", source: str | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Outlet code carried down its block; rows before the first code are left out."""
    return fill_down(sheet, "outlet_code", pos, source, block_rows)


def year_pair(this_year: DataFrame, last_year: DataFrame) -> DataFrame:
    """Both years on (outlet, basepack). ``this_year`` has jan..sep and total, ``last_year`` jan..sep and dec."""
    now = this_year.select(*KEYS, *[F.col(m).alias(f"{m}_ty") for m in YTD], F.col("total").alias("total_ty")).fillna(0)
    then = last_year.select(*KEYS, *[F.col(m).alias(f"{m}_ly") for m in (*YTD, "dec")]).fillna(0).withColumn(
        "total_ly", sum_strict(*[f"{m}_ly" for m in YTD]))
    return full_zero(now, then, KEYS)


def growth_rows(pair: DataFrame, keep=()) -> DataFrame:
    """Type 1 holds the values and growth; type 2 the month-on-month deltas. One scan makes both."""
    months = ["dec_ly", *[f"{m}_ty" for m in YTD]]
    values = F.struct(*[F.col(m).cast("double").alias(m) for m in months], F.col("total_ty").cast("double").alias("total_ty"),
                      F.col("total_ly").cast("double").alias("total_ly"),
                      ratio(F.col("total_ty") - F.col("total_ly"), "total_ly").alias("growth"), F.lit(1).alias("typ"))
    steps = [c.cast("double").alias(m) for c, m in zip(column_deltas(months), months)]
    moved = F.struct(*steps, sum_strict(*[c for c in steps[1:]]).alias("total_ty"), F.lit(0.0).alias("total_ly"),
                     F.lit(0.0).alias("growth"), F.lit(2).alias("typ"))
    return pair.select(*KEYS, *keep, F.explode(F.array(values, moved)).alias("_r")).select(*KEYS, "_r.*", *keep)


def contribution(pair: DataFrame, by: str, name: str) -> DataFrame:
    """Share of the year's total and growth per outlet or basepack."""
    whole = pair.agg(total("total_ty").alias("_whole"))
    sums = pair.groupBy(by).agg(total("total_ty").alias("total"), total("total_ly").alias("_ly"),
                                ratio_of_sums(F.col("total_ty") - F.col("total_ly"), "total_ly").alias(f"{name}_growth"))
    return with_total(sums, whole).select(by, "total", ratio("total", "_whole").alias(f"{name}_bc"), f"{name}_growth")


def outlet_growth(this_year: DataFrame, last_year: DataFrame, stage=staged) -> dict[str, DataFrame]:
    """Detail with both contributions, and the two summaries; the year pair behind them is written once by ``stage``."""
    pair = stage(year_pair(this_year, last_year))
    outlets = contribution(pair, "outlet_code", "outlet")
    packs = contribution(pair, "basepack", "basepack")
    # the contributions join before each row becomes two
    shared = (pair.join(outlets.select("outlet_code", "outlet_bc"), "outlet_code")
              .join(packs.select("basepack", "basepack_bc"), "basepack"))
    detail = growth_rows(shared, ("outlet_bc", "basepack_bc"))
    # the sum of the deltas telescopes to last month minus the december before
    change = F.col("sep_ty") - F.col("dec_ly")
    known = F.col("outlet_code").isNotNull() & F.col("basepack").isNotNull()
    moved = lambda by: pair.where(known).groupBy(by).agg(total(change).alias("total_diff"))
    return {
        "detail": detail,
        "outlet": outlets.join(moved("outlet_code"), "outlet_code").select(
            "outlet_code", or_zero("total").alias("total"), "total_diff", "outlet_bc", "outlet_growth"),
        "basepack": packs.join(moved("basepack"), "basepack").select(
            "basepack", or_zero("total").alias("total"), "total_diff", "basepack_bc", "basepack_growth"),
    }
