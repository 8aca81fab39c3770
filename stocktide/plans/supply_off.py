"""Impact of switching primary supply off on secondary fill rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.functions import count_when, in_period, ratio, ratio_of_sums, total, total_when
from stocktide.operators.joining import semi, with_total, within_window
from stocktide.operators.reshaping import found_values, listed, melt, pivot_mean
from stocktide.session import staged

CONSTRAINT, REMOVED = "constraint", "removed"
OVERALL = ("Overall SCCF", "SCCF - Constrainted/Removed", "SCCF - not Constrainted/Removed")
DAILY = {"1. Secondary Order Qty": "sec_ord_qty", "2. Secondary Invoiced Qty": "sec_inv_qty", "3. SCCF": "_sccf",
         "4. Primary Order Qty": "prim_ord_qty", "5. Dispatched Qty": "prim_inv_qty", "6. DR": "_dr"}
STATUS_MEASURE = "7. Primary Status"
SHEET_ORDER = {"summary": ["-contribution"]}


def off_windows(constraint: DataFrame, removed: DataFrame) -> DataFrame:
    """Both lists as one set of windows (basepack, start_date, end_date, status)."""
    both = constraint.withColumn("status", F.lit(CONSTRAINT)).unionByName(removed.withColumn("status", F.lit(REMOVED)))
    return both.distinct()


def window_status(windows: DataFrame) -> DataFrame:
    """One status per window: 'removed' beats 'constraint'."""
    return windows.groupBy("basepack", "start_date", "end_date").agg(F.max("status").alias("status"))


def tagged_days(windows: DataFrame, primary: DataFrame, secondary: DataFrame, start: str | None = None,
                stop: str | None = None) -> DataFrame:
    """Daily primary and secondary of the listed items with the window's status.

    Overlapping windows of different status give one row each; equal rows collapse.
    """
    if start and stop:
        primary = primary.where(in_period("report_date", start, stop))
    key = ["report_date", "basepack"]
    first = semi(primary, windows, ["basepack"]).groupBy(*key).agg(
        total("prim_ord_qty").alias("prim_ord_qty"), total("prim_inv_qty").alias("prim_inv_qty"))
    second = semi(secondary, windows, ["basepack"]).groupBy(*key).agg(
        total("sec_ord_qty").alias("sec_ord_qty"), total("sec_inv_qty").alias("sec_inv_qty"))
    days = first.join(second, key, "full")
    tagged = within_window(days, window_status(windows), "basepack", "report_date", "start_date", "end_date")
    return tagged.select(*key, "prim_ord_qty", "prim_inv_qty", "sec_ord_qty", "sec_inv_qty", "status").distinct()


def daily_totals(rows: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Primary or secondary rows folded once by day and item: ``tagged_days`` and ``contribution`` give the same on these as on all rows."""
    if start and stop:
        rows = rows.where(in_period("report_date", start, stop))
    key = ["report_date", "basepack"]
    return rows.groupBy(*key).agg(*[total(c).alias(c) for c in rows.columns if c not in key])


def contribution(secondary: DataFrame) -> DataFrame:
    """Each item's share of all ordered quantity, which is the sum of the items' sums: the rows are read once."""
    sums = secondary.groupBy("basepack").agg(total("sec_ord_qty").alias("_qty"))
    whole = sums.agg(total("_qty").alias("_whole"))
    return with_total(sums, whole).select("basepack", ratio("_qty", "_whole").alias("contribution"))


def measures_long(tagged: DataFrame, contrib: DataFrame) -> DataFrame:
    """(report_date, basepack, measure, val, status_text, contribution).

    Ten measures; the primary status is text of its own, so a real value of -1 is never
    mistaken for a status code.
    """
    day = F.date_format("report_date", "yyyy-MM-dd")
    known = F.col("status").isNotNull()
    priced = tagged.withColumns({"_sccf": ratio("sec_inv_qty", "sec_ord_qty"), "_dr": ratio("prim_inv_qty", "prim_ord_qty")})
    none = F.lit(None).cast("string").alias("status_text")
    daily = melt(priced.withColumn("report_date", day), ["report_date", "basepack"], DAILY, "measure").select("*", none)

    sums = tagged.groupBy("basepack").agg(
        ratio_of_sums("sec_inv_qty", "sec_ord_qty").alias("_all"),
        ratio(total_when(known, "sec_inv_qty"), total_when(known, "sec_ord_qty")).alias("_in"),
        ratio(total_when(~known, "sec_inv_qty"), total_when(~known, "sec_ord_qty")).alias("_out"),
        count_when(known).alias("_n_in"), count_when(~known).alias("_n_out"))
    overall = melt(sums, ["basepack", "_n_in", "_n_out"], dict(zip(OVERALL, ("_all", "_in", "_out"))), "report_date")
    overall = overall.where(~((F.col("report_date") == OVERALL[1]) & (F.col("_n_in") == 0))
                            & ~((F.col("report_date") == OVERALL[2]) & (F.col("_n_out") == 0)))
    overall = overall.select("report_date", "basepack", F.lit("3. SCCF").alias("measure"), "val", none)

    text = (F.when(F.col("status") == CONSTRAINT, F.lit("constrainted")).when(F.col("status") == REMOVED, F.lit("removed"))
            .when(F.col("status").isNull() & F.col("prim_ord_qty").isNotNull(), F.lit("on"))
            .when(F.col("status").isNull(), F.lit("no data")))
    state = tagged.select(day.alias("report_date"), "basepack", F.lit(STATUS_MEASURE).alias("measure"),
                          F.lit(None).cast("double").alias("val"), text.alias("status_text"))
    return daily.unionByName(overall).unionByName(state).join(contrib, "basepack")


#: Status texts in rising order of precedence on a day with two of them.
STATES = ("constrainted", "no data", "on", "removed")


def daily_pivot(long: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric measures by day (mean of a cell) with the overall columns: all days with a value, or the listed columns and no others."""
    return pivot_mean(long, ["contribution", "basepack", "measure"], "report_date", columns)


def status_pivot(long: DataFrame, days: list[str] | None = None) -> DataFrame:
    """Status text by day, of all days or of the listed ones (another day fails); of two states on a day the later of ``STATES`` holds.

    States are folded as small numbers, which fill all days of a row in one pass.
    """
    index, texts = ["contribution", "basepack"], ", ".join(f"'{s}'" for s in STATES)
    only = long.where(F.col("measure") == STATUS_MEASURE).withColumn("_state", F.array_position(F.array(*map(F.lit, STATES)), F.col("status_text")).cast("int"))
    only, days = (only, found_values(only, "report_date")) if days is None else (listed(only, "report_date", days), days)
    wide = only.groupBy(*index).pivot("report_date", days).agg(F.max("_state"))
    return wide.select(*index, *[F.expr(f"elt(`{d}`, {texts}) as `{d}`") for d in days])


def summary(tagged: DataFrame, contrib: DataFrame) -> DataFrame:
    """Twenty columns per item by conditional sums."""
    known, cons, rem = F.col("status").isNotNull(), F.col("status") == CONSTRAINT, F.col("status") == REMOVED
    aggs = [total("sec_ord_qty").alias("sec_ord_qty"), total("sec_inv_qty").alias("sec_inv_qty"),
            ratio_of_sums("sec_inv_qty", "sec_ord_qty").alias("sccf")]
    for tag, cond in (("consrem", known), ("cons", cons), ("rem", rem), ("not_consrem", ~known)):
        ordered, invoiced = total_when(cond, "sec_ord_qty"), total_when(cond, "sec_inv_qty")
        aggs += [ordered.alias(f"sec_ord_qty_{tag}"), invoiced.alias(f"sec_inv_qty_{tag}"), ratio(invoiced, ordered).alias(f"sccf_{tag}")]
    aggs += [count_when(cons).alias("days_cons"), count_when(rem).alias("days_rem"), count_when(known).alias("days_consrem")]
    return tagged.join(contrib, "basepack").groupBy("contribution", "basepack").agg(*aggs)


def primary_off_impact(windows: DataFrame, primary: DataFrame, secondary: DataFrame, days: list[str] | None = None, start: str | None = None,
                       stop: str | None = None, stage=staged) -> dict[str, DataFrame]:
    """All sheets; the pivots show every day of the data, or exactly ``days``. The shared parts are written once by ``stage``."""
    primary, secondary = stage(daily_totals(primary, start, stop)), stage(daily_totals(secondary))
    tagged = stage(tagged_days(windows, primary, secondary, start, stop))
    contrib = stage(contribution(secondary))
    long = stage(measures_long(tagged, contrib))
    return {"tagged": tagged, "long": long, "daily": daily_pivot(long, [*days, *OVERALL] if days else None), "status": status_pivot(long, days),
            "summary": summary(tagged, contrib)}
