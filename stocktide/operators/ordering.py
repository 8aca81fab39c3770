"""Order, row numbers, top-k and first-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.session import stage_table

#: Most rows of one sheet of a workbook.
SHEET_ROWS = 1_000_000


def sort_key(spec: str | Column) -> Column:
    """``"-name"`` sorts descending; nulls come last either way."""
    if isinstance(spec, Column):
        return spec
    return F.col(spec[1:]).desc_nulls_last() if spec.startswith("-") else F.col(spec).asc_nulls_last()


def report_order(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(*[sort_key(k) for k in keys])


def top_k(df: DataFrame, k: int, keys) -> DataFrame:
    """First ``k`` rows of the order (the report's own feature, planned as a partial top-k)."""
    return report_order(df, keys).limit(k)


def row_numbers(df: DataFrame, keys, out: str = "row_number") -> DataFrame:
    """Add each row's place in the order of ``keys``, from 0, without gaps.

    The order is a range partitioning; ordered rows are written once with their place in their partition, and the partitions'
    row counts (one small row each) are summed up and added. No task sees more than its partition.
    """
    ordered = report_order(df, keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stage_table(ordered, "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit(2 ** 33 - 1))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, place.alias(out))


def into_sheets(df: DataFrame, keys, rows: int = SHEET_ROWS) -> DataFrame:
    """Every row with the sheet it goes to and its row there: where a sheet holds ``rows`` rows at most, the rest fills further sheets."""
    numbered = row_numbers(df, keys, "_row")
    return numbered.select(*df.columns, F.floor(F.col("_row") / rows).alias("sheet"), (F.col("_row") % rows).alias("sheet_row"))


def first_per_key(df: DataFrame, keys: list[str], order) -> DataFrame:
    """Keep the first row per key. The rank limit is applied before the shuffle too,
    so a hot key sends at most one row per task."""
    spec = Window.partitionBy(*keys).orderBy(*[sort_key(k) for k in order])
    return df.withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") == 1).drop("_rn")


def sorted_days(df: DataFrame, text_col: str, fmt: str) -> DataFrame:
    """Distinct text dates with their parsed day, ordered by the day."""
    from stocktide.functions.dates import parse_day

    days = df.select(text_col).distinct().withColumn("day", parse_day(text_col, fmt))
    return days.orderBy(F.col("day").asc_nulls_last())
