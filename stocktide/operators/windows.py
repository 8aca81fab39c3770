"""Ordered operators: fill-down, ranks, previous period, trailing and to-date sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions.numeric import count_when, ratio, total_when
from stocktide.operators.ordering import sort_key


def fill_down(df: DataFrame, key: str, pos: str, source: str | None = None, block_rows: int = 1_000_000,
              drop_leading: bool = True) -> DataFrame:
    """Carry the last non-null key forward in position order, per source.

    Positions are cut into blocks. The last key of each block is one small row, carried
    over blocks by a window on that small table; inside a block a window on (source, block)
    fills the rest. A single very long source is therefore spread over many tasks.
    """
    src = F.col(source) if source else F.lit("")
    cut = df.withColumn("_src", src).withColumn("_block", F.floor(F.col(pos) / F.lit(block_rows)))
    ends = cut.groupBy("_src", "_block").agg(
        F.max_by(F.col(key), F.when(F.col(key).isNotNull(), F.col(pos))).alias("_end"))
    before = Window.partitionBy("_src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_src", "_block", F.last("_end", ignorenulls=True).over(before).alias("_carry")).select(
        F.col("_src").alias("_cs"), F.col("_block").alias("_cb"), "_carry")
    inside = Window.partitionBy("_src", "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    filled = (cut.join(carry, F.col("_src").eqNullSafe(F.col("_cs")) & (F.col("_block") == F.col("_cb")), "left")
              .withColumn(key, F.coalesce(F.last(key, ignorenulls=True).over(inside), F.col("_carry"))))
    out = filled.select(*df.columns)
    return out.where(F.col(key).isNotNull()) if drop_leading else out


def block_bounds(df: DataFrame, key: str, pos: str, source: str | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """First and last position of every key's block (the last block ends at the source's end).

    The next key's start is looked up inside a position range first; only the first start of
    each range goes through the window over ranges.
    """
    src = (F.col(source) if source else F.lit("")).alias("_src")
    cut = df.select(src, F.col(key), F.col(pos))
    firsts = cut.where(F.col(key).isNotNull()).groupBy("_src", key).agg(F.min(pos).alias("min_pos")).withColumn(
        "_block", F.floor(F.col("min_pos") / F.lit(block_rows)))
    inside = Window.partitionBy("_src", "_block").orderBy("min_pos")
    heads = firsts.groupBy("_src", "_block").agg(F.min("min_pos").alias("_head"))
    ends = cut.groupBy("_src").agg(F.max(pos).alias("_end"))
    after = heads.select("_src", "_block", F.lead("_head").over(Window.partitionBy("_src").orderBy("_block")).alias("_after"))
    led = firsts.withColumn("_next", F.lead("min_pos").over(inside)).join(after, ["_src", "_block"]).join(ends, "_src")
    stop = F.coalesce(F.coalesce(F.col("_next"), F.col("_after")) - 1, F.col("_end"))
    return led.select(*([F.col("_src").alias(source)] if source else []), key, "min_pos", stop.alias("max_pos"))


def rank_in_group(df: DataFrame, by: list[str], value: str, out: str = "seq") -> DataFrame:
    """``rank() over (partition by ... order by value desc)``.

    Rows are first counted per distinct value, so the window sees one row per value
    and group, not every row of a hot group.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    above = (Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*[F.col(c).alias(f"_r_{c}") for c in [*by, value]],
                          (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias(out))
    cond = None
    for c in [*by, value]:
        hit = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = hit if cond is None else cond & hit
    return df.join(ranks, cond, "inner").drop(*[f"_r_{c}" for c in [*by, value]])


def report_calendar(df: DataFrame, day: str) -> DataFrame:
    """Observed days with the one and two before and after them, by position.

    The window has no partition key, but it runs on distinct days only (a date column
    has a hard bound on distinct values).
    """
    order = Window.orderBy("day")
    return df.select(F.col(day).alias("day")).where(F.col("day").isNotNull()).distinct().select(
        "day",
        F.lag("day", 1).over(order).alias("prev_1"), F.lag("day", 2).over(order).alias("prev_2"),
        F.lead("day", 1).over(order).alias("next_1"), F.lead("day", 2).over(order).alias("next_2"))


def period_delta(df: DataFrame, keys: list[str], period: str, value: str, out: str = "delta") -> DataFrame:
    """Change against the previous observed period of the same key."""
    order = Window.partitionBy(*keys).orderBy(period)
    return df.withColumn(out, F.col(value) - F.lag(value).over(order))


def column_deltas(columns: list[str]):
    """Wide form of the delta: zero for the first column, then each minus the one before."""
    first = F.lit(0.0).alias(columns[0])
    rest = [(F.col(b) - F.col(a)).alias(b) for a, b in zip(columns, columns[1:])]
    return [first, *rest]


def trailing_mean(day: str, value: str, run_date: str, days: int, where=None):
    """Mean over the ``days`` days before the run date; null when a day has no value."""
    at = F.lit(run_date).cast("date")
    cond = (F.col(day) >= F.date_sub(at, days)) & (F.col(day) < at)
    cond = cond if where is None else cond & where
    seen = count_when(cond & F.col(value).isNotNull())
    return F.when(seen == days, ratio(total_when(cond, value), F.lit(days)))


def month_to_date(day: str, value: str, run_date: str, where=None):
    """Sum from the month's first day to the run date; null when a listed value is null."""
    at = F.lit(run_date).cast("date")
    cond = (F.col(day) >= F.trunc(at, "month")) & (F.col(day) <= at)
    cond = cond if where is None else cond & where
    return F.when(count_when(cond & F.col(value).isNull()) == 0, total_when(cond, value))


def nth_value_desc(df: DataFrame, by: list[str], order, n: int = 1) -> DataFrame:
    """Rows at rank <= n per key (the rank limit also runs before the shuffle)."""
    spec = Window.partitionBy(*by).orderBy(*[sort_key(k) for k in order])
    return df.withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") <= n).drop("_rn")


def asof_lookup(df: DataFrame, lookup: DataFrame, by: list[str], at: str, values: list[str], lookup_at: str | None = None, strict: bool = False,
                block_days: int = 32) -> DataFrame:
    """Each row with ``values`` of the latest ``lookup`` row of its key at or (``strict``) before its time; null where there is none.

    Both sides are appended and sorted once, the last known value is carried along. Time is cut into blocks: the last lookup row of
    a block is one small row, carried over blocks by a window on that small table, so a key with many rows is spread over its blocks.
    Of lookup rows with equal key and time the greatest values count. A row without time or with a null key finds nothing.
    """
    when, spot = lookup_at or at, F.col("_asof_at")
    keys = [f"_asof_k{n}" for n in range(len(by))]
    named = [F.col(k).alias(n) for k, n in zip(by, keys, strict=True)]
    known = lookup.where(F.col(when).isNotNull())
    found = known.select(F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_asof_row"), *named, F.col(when).alias("_asof_at"),
                         F.lit(2 if strict else 0).alias("_asof_side"), F.struct(*values).alias("_asof_v"))
    asked = df.select(F.struct("*").alias("_asof_row"), *named, F.col(at).alias("_asof_at"), F.lit(1).alias("_asof_side"),
                      F.lit(None).cast(found.schema["_asof_v"].dataType).alias("_asof_v"))
    both = asked.unionByName(found).withColumn("_asof_block", F.floor(F.unix_date(spot.cast("date")) / block_days))
    ends = both.where(spot.isNotNull()).groupBy(*keys, "_asof_block").agg(F.max(F.when(F.col("_asof_side") != 1, F.struct("_asof_at", "_asof_v"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_asof_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_asof_block").alias("_cb"), F.last("_end", ignorenulls=True).over(before)["_asof_v"].alias("_carry"))
    same = F.col("_asof_block") == F.col("_cb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    inside = Window.partitionBy(*keys, "_asof_block").orderBy("_asof_at", "_asof_side", "_asof_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last("_asof_v", ignorenulls=True).over(inside), F.col("_carry"))
    fits = spot.isNotNull()
    for k in keys:
        fits = fits & F.col(k).isNotNull()
    out = both.join(carry, same, "left").withColumn("_asof_last", F.when(fits, last)).where(F.col("_asof_side") == 1)
    return out.select("_asof_row.*", *[F.col("_asof_last")[v].alias(v) for v in values])
