"""Joins that stay whole and bounded at scale.

No side is forced to broadcast unless its size has a hard bound (calendars of distinct
days, literal tables). Everything else is left to Spark's own
size checks at planning time and at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A lookup table holds more than one row for a key."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") > 1)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``rows`` rows, counted first; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def assert_unique(df: DataFrame, keys: list[str], on_duplicate: str = "error") -> DataFrame:
    """Check a key. ``error`` looks for one duplicate now; ``keep`` lets rows fan out."""
    if on_duplicate == "error":
        hit = duplicate_keys(df, keys).limit(1).collect()
        if hit:
            raise DuplicateKeyError(f"duplicate key {hit[0].asDict()}")
    return df


def enrich(df: DataFrame, lookup: DataFrame, keys: list[str], on_duplicate: str = "keep") -> DataFrame:
    """Left join that adds lookup columns."""
    return df.join(assert_unique(lookup, keys, on_duplicate), keys, "left")


def with_total(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row, as scalar subqueries: no join, no shuffle of the rows."""
    return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """value / sum(value) over the whole frame."""
    from stocktide.functions.numeric import ratio, total

    whole = df.agg(total(value).alias("_whole"))
    return with_total(df, whole).withColumn(out, ratio(value, "_whole")).drop("_whole")


def share_of_group(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """value / sum(value) per group, by a pre-aggregated total joined back.

    A window would bring every row of a hot group into one task; here only one
    partial sum per task and group is shuffled. Null keys form one group.
    """
    from stocktide.functions.numeric import ratio, total

    sums = df.groupBy(*by).agg(total(value).alias("_whole"))
    right = sums.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_whole")
    cond = None
    for k in by:
        hit = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = hit if cond is None else cond & hit
    joined = df.join(right, cond, "left")
    return joined.withColumn(out, ratio(value, "_whole")).drop("_whole", *[f"_k_{k}" for k in by])


def semi(df: DataFrame, keys_from: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keys_from.select(*keys), keys, "left_semi")


def anti(df: DataFrame, right: DataFrame, cond) -> DataFrame:
    return df.join(right, cond, "left_anti")


def not_in(df: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """SQL ``key NOT IN (select value ...)`` with its null rules.

    A null among the values rejects every row; a null key passes only an empty list.
    Spark would broadcast the whole right side for this; here the right side is joined
    as a plain anti-join and only two counts of it are attached.
    """
    right = values.select(F.col(value).alias("_v"))
    summary = right.agg(F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_known"))
    kept = with_total(df.join(right, df[key] == F.col("_v"), "left_anti"), summary)
    return kept.where((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(key).isNotNull())).drop("_n", "_known")


def within_window(df: DataFrame, windows: DataFrame, key: str, day: str, start: str, end: str, bucket_days: int = 32) -> DataFrame:
    """Left join to validity windows: equal key and start <= day <= end (both ends count), one row per pair.

    Time is cut into buckets of ``bucket_days`` days. A window stands once in each bucket that it touches, a day in one, so a pair
    meets once, in the group of its (key, bucket): an item with many rows or windows is spread over its buckets, and a day meets
    only the windows of its bucket. Windows are first cut to the span of the days in ``df`` (two scalars), so an open end costs
    no buckets beyond the data; a null or reversed window meets nothing.
    """
    span = df.agg(F.min(F.col(day).cast("date")).alias("first"), F.max(F.col(day).cast("date")).alias("last"))
    low, high = (F.col(c).cast("date") for c in (start, end))
    held = with_total(windows, span).where((F.col(start) <= F.col(end)) & (low <= F.col("last")) & (high >= F.col("first")))
    number = lambda d: F.floor(F.unix_date(d) / bucket_days)
    right = held.withColumn("_wb", F.explode(F.sequence(number(F.greatest(low, F.col("first"))), number(F.least(high, F.col("last"))))))
    right = right.drop("first", "last").withColumnRenamed(key, "_wk")
    cond = (F.col(key) == F.col("_wk")) & (F.col("_db") == F.col("_wb")) & (F.col(day) >= F.col(start)) & (F.col(day) <= F.col(end))
    return df.withColumn("_db", number(F.col(day).cast("date"))).join(right, cond, "left").drop("_wk", "_wb", "_db")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Join on a coarse key with the left rows spread over ``salts`` buckets per key.

    The right side (the smaller one) is repeated once per bucket, so a key that holds
    a third of the rows is served by ``salts`` tasks. Exact for inner and left joins.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    bucket = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    spread = left.withColumn("_salt", bucket)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def full_zero(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on coalesced keys with missing numbers read as zero."""
    return left.join(right, keys, "full").fillna(0)


def later_pairs(df: DataFrame, entity: list[str], period: str, amount: str | None = None) -> DataFrame:
    """Each (entity, period) with the same entity's equal-or-later periods, one row per pair.

    ``df`` holds one row per entity and period, so an entity's list is bounded by the
    number of periods. The list is built once and expanded in place: no self-join, and
    pairs are never shuffled before the next aggregation folds them. With ``amount``
    only later periods whose amount is not lower count. A row without any such partner
    (unknown entity, period or amount) stays with a null later period.
    """
    item = F.struct(F.col(period).alias("p"), *([F.col(amount).alias("a")] if amount else []))
    lists = df.groupBy(*entity).agg(F.collect_list(item).alias("_all"))
    known = None
    for e in entity:
        known = F.col(e).isNotNull() if known is None else known & F.col(e).isNotNull()
    first = lists.select("*", F.explode("_all").alias("_f"))

    def partner(x):
        ok = x["p"] >= F.col("_f.p")
        if amount:
            ok = ok & (x["a"] >= F.col("_f.a"))
        return ok

    later = F.when(known, F.filter("_all", partner))
    return first.select(*entity, F.col("_f.p").alias("period_from"), later.alias("_later")).select(
        *entity, "period_from", F.explode_outer("_later").alias("_t")
    ).select(*entity, "period_from", F.col("_t.p").alias("period_to"))
