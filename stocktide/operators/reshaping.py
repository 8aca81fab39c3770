"""Totals, grouping sets, pivots and unpivots.

The columns of a pivot are a given list, or come from the data in two phases: the distinct values first, then the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.numeric import or_zero, total


def unpivot_days(df: DataFrame, ids: list[str], days: list[str], name: str = "date", value: str = "value") -> DataFrame:
    """One column per day to one row per day; nulls are kept."""
    long = df.unpivot(ids, days, name, value)
    return long.withColumn(name, F.col(name).cast("date"))


def melt(df: DataFrame, ids: list[str], measures: dict[str, str], name: str = "attr", value: str = "val") -> DataFrame:
    """Measures to long form in one scan. ``measures`` maps label to column."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(label).alias(name), F.col(c).cast("double").alias(value)) for label, c in measures.items()]))
    return df.select(*ids, pairs.alias("_m")).select(*ids, f"_m.{name}", f"_m.{value}")


def listed(df: DataFrame, column: str, values: list, other: str | None = None) -> DataFrame:
    """Guard of a pivot's fixed list: a value outside it fails the job, or goes to the column ``other``."""
    c = F.col(column)
    stray = F.lit(other) if other is not None else F.raise_error(
        F.concat(F.lit(f"value of {column} outside the pivot list: "), c.cast("string")))
    return df.withColumn(column, F.when(c.isNull() | c.isin(values), c).otherwise(stray))


#: Most columns that a pivot takes from its data: ten years of days.
MOST_COLUMNS = 3_660


def found_values(df: DataFrame, column: str, most: int = MOST_COLUMNS) -> list:
    """First phase of a pivot over open values: the known values of ``column`` in order, read in a job of its own.

    More than ``most`` are an error, so neither the driver nor the result's width follows the size of the data; a column
    without such a bound belongs in ``pivot_map``.
    """
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values; use pivot_map")
    return sorted(found)


def _cells(df: DataFrame, index: list[str], column: str, values: list | None, other: str | None):
    """Second phase: rows grouped and spread over the columns, found or listed."""
    if values is None:
        if other is not None:
            raise ValueError("a column for other values needs a list of values")
        return df.groupBy(*index).pivot(column, found_values(df, column))
    return listed(df, column, values, other).groupBy(*index).pivot(column, [*values, other] if other is not None else values)


def pivot_map(df: DataFrame, index: list[str], column: str, cell: Column) -> DataFrame:
    """A pivot with any number of columns: one map ``cells`` from column value to ``cell`` per index, null columns left out.

    Cells are folded by (index, column) first, so a map holds one entry per distinct column value of its index.
    """
    cells = df.where(F.col(column).isNotNull()).groupBy(*index, column).agg(cell.alias("_cell"))
    return cells.groupBy(*index).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), F.col("_cell"))))).alias("cells"))


def pivot_sum(df: DataFrame, index: list[str], column: str, values: list | None = None, value: str = "val", other: str | None = None) -> DataFrame:
    """Sum pivot with report rules: null index or column keys are left out, a null value
    counts as zero inside a cell that has rows, a cell without rows stays null. A value outside ``values`` fails, or counts in the column ``other``;
    without ``values`` the columns come from the data."""
    known = df.where(_all_known([*index, column]))
    return _cells(known, index, column, values, other).agg(F.sum(or_zero(F.col(value).cast("double"))))


def pivot_mean(df: DataFrame, index: list[str], column: str, values: list | None = None, value: str = "val", other: str | None = None) -> DataFrame:
    """Mean pivot; rows without any value are left out. A value outside ``values`` fails, or counts in the column ``other``;
    without ``values`` the columns come from the data."""
    known = df.where(_all_known([*index, column, value]))
    return _cells(known, index, column, values, other).agg(F.avg(F.col(value)))


def pivot_two_keys(df: DataFrame, index: list[str], outer: str, inner: str, outer_values: list | None = None,
                   inner_values: list | None = None, value: str = "val") -> DataFrame:
    """Pivot on two column levels with flat names ``outer_inner``; a level without a list is found in the data."""
    known = df.where(_all_known([*index, outer, inner]))
    outer_values = found_values(known, outer) if outer_values is None else outer_values
    inner_values = found_values(known, inner) if inner_values is None else inner_values
    names = [f"{o}_{i}" for o in outer_values for i in inner_values]
    flat = df.where(_all_known([outer, inner])).withColumn("_pair", F.concat_ws("_", F.col(outer), F.col(inner)))
    return pivot_sum(flat, index, "_pair", names, value)


def pivot_single(df: DataFrame, index: list[str], column: str, values: list | None, measures: list[str]) -> DataFrame:
    """Pivot without aggregation: the job fails if a cell would hold two rows or a value is outside ``values`` (None: found in the data)."""
    values = found_values(df, column) if values is None else values

    def once(m):
        clash = F.raise_error(F.lit("pivot cell holds more than one row"))
        return F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.max(m))

    aggs = [once(m).alias(m) for m in measures]
    wide = listed(df.where(F.col(column).isNotNull()), column, values).groupBy(*index).pivot(column, values).agg(*aggs)
    if len(measures) == 1:
        return wide.select(*index, *[F.col(f"`{v}`").alias(f"{measures[0]}_{v}") for v in values])
    return wide.select(*index, *[F.col(f"`{v}_{m}`").alias(f"{m}_{v}") for m in measures for v in values])


def _all_known(names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull()
    return cond


def all_known(names: list[str]) -> Column:
    return _all_known(names)


def sets_of(df: DataFrame, sets: list[list[str]], aggs: list[Column], keys: list[str] | None = None) -> DataFrame:
    """GROUPING SETS in one pass, with ``_gid`` telling the sets apart (bit set = key rolled up)."""
    names = keys or list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in names]).agg(
        F.grouping_id().alias("_gid"), *aggs)


def gid(keys: list[str], kept: list[str]) -> int:
    """The grouping id of a set."""
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in kept)


def with_grand_total(df: DataFrame, keys: list[str], measures: list[str], label: str = "Total",
                     complete: Column | None = None) -> DataFrame:
    """Sums per key plus one grand-total row.

    Rows with a null key are left out. The total counts only complete rows, as a margin
    does: by default those whose measures are all known (pass ``F.lit(True)`` for all rows).
    """
    fits = _all_known(measures) if complete is None else complete
    # one partial aggregate feeds both levels
    base = df.where(_all_known(keys)).groupBy(*keys).agg(
        *[total(m).alias(f"_g_{m}") for m in measures],
        *[total(F.when(fits, F.col(m))).alias(f"_t_{m}") for m in measures])
    both = base.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_gid"),
        *[total(f"_g_{m}").alias(f"_g_{m}") for m in measures],
        *[total(f"_t_{m}").alias(f"_t_{m}") for m in measures])
    grand = F.col("_gid") != 0
    heads = [F.when(grand, F.lit(label if i == 0 else "")).otherwise(F.col(k).cast("string")).alias(k)
             for i, k in enumerate(keys)]
    return both.select(*heads, *[or_zero(F.when(grand, F.col(f"_t_{m}")).otherwise(F.col(f"_g_{m}"))).alias(m)
                                 for m in measures])


def cross_totals(df: DataFrame, row: str, column: str, values: list[str], measure: str, label: str = "Total",
                 complete: Column | None = None) -> DataFrame:
    """Two-way pivot of sums with row totals, column totals and a grand total (totals count complete rows).

    A row key equal to ``label`` keeps a row of its own; a column value outside ``values`` fails.
    """
    if label in values:
        raise ValueError(f"the total label {label!r} is also a column value")
    fits = F.col(measure).isNotNull() if complete is None else complete
    base = listed(df.where(_all_known([row, column])).withColumn("_fits", fits), column, values).groupBy(row, column).agg(
        total(measure).alias("_g"), total(F.when(F.col("_fits"), F.col(measure))).alias("_t"), F.max("_fits").alias("_fit"))
    cube = base.cube(row, column).agg(F.grouping_id().alias("_gid"), total("_g").alias("_g"), total("_t").alias("_t"),
                                      F.max("_fit").alias("_fit"))
    cells = cube.where((F.col("_gid") == 0) | F.col("_fit")).select(
        (F.col("_gid") >= 2).alias("_all"),
        F.when(F.col("_gid") >= 2, F.lit(label)).otherwise(F.col(row)).alias(row),
        F.when(F.col("_gid") % 2 == 1, F.lit(label)).otherwise(F.col(column)).alias("_c"),
        or_zero(F.when(F.col("_gid") == 0, F.col("_g")).otherwise(F.col("_t"))).alias("_v"))
    return cells.groupBy(row, "_all").pivot("_c", [*values, label]).agg(F.first("_v")).drop("_all")


def append_mean_row(df: DataFrame, key: str, measures: list[str], label: str = "avg.") -> DataFrame:
    """Append one row with the mean of every column (nulls skipped)."""
    mean = df.agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in measures]).withColumn(key, F.lit(label))
    typed = df.select(F.col(key).cast("string").alias(key), *[F.col(f"`{m}`").cast("double").alias(m) for m in measures])
    return typed.unionByName(mean)


def joined_list(c: str, sep: str = ", ") -> Column:
    """Sorted values as one text."""
    return F.array_join(F.sort_array(F.collect_list(c)), sep)
