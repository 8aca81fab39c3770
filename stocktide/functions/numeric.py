"""Column expressions for quantities, ratios and rounding (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE = "double"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double; null when the divisor is zero or either side is null."""
    return F.try_divide(col(num).cast(DOUBLE), col(den).cast(DOUBLE))


def total(c: Column | str) -> Column:
    """Group sum as double. Exact when the column is decimal or holds whole numbers."""
    return F.sum(col(c)).cast(DOUBLE)


def mean(c: Column | str) -> Column:
    """Group mean as sum / count, so a decimal input is added up exactly."""
    return F.try_divide(total(c), F.count(col(c)).cast(DOUBLE))


def total_when(cond: Column, c: Column | str) -> Column:
    return total(F.when(cond, col(c)))


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio_of_sums(num: Column | str, den: Column | str) -> Column:
    return ratio(total(num), total(den))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def floor_zero(c: Column | str) -> Column:
    """Clamp at zero; null stays null (``greatest`` would turn it into zero)."""
    return F.when(col(c) <= 0, F.lit(0)).otherwise(col(c))


def least_known(*cols: Column | str) -> Column:
    """Row-wise minimum over the columns that are not null."""
    return F.least(*[col(c) for c in cols])


def least_strict(a: Column | str, b: Column | str) -> Column:
    """Row-wise minimum, null as soon as one side is null."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))


def ceil_number(c: Column | str) -> Column:
    return F.ceil(col(c)).cast(DOUBLE)


def floor_number(c: Column | str) -> Column:
    return F.floor(col(c)).cast(DOUBLE)


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """Array-library rounding: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(col(c).cast(DOUBLE) * scale) / scale


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """SQL rounding of a double: scale, round half away from zero, scale back."""
    scale = float(10**digits)
    return F.round(col(c).cast(DOUBLE) * scale, 0) / scale


def sum_known(*cols: Column | str) -> Column:
    """Row-wise sum that skips nulls (an all-null row gives zero)."""
    out = or_zero(cols[0])
    for c in cols[1:]:
        out = out + or_zero(c)
    return out


def sum_strict(*cols: Column | str) -> Column:
    """Row-wise sum, null as soon as one column is null."""
    out = col(cols[0])
    for c in cols[1:]:
        out = out + col(c)
    return out


def first_known(new: Column | str, old: Column | str) -> Column:
    """The new value where present, else the old one."""
    return F.coalesce(col(new), col(old))


def keep_where(cond: Column, value: Column | str, other: Column | str) -> Column:
    return F.when(cond, col(value)).otherwise(col(other))


def choose(cases: list[tuple[Column, Column]], default=0) -> Column:
    """First matching case, else the default. A null condition does not match."""
    first, *rest = cases
    out = F.when(first[0], first[1])
    for cond, value in rest:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def not_true(cond: Column) -> Column:
    """Negation that keeps the rows where the condition is null."""
    return ~F.coalesce(cond, F.lit(False))
