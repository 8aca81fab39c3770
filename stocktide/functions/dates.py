"""Column expressions for dates, months and weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocktide.functions.numeric import col

DAY_DOTTED = "dd.MM.yyyy"
DAY_WORDED = "dd MMM yyyy"


def parse_day(c: Column | str, fmt: str) -> Column:
    """Text to date; unreadable text gives null."""
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date")


def parse_moment(c: Column | str, fmt: str) -> Column:
    """Text to a timestamp without zone; unreadable text gives null."""
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("timestamp_ntz")


def day_from_text(c: Column | str) -> Column:
    """First ten characters of an ISO text as a date."""
    return F.left(col(c).cast("string"), F.lit(10)).try_cast("date")


def month_key(c: Column | str) -> Column:
    """``yyyy-MM`` of a date or an ISO text."""
    return F.left(col(c).cast("string"), F.lit(7))


def month_start(key: Column | str) -> Column:
    """First day of a ``yyyy-MM`` key."""
    return F.concat(col(key), F.lit("-01")).cast("date")


def month_number(c: Column | str) -> Column:
    return F.year(col(c)) * 12 + F.month(col(c))


def months_apart(a: Column | str, b: Column | str) -> Column:
    """Month boundaries between two dates (31 Jan to 1 Feb is one)."""
    return month_number(b) - month_number(a)


def weekday_tag(c: Column | str) -> Column:
    return F.upper(F.date_format(col(c), "E"))


def in_period(c: Column | str, start: str, stop: str) -> Column:
    """Half-open period: start <= day < stop."""
    day = col(c)
    return (day >= F.lit(start).cast("date")) & (day < F.lit(stop).cast("date"))


def day_before(run_date: Column, fmt: str = DAY_WORDED) -> Column:
    return F.date_format(F.date_sub(run_date, 1), fmt)
