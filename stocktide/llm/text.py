"""Words and n-grams of a text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these.
SPACE = r"[\x20\x09-\x0D]"
FRESH = "__stocktide_"


def named_columns(df: DataFrame, *needed: str) -> DataFrame:
    """The frame, after a check that it has the columns ``needed``; raises ValueError on a missing or ambiguous one."""
    for name in needed:
        if df.columns.count(name) != 1:
            raise ValueError(f"column {name!r} must occur once, found in {df.columns}")
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, so that extra input columns never clash with working columns."""
    out = FRESH + name
    while out.lower() in (c.lower() for c in df.columns):
        out += "_"
    return out


def split_spaces(text: Column) -> Column:
    """Pieces between single white-space characters, empty ones included; null text gives one empty piece."""
    return F.split(F.coalesce(text, F.lit("")), SPACE, -1)


def words(text: Column) -> Column:
    """The words of ``text`` in order (null and blank text: empty array)."""
    return F.array_remove(split_spaces(text), "")


def n_words(text: Column) -> Column:
    """Number of words as long."""
    return F.size(words(text)).cast("long")


def pairs_of(hashes: Column, step: int = 1) -> Column:
    """Hash of each element with the one ``step`` places later; shorter by ``step``."""
    keep = F.greatest(F.size(hashes) - step, F.lit(0))
    later = F.slice(hashes, F.lit(step + 1), keep)
    return F.zip_with(F.slice(hashes, F.lit(1), keep), later, lambda a, b: F.xxhash64(a, b))


def settled(value: Column) -> Column:
    """The same value, computed where it stands: a filter on it is not moved below, which would copy its whole expression."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``rows`` rows, counted first; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
