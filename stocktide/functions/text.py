"""Column expressions for text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.functions.numeric import col


def first_word(c: Column | str) -> Column:
    """First run of non-space characters; null for blank text."""
    return F.nullif(F.regexp_extract(col(c), r"(\S+)", 1), F.lit(""))


def shorten(c: Column | str, width: int, tail: str = " ...") -> Column:
    """Cut text longer than ``width`` and append ``tail``."""
    text = col(c)
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit(tail))).otherwise(text)


def percent_text(c: Column | str) -> Column:
    """A percentage with up to two decimals followed by ``%``; null gives just ``%``."""
    from stocktide.functions.numeric import round_half_up

    return F.concat(F.coalesce(round_half_up(c, 2).cast("string"), F.lit("")), F.lit("%"))


def join_text(*cols: Column | str) -> Column:
    """Concatenate, reading null as empty text."""
    return F.concat(*[F.coalesce(col(c), F.lit("")) for c in cols])


def flat_name(name: str) -> str:
    """Heading on one line."""
    return name.replace("\n", " ")


def matches_any(c: Column | str, patterns) -> Column:
    """Case-insensitive LIKE against any of the patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | col(c).ilike(p)
    return out


def upper_text(df: DataFrame) -> DataFrame:
    """Upper-case every string column of the frame."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.upper(F.col(n)) for n in names}) if names else df


def replace_values(c: Column | str, mapping: dict, keep_other: bool = True) -> Column:
    """Whole-cell replacement by a small literal mapping."""
    source, out = col(c), None
    for old, new in mapping.items():
        cond = source.isNull() if old is None else source == F.lit(old)
        out = F.when(cond, F.lit(new)) if out is None else out.when(cond, F.lit(new))
    if out is None:
        return source
    return out.otherwise(source) if keep_other else out
