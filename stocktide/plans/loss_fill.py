"""Loss and fill rate by channel, type and outlet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.functions import ratio, total, upper_text
from stocktide.operators.joining import enrich
from stocktide.operators.reshaping import melt, pivot_two_keys
from stocktide.session import as_is

FULL_KEY = ("region", "town", "channel", "outlet_type", "outlet")
ATTRS = ("loss", "SCCF")
MEASURES = ("loss_qty", "inv_qty", "ord_qty")


def with_type(sccf: DataFrame, outlet_type: DataFrame, default: str = "unspecified") -> DataFrame:
    """Upper-cased facts with the outlet's type. Outlet codes are upper-cased on both sides."""
    types = outlet_type.select(F.upper("outlet").alias("outlet"), F.col("type").alias("outlet_type"))
    return enrich(upper_text(sccf), types, ["outlet"]).fillna(default, ["outlet_type"])


def loss_fill_long(typed: DataFrame, keys=FULL_KEY) -> DataFrame:
    """(month, keys, attr, val): summed loss, and invoiced over ordered."""
    sums = typed.groupBy("month", *keys).agg(*_sums())
    return melt(_measures(sums), ["month", *keys], {"loss": "loss", "SCCF": "SCCF"})


def _sums():
    return [total(c).alias(f"_{c}") for c in MEASURES]


def _measures(df: DataFrame) -> DataFrame:
    return df.withColumns({"loss": F.col("_loss_qty"), "SCCF": ratio("_inv_qty", "_ord_qty")})


def loss_fill_cuts(sccf: DataFrame, outlet_type: DataFrame, months: list[str], dims=FULL_KEY, stage=as_is) -> dict[str, DataFrame]:
    """The full-key pivot and one pivot per dimension.

    The facts are folded to month x outlet before the outlet's type joins them, then to the
    full key (``stage`` may store that fold); every cut
    sums the fold again, so a fill rate is always a ratio of sums.
    """
    key = ["month", "region", "town", "channel", "outlet"]
    folded = upper_text(sccf).groupBy(*key).agg(*[total(c).alias(c) for c in MEASURES])
    base = stage(with_type(folded, outlet_type).groupBy("month", *FULL_KEY).agg(*_sums()))
    columns = [f"_{c}" for c in MEASURES]

    def cut(keys: list[str], sums: DataFrame) -> DataFrame:
        long = melt(_measures(sums), ["month", *keys], {"loss": "loss", "SCCF": "SCCF"})
        return pivot_two_keys(long, keys, "month", "attr", months, list(ATTRS))

    return {"full": cut(list(FULL_KEY), base),
            **{d: cut([d], base.groupBy("month", d).agg(*[total(c).alias(c) for c in columns])) for d in dims}}
