"""Sinks: one dataset per report sheet, ordered only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.operators.ordering import report_order


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                order=None, partition_by=None, partitions: str = "static", **options) -> None:
    """One dataset. ``order`` sorts by range partitioning, so no task holds the whole result.

    Overwriting replaces the whole dataset; ``partitions="dynamic"`` replaces only the partitions that ``df`` holds.
    """
    out = report_order(df, order) if order else df
    writer = out.write.format(fmt).mode(mode).options(partitionOverwriteMode=partitions, **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def sheet_folder(name: str) -> str:
    return name.lower().replace(" ", "_")


def write_report(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 order: dict[str, list] | None = None, **options) -> dict[str, str]:
    """One dataset per sheet under ``path``; returns sheet name to location."""
    places = {name: f"{path.rstrip('/')}/{sheet_folder(name)}" for name in sheets}
    if len(set(places.values())) < len(places):
        raise ValueError("two sheets share a folder: " + ", ".join(sorted(sheets)))
    for name, df in sheets.items():
        write_table(df, places[name], fmt, order=(order or {}).get(name), **options)
    return places


def row_counts(df: DataFrame, by: Column | str | None = None) -> DataFrame:
    """Rows per source file (or per given column)."""
    key = F.col("_metadata.file_path").alias("source_file") if by is None else by
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def reconcile(read: DataFrame, kept: DataFrame, rejected: DataFrame | None = None, key: str = "source_file",
              failed: DataFrame | None = None) -> DataFrame:
    """Rows read, appended and rejected per file; with ``failed``, files that could not be read have ``failed`` 1 and no rows."""
    out = (read.groupBy(key).agg(F.count(F.lit(1)).alias("rows_read"))
           .join(kept.groupBy(key).agg(F.count(F.lit(1)).alias("rows_appended")), key, "full"))
    if rejected is not None:
        out = out.join(rejected.groupBy(key).agg(F.count(F.lit(1)).alias("rows_rejected")), key, "full")
    if failed is not None:
        out = out.join(failed.select(key, F.lit(1).alias("failed")), key, "full")
    return out.fillna(0)
