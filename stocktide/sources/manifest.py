"""Tables that appear whole or not at all: data is written to a folder of its own, and named by a manifest row written last.

A manifest is a small Parquet table that only grows by appending; a row is there when its one file is. A job that fails midway
leaves a folder that no row names, and readers go on with what the rows before name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.operators.ordering import report_order

MANIFEST = "manifest"
ROW = "run string, written_at timestamp, name string, folder string, shape string"


def commit(spark: SparkSession, path: str, run: str, entries: list[tuple[str, str, str]]) -> None:
    """Append one run's entries (name, folder, shape) as a single file."""
    rows = spark.createDataFrame([(run, *e) for e in entries], "run string, name string, folder string, shape string")
    stamped = rows.select("run", F.current_timestamp().alias("written_at"), "name", "folder", "shape")
    stamped.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows; none where there is no manifest yet."""
    try:
        return spark.read.schema(ROW).parquet(f"{path}/{MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROW)


# --- reports ---------------------------------------------------------------------------------------------------------------

def write_sheets(sheets: dict[str, DataFrame], path: str, order: dict[str, list] | None = None) -> str:
    """Write all sheets of a report as one version and return its name.

    Sheets of one shape and order are tagged by their name and written by one partitioned job. The manifest comes last: until then,
    and for ever if a job fails, ``read_sheets_of`` gives the version before.
    """
    spark = next(iter(sheets.values())).sparkSession
    run, groups = f"run-{uuid.uuid4().hex}", {}
    for name, df in sheets.items():
        groups.setdefault((df.schema.json(), tuple(map(str, (order or {}).get(name, ())))), []).append(name)
    entries = []
    for k, ((shape, _), names) in enumerate(groups.items()):
        folder = f"{path.rstrip('/')}/{run}/{k}"
        whole = None
        for name in names:
            tagged = sheets[name].select("*", F.lit(name).alias("_sheet"))
            whole = tagged if whole is None else whole.union(tagged)
        whole = report_order(whole, ["_sheet", *(order or {}).get(names[0], ())])
        whole.write.partitionBy("_sheet").parquet(folder)
        entries += [(name, folder, shape) for name in names]
    commit(spark, path.rstrip("/"), run, entries)
    return run


def read_sheets_of(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of the latest whole version."""
    rows = committed(spark, path.rstrip("/"))
    last = rows.orderBy(F.desc("written_at"), F.desc("run")).select("run").first()
    if last is None:
        return {}
    out = {}
    for r in rows.where(F.col("run") == last["run"]).collect():  # one row per sheet
        shape = T.StructType.fromJson(json.loads(r["shape"]))
        full = T.StructType([*shape.fields, T.StructField("_sheet", T.StringType())])
        out[r["name"]] = spark.read.schema(full).parquet(r["folder"]).where(F.col("_sheet") == r["name"]).drop("_sheet")
    return out
