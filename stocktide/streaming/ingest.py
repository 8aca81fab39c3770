"""New daily files into an accumulated table, each file once."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktide.operators.joining import broadcast_within
from stocktide.sources.manifest import commit, committed
from stocktide.sources.readers import _schema

#: The full path of the file a row came from, and its digest as partition key.
FILE_COLUMN, KEY_COLUMN = "source_file", "file_key"


def ingest_daily(spark: SparkSession, src: str, schema, dest: str, checkpoint: str, fmt: str = "csv",
                 glob: str | None = None, max_files: int | None = None, **options) -> None:
    """Append every file not seen before to ``dest``, partitioned by a digest of the
    file's full path, so files of the same name in different folders stay apart.

    The file source logs the files it has read in ``checkpoint`` and never splits a file over
    micro-batches; a replayed batch overwrites just its own partitions, so a lost driver or
    executor leaves no duplicates. There is no other state. ``src``, ``dest`` and
    ``checkpoint`` are shared folders.
    """
    reader = spark.readStream.format(fmt).schema(_schema(schema)).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(src).select("*", F.col("_metadata.file_path").alias(FILE_COLUMN)).withColumn(KEY_COLUMN, F.sha2(FILE_COLUMN, 256))

    def store(batch: DataFrame, _: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY_COLUMN).parquet(dest))

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_ingested(spark: SparkSession, dest: str) -> DataFrame:
    """The accumulated rows with the full path of their file."""
    return spark.read.parquet(dest).drop(KEY_COLUMN)


# --- small files -----------------------------------------------------------------------------------------------------------

#: Bytes of a packed file, and most source files that are sent to all tasks as a table of bins.
TARGET_BYTES, SMALL = 128 * 2 ** 20, 100_000


def _keys_of(spark: SparkSession, packed: str) -> DataFrame:
    """The files whose rows are in the packed table, one row each."""
    runs = [r["folder"] for r in committed(spark, packed).select("folder").collect()]  # one row per run
    return spark.read.schema(f"{KEY_COLUMN} string").parquet(*[f"{r}/keys" for r in runs]) if runs else spark.createDataFrame([], f"{KEY_COLUMN} string")


def pack_ingested(spark: SparkSession, dest: str, packed: str, target_bytes: int = TARGET_BYTES) -> int:
    """Copy the rows of all files not packed yet from ``dest`` (one folder per file) to files of about ``target_bytes``; returns how many files those were.

    Files are put into bins in the order of their key: the bytes of the files before one, over ``target_bytes``, number its bin, so
    a bin holds whole files and at most one target's worth and one file more. Files above the target have bins of their own size.
    The run's manifest row comes last: a run that fails leaves nothing that a reader sees, and is simply made again.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(dest).select(
        F.regexp_extract(F.col("_metadata.file_path"), f"/{KEY_COLUMN}=([0-9a-f]+)/", 1).alias(KEY_COLUMN), "length")  # opens no file
    fresh = sizes.join(_keys_of(spark, packed), KEY_COLUMN, "left_anti").groupBy(KEY_COLUMN).agg(F.sum("length").alias("bytes"))
    run = f"run-{uuid.uuid4().hex}"
    folder = f"{packed.rstrip('/')}/{run}"
    # files are counted in 4,096 ranges of their key first, so no window sees them all
    ranges = fresh.withColumn("_range", F.substring(KEY_COLUMN, 1, 3))
    sums = ranges.groupBy("_range").agg(F.sum("bytes").alias("_sum"))
    starts = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(KEY_COLUMN).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.join(F.broadcast(starts), F.col("_range") == F.col("_r")).select(
        KEY_COLUMN, F.floor((F.col("_start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))) / target_bytes).alias("bin"), "bytes")
    placed.write.parquet(f"{folder}/keys")
    bins = spark.read.parquet(f"{folder}/keys")
    n, files = bins.agg(F.coalesce(F.max("bin") + 1, F.lit(0)), F.count(F.lit(1))).first()
    if not files:
        return 0
    rows = spark.read.parquet(dest).join(broadcast_within(bins.select(KEY_COLUMN, "bin"), SMALL), KEY_COLUMN)
    rows.repartitionByRange(max(1, ceil(n)), "bin").drop("bin").write.parquet(f"{folder}/rows")
    commit(spark, packed.rstrip("/"), run, [("rows", folder, "")])
    return files


def read_packed(spark: SparkSession, dest: str, packed: str) -> DataFrame:
    """All ingested rows: packed ones from the packed table, the rest from their own folders."""
    loose = spark.read.parquet(dest)
    runs = [r["folder"] for r in committed(spark, packed).select("folder").collect()]
    if not runs:
        return loose.drop(KEY_COLUMN)
    rest = loose.join(broadcast_within(_keys_of(spark, packed), SMALL), KEY_COLUMN, "left_anti")
    return spark.read.parquet(*[f"{r}/rows" for r in runs]).unionByName(rest).drop(KEY_COLUMN)
