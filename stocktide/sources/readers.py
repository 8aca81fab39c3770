"""Table scans: explicit schema, many files, tagged folders, tolerant text files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.functions.text import flat_name
from stocktide.schemas import schema as role_schema
from stocktide.sources.landing import land_lines

CORRUPT = "_corrupt_record"


def _schema(spec):
    if spec is None or isinstance(spec, T.StructType):
        return spec
    return role_schema(spec) if re.fullmatch(r"\w+", spec) else T.StructType.fromDDL(spec)


def read_table(spark: SparkSession, path, fmt: str = "parquet", schema=None, columns=None, **options) -> DataFrame:
    """One table from one or many paths. ``schema`` is a StructType, DDL text or a role name."""
    reader = spark.read.format(fmt).options(**options)
    spec = _schema(schema)
    if spec is not None:
        reader = reader.schema(spec)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, paths, fmt: str = "parquet", schema=None, glob: str | None = None,
              file_column: str | None = None, **options) -> DataFrame:
    """Append many files in one scan, optionally keeping the full path of each row's file."""
    if glob:
        options["pathGlobFilter"] = glob
    df = read_table(spark, list(paths) if not isinstance(paths, str) else paths, fmt, schema, **options)
    return with_file(df, file_column) if file_column else df


def with_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Add the full path of the file each row came from (equal names in two folders stay apart)."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def tag_sources(frames: dict[str, DataFrame], column: str = "source") -> DataFrame:
    """Append frames, marking each with its key; columns may differ."""
    out = None
    for tag, df in frames.items():
        tagged = df.withColumn(column, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_tolerant(spark: SparkSession, paths, schema, fmt: str = "csv", glob: str | None = None, header: bool = False,
                  **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text files, CSV or JSON lines, in permissive mode: (good rows, rejected rows with their file, failed files).

    A row that does not fit the schema goes to the second frame with its raw text. A file that cannot be read to its end, be it
    broken from the start or midway, is named with its fault in the third frame and gives no rows. All files are read in one
    pass, however many are broken (see ``landing``); ``options`` are those of the parser.
    """
    spec = _schema(schema)
    full = T.StructType([*spec.fields, T.StructField(CORRUPT, T.StringType())])
    landed = land_lines(spark, paths, glob)
    body = landed.lines.where(F.trim("line") != "")
    body = body.where(F.col("ingest_pos") > 0) if header else body
    parse = {"csv": F.from_csv, "json": F.from_json}[fmt]
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    rows = body.withColumn("_row", parse(F.col("line"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields) if fmt == "csv" else full, how))
    good = rows.where(F.col(f"_row.{CORRUPT}").isNull()).select(*[F.col(f"_row.`{f.name}`") for f in spec.fields], "source_file")
    rejected = rows.where(F.col(f"_row.{CORRUPT}").isNotNull()).select("source_file", F.col("line").alias("raw"))
    return good, rejected, landed.ledger.where(F.col("fault").isNotNull()).select("source_file", "fault")


def ensure_columns(df: DataFrame, wanted: dict[str, str], drop_pattern: str | None = "^Unnamed") -> DataFrame:
    """Drop unnamed columns and add the wanted ones that are missing, as null."""
    keep = [c for c in df.columns if not (drop_pattern and re.search(drop_pattern, c))]
    missing = [F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in keep], *missing)


def tidy_headings(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Newlines in headings become spaces, then the rename map applies."""
    flat = df.toDF(*[flat_name(c) for c in df.columns])
    return flat.withColumnsRenamed(renames) if renames else flat


def rename_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Small inline constant table."""
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def skip_leading(df: DataFrame, n: int, pos: str = "ingest_pos") -> DataFrame:
    """Drop the first ``n`` rows by the position column written at ingest (zero-based)."""
    return df.where(F.col(pos) >= n)


def columns_like(df: DataFrame, *, contains: str | None = None, pattern: str | None = None) -> list[str]:
    """Column names chosen by substring or regular expression."""
    return [c for c in df.columns
            if (contains is None or contains in c) and (pattern is None or re.search(pattern, c))]
