"""Landing of text files: every line gets its place in its file, every file its entry in a ledger, in one pass over the files.

Plain files are read by Spark's text source, which cuts a large file into blocks. A block's lines are numbered as they are read,
the lines of each block are counted, and the counts are carried forward over the blocks of a file: a table of one small row a
block. Packed files (which no reader can cut) are unpacked as streams, one task a file, whose packed bytes that task holds.

A file that cannot be read to its end, be it broken from the start or midway, does not stop the job. It is named in the ledger
with its fault and gives no lines: plain files are held against their length, packed ones against their own checksums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.functions.text import flat_name
from stocktide.operators.joining import broadcast_within
from stocktide.session import stage_table

FILE, POS, LINE = "source_file", "ingest_pos", "line"
PACKED = r"\.(gz|bz2|xz|zst)$"
#: Bytes unpacked at a time, and most small tables' rows that are sent to all tasks.
CHUNK, SMALL = 1 << 20, 100_000


def numbered(scan: DataFrame, pos: str = POS, file_column: str = FILE) -> DataFrame:
    """The rows of an unfiltered file scan with their file and their place in it: 0 to n-1, however the file is cut into blocks.

    The rows are written once with the running number of their task, so positions do not depend on a second scan.
    """
    raw = scan.select("*", F.col("_metadata.file_path").alias(file_column), F.col("_metadata.file_block_start").alias("_ingest_block"),
                      F.monotonically_increasing_id().alias("_ingest_at"))
    return _dense(stage_table(raw, "numbered"), pos, file_column)


def _dense(raw: DataFrame, pos: str, file_column: str) -> DataFrame:
    blocks = raw.groupBy(file_column, "_ingest_block").agg(F.min("_ingest_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(file_column).orderBy("_ingest_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select(F.col(file_column).alias("_of"), F.col("_ingest_block").alias("_block"),
                          (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = raw.join(broadcast_within(shift, SMALL), (F.col(file_column) == F.col("_of")) & (F.col("_ingest_block") == F.col("_block")))
    kept = [c for c in raw.columns if c not in ("_ingest_block", "_ingest_at")]
    return placed.select(*kept, (F.col("_ingest_at") + F.col("_shift")).alias(pos))


@dataclass
class Landed:
    """``lines`` (source_file, ingest_pos, line) of the whole files, and ``ledger`` (source_file, bytes, lines, fault), one row a file.

    Files of no bytes are not listed: Spark's sources pass them over.
    """

    lines: DataFrame
    ledger: DataFrame


def _stream(path: str, content: bytes):
    import bz2
    import gzip
    import io
    import lzma

    import zstandard

    data = io.BytesIO(content)
    kind = path.rsplit(".", 1)[1]
    if kind == "zst":
        return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    return {"gz": gzip.open, "bz2": bz2.BZ2File, "xz": lzma.LZMAFile}[kind](data)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of packed files; each file ends with a row without a line, which holds the number of lines and the fault."""
    import lzma
    import zlib

    import zstandard

    def rows(path: str, at: int, lines: list, fault: str | None = None) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.binary()),
                                           pa.array([fault] * n, pa.string())], names=[FILE, POS, LINE, "fault"])

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at, tail, fault = 0, b"", None
            try:
                stream = _stream(path, content.as_py())
                while chunk := stream.read(CHUNK):
                    *lines, tail = (tail + chunk).split(b"\n")
                    yield rows(path, at, lines)
                    at += len(lines)
                if tail:
                    yield rows(path, at, [tail])
                    at += 1
            except (OSError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError) as broken:
                fault = f"{type(broken).__name__}: {broken}"
            yield rows(path, at, [None], fault)


def land_lines(spark: SparkSession, paths, glob: str | None = None, **options) -> Landed:
    """All lines of the files under ``paths`` (without their line ends), and the ledger."""
    common = {**({"pathGlobFilter": glob} if glob else {}), **options}
    where = [paths] if isinstance(paths, str) else list(paths)
    files, tolerant = spark.read.format("binaryFile").options(**common).load(where), {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    listing = files.select(F.col("_metadata.file_path").alias(FILE), F.col("length").alias("bytes"))  # opens no file
    packed = F.col("_metadata.file_path").rlike(PACKED)
    plain = spark.read.options(**common, **tolerant).option("lineSep", "\n").text(where).where(~packed)
    raw = stage_table(plain.select(F.col("value").alias(LINE), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_ingest_block"),
                                   F.monotonically_increasing_id().alias("_ingest_at")), "plain_lines")
    streams = spark.read.format("binaryFile").options(**common, **tolerant).load(where).where(packed).select(F.col("_metadata.file_path"), "content")
    unpacked = stage_table(streams.mapInArrow(_unpacked, f"{FILE} string, {POS} long, {LINE} binary, fault string"), "unpacked_lines")

    read = raw.groupBy(FILE).agg(F.sum(F.octet_length(LINE) + 1).alias("_read"), F.count(F.lit(1)).alias("lines"))
    ends = unpacked.where(F.col(LINE).isNull()).select(FILE, F.col(POS).alias("_end"), F.col("fault").alias("_fault"))
    known = listing.join(read, FILE, "left").join(ends, FILE, "left")
    whole = F.coalesce("_read", F.lit(0)).between(F.col("bytes"), F.when(F.col("bytes") > 0, F.col("bytes") + 1).otherwise(0))
    short = F.concat(F.lit("read "), F.coalesce("_read", F.lit(0)), F.lit(" of "), "bytes", F.lit(" bytes"))
    fault = F.when(F.col(FILE).rlike(PACKED), F.when(F.col("_end").isNull(), F.lit("not read")).otherwise(F.col("_fault"))).when(~whole, short)
    ledger = known.select(FILE, "bytes", fault.alias("fault"), F.coalesce("lines", "_end", F.lit(0)).alias("lines"))
    ledger = stage_table(ledger.select(FILE, "bytes", F.when(F.col("fault").isNull(), F.col("lines")).otherwise(0).cast("long").alias("lines"), "fault"), "ledger")

    text = F.regexp_replace(F.col(LINE).cast("string"), "\r$", "").alias(LINE)
    every = _dense(raw, POS, FILE).select(FILE, POS, text).unionByName(unpacked.where(F.col(LINE).isNotNull()).select(FILE, POS, text))
    failed = ledger.where(F.col("fault").isNotNull()).select(FILE)
    return Landed(every.join(broadcast_within(failed, SMALL), FILE, "left_anti"), ledger)


# --- sheets ------------------------------------------------------------------------------------------------------------------

@dataclass
class Sheets:
    """``rows`` (the schema's columns, source_file, ingest_pos), ``rejected`` (source_file, ingest_pos, line, reason) and the ``ledger``."""

    rows: DataFrame
    rejected: DataFrame
    ledger: DataFrame

    def account(self) -> DataFrame:
        """Per file: rows read, appended and rejected, and its fault if it failed."""
        seen = self.rows.select(FILE, F.lit(1).alias("ok")).unionByName(self.rejected.select(FILE, F.lit(0).alias("ok")))
        counts = seen.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows_read"), F.sum("ok").alias("rows_appended"), F.sum(1 - F.col("ok")).alias("rows_rejected"))
        return self.ledger.select(FILE, "fault").join(counts, FILE, "left").fillna(0, ["rows_read", "rows_appended", "rows_rejected"])


def _fields(line: Column, width: int, sep: str) -> Column:
    """The first ``width`` fields of a line as an array of text."""
    parsed = F.from_csv(line, ", ".join(f"c{k} string" for k in range(width)), {"sep": sep})
    return F.array(*[parsed[f"c{k}"] for k in range(width)])


def _typed(raw: Column, field: T.StructField, formats: dict[str, str]) -> Column:
    if field.name in formats:
        return F.try_to_timestamp(raw, F.lit(formats[field.name])).cast(field.dataType)
    return raw if isinstance(field.dataType, T.StringType) else F.trim(raw).try_cast(field.dataType)


def sheets(landed: Landed, schema: T.StructType | str, heading_row: int = 0, renames: dict[str, str] | None = None, formats: dict[str, str] | None = None,
           sep: str = ",") -> Sheets:
    """Rows below the heading at line ``heading_row`` of every file, appended by column name.

    Each file's own heading says where its columns are: files may have them in another order, lack some (null) or have more
    (left out). Names are trimmed, line breaks in them become spaces, and ``renames`` applies; of equal names the first counts.
    ``formats`` gives the pattern of date and time columns. A row with a value that its type cannot hold, or with more fields than
    its file's heading, is rejected with the reason. Blank lines are no rows, but keep their place. Quoted line breaks are not
    part of a line.
    """
    spec = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    heads = landed.lines.where(F.col(POS) == heading_row)
    width = (heads.agg(F.max(F.size(F.split(LINE, f"[{sep}]", -1)))).first()[0] or 1) + 1  # the field after the last shows an overlong row
    names = F.create_map(*[F.lit(x) for pair in {flat_name(k): v for k, v in (renames or {}).items()}.items() for x in pair]) if renames else None

    def named(c: Column) -> Column:
        tidy = F.trim(F.regexp_replace(c, r"[\r\n]+", " "))
        return F.coalesce(F.element_at(names, tidy), tidy) if names is not None else tidy

    last = lambda fields: F.coalesce(F.array_max(F.transform(fields, lambda c, k: F.when(c.isNotNull(), k + 1))), F.lit(0))
    heads = heads.select(F.col(FILE).alias("_of"), F.transform(_fields(F.col(LINE), width, sep), named).alias("_names"),
                         last(_fields(F.col(LINE), width, sep)).alias("_known"))
    body = landed.lines.where((F.col(POS) > heading_row) & (F.trim(LINE) != ""))
    cut = body.join(broadcast_within(heads, SMALL), F.col(FILE) == F.col("_of")).withColumn("_fields", _fields(F.col(LINE), width, sep))
    raw, typed, reasons = {}, [], []
    for k, field in enumerate(spec.fields):
        at = F.array_position("_names", F.lit(field.name)).cast("int")
        raw[f"_raw{k}"] = F.when(at > 0, F.get("_fields", at - 1))
        typed.append(_typed(F.col(f"_raw{k}"), field, formats or {}).alias(field.name))
        reasons.append(F.when(F.col(f"_raw{k}").isNotNull() & _typed(F.col(f"_raw{k}"), field, formats or {}).isNull(), F.lit(f"{field.name} is no {field.dataType.simpleString()}")))
    over = F.when(last(F.col("_fields")) > F.col("_known"), F.lit("more fields than the heading"))
    parsed = cut.withColumns(raw).select(*typed, FILE, POS, F.col(LINE).alias("_line"), F.coalesce(over, *reasons).alias("_reason"))
    parsed = stage_table(parsed, "sheet_rows")
    good = parsed.where(F.col("_reason").isNull()).select(*[f"`{f.name}`" for f in spec.fields], FILE, POS)
    bad = parsed.where(F.col("_reason").isNotNull()).select(FILE, POS, F.col("_line").alias(LINE), F.col("_reason").alias("reason"))
    return Sheets(good, bad, landed.ledger)


def read_sheets(spark: SparkSession, paths, schema, heading_row: int = 0, glob: str | None = None, renames: dict[str, str] | None = None,
                formats: dict[str, str] | None = None, sep: str = ",", **options) -> Sheets:
    """Land the files and append their rows by column name, see ``sheets``."""
    return sheets(land_lines(spark, paths, glob, **options), schema, heading_row, renames, formats, sep)
