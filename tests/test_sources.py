import os

from pyspark.sql import functions as F

from stocktide.session import checkpoint_root, cut_lineage
from stocktide.sources import readers, writers
from stocktide.streaming.ingest import ingest_daily, read_ingested

SCHEMA = "report_date string, pack string, qty double"


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_many_files_with_names_and_counts(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    put(src, "d1.csv", ["01.01.2023,a,1", "01.01.2023,b,2"])
    put(src, "d2.csv", ["02.01.2023,a,3"])
    put(src, "note.txt", ["skip,me,1"])
    df = readers.read_many(spark, src, "csv", SCHEMA, glob="*.csv", file_column="source_file")
    assert rows(writers.row_counts(df, "source_file")) == [(f"file:{src}/d1.csv", 2), (f"file:{src}/d2.csv", 1)]
    put(f"{src}/more", "d1.csv", ["03.01.2023,a,1"])  # the same name in another folder stays apart
    assert len(rows(writers.row_counts(readers.read_many(spark, [src, f"{src}/more"], "csv", SCHEMA, glob="*.csv")))) == 3
    two = readers.read_many(spark, [f"{src}/d1.csv", f"{src}/d2.csv"], "csv", SCHEMA)
    assert two.count() == 3


def test_tolerant_scan_lists_rejected_rows(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    put(src, "good.csv", ["01.01.2023,a,1"])
    put(src, "bad.csv", ["01.01.2023,a,many", "02.01.2023,b,2"])
    good, bad, failed = readers.read_tolerant(spark, src, SCHEMA)
    a, b = f"file:{src}/good.csv", f"file:{src}/bad.csv"
    assert rows(good, "pack", "qty", "source_file") == [("a", 1.0, a), ("b", 2.0, b)]
    assert rows(bad) == [(b, "01.01.2023,a,many")] and not rows(failed)
    seen = good.select("source_file").unionByName(bad.select("source_file"))
    assert rows(writers.reconcile(seen, good, bad)) == [(b, 2, 1, 1), (a, 1, 1, 0)]


def test_columns_and_headings(make):
    df = make([(1, 2, 3)], "`a\nb` int, `Unnamed: 3` int, c int")
    tidy = readers.tidy_headings(readers.ensure_columns(df, {"c": "int", "d": "string"}), {"c": "sea"})
    assert tidy.columns == ["a b", "sea", "d"]
    assert readers.columns_like(tidy, contains="a") == ["a b", "sea"]
    assert readers.columns_like(tidy, pattern="^a") == ["a b"]


def test_tag_sources_aligns_columns(make, rows):
    out = readers.tag_sources({"N": make([1], "x int"), "S": make([(2, "q")], "x int, y string")}, "region")
    assert rows(out, "x", "y", "region") == [(1, None, "N"), (2, "q", "S")]


def test_skip_leading(make, rows):
    df = make([(0, "title"), (1, "units"), (2, "row")], "ingest_pos long, v string")
    assert rows(readers.skip_leading(df, 2), "v") == [("row",)]


def test_report_has_one_dataset_per_sheet(spark, tmp_path, make, rows):
    places = writers.write_report({"Full Data": make([1, 2], "v int"), "Top": make([3], "v int")}, str(tmp_path / "out"), order={"Full Data": ["-v"]})
    assert places["Full Data"].endswith("/full_data")
    assert rows(spark.read.parquet(places["Full Data"])) == [(1,), (2,)]


def test_ingest_equals_batch_and_is_idempotent(spark, tmp_path, rows):
    src, dest, log = (str(tmp_path / n) for n in ("in", "table", "log"))
    put(src, "d1.csv", ["01.01.2023,a,1", "01.01.2023,b,2"])
    ingest_daily(spark, src, SCHEMA, dest, log)
    put(src, "d2.csv", ["02.01.2023,a,3"])
    ingest_daily(spark, src, SCHEMA, dest, log, max_files=1)
    ingest_daily(spark, src, SCHEMA, dest, log)  # nothing new
    batch = readers.read_many(spark, src, "csv", SCHEMA, file_column="source_file")
    assert rows(read_ingested(spark, dest), *batch.columns) == rows(batch)
    # a lost log replays every file over its own partition
    ingest_daily(spark, src, SCHEMA, dest, str(tmp_path / "log2"))
    assert rows(read_ingested(spark, dest), *batch.columns) == rows(batch)


def test_checkpoint_follows_the_session_setting(spark, make):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    cut = cut_lineage(make([1, 2], "v int").groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    assert cut.count() == 2 and "Scan ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
