import bz2
import datetime
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from stocktide.operators import joining, ordering, reshaping, sketches, windows
from stocktide.operators.windows import fill_down
from stocktide.sources import landing, manifest, readers
from stocktide.streaming import ingest

SCHEMA = "day date, pack string, qty double, route string"


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return f"file:{path}"


def test_positions_are_dense_over_blocks(spark, tmp_path):
    """Files cut into many blocks, some lines longer than a block."""
    random.seed(4)
    want = {}
    for name, n in (("a/x.txt", 900), ("b/x.txt", 1), ("c.txt", 300), ("empty.txt", 0)):
        lines = [f"{k} " + "w" * random.choice((0, 3, 40, 700)) for k in range(n)]
        want[put(str(tmp_path / "in" / name), "\n".join(lines))] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        landed = landing.land_lines(spark, str(tmp_path / "in"), recursiveFileLookup="true")
        scan = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "in"))
        assert scan.rdd.getNumPartitions() > 50 and scan.select(F.col("_metadata.file_block_start")).distinct().count() > 50
        plain = landing.numbered(scan)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for got in (landed.lines.collect(), plain.withColumnRenamed("value", "line").collect()):
        assert sorted((r.source_file, r.ingest_pos, r.line) for r in got) == sorted((f, k, x) for f, lines in want.items() for k, x in enumerate(lines))
    assert {(r.source_file, r.lines, r.fault) for r in landed.ledger.collect()} == {(f, len(lines), None) for f, lines in want.items() if lines}


def test_ledger_names_broken_files_in_one_pass(spark, tmp_path):
    src, text = str(tmp_path / "in"), "".join(f"{k},item {k}\n" for k in range(50_000)).encode()
    good = {put(f"{src}/one.csv.gz", gzip.compress(text)): 50_000, put(f"{src}/two.csv.bz2", bz2.compress(text[:900])): text[:900].count(b"\n") + (text[899:900] != b"\n"),
            put(f"{src}/three.csv", text): 50_000, put(f"{src}/pair.csv.gz", gzip.compress(b"1,a\n") + gzip.compress(b"2,b\r\n")): 2}
    bad = [put(f"{src}/cut.csv.gz", gzip.compress(text)[:-4000]), put(f"{src}/not.csv.gz", b"never packed"), put(f"{src}/flip.csv.bz2", bz2.compress(text)[:200])]
    bad += [put(f"{src}/many/{k}.gz", b"no" * k) for k in range(1, 40)]
    landed = landing.land_lines(spark, src, recursiveFileLookup="true")
    ledger = {r.source_file: r for r in landed.ledger.collect()}
    assert {f: r.lines for f, r in ledger.items() if r.fault is None} == good
    assert sorted(f for f, r in ledger.items() if r.fault) == sorted(bad) and all(ledger[f].lines == 0 for f in bad)
    lines = {r.source_file: r["count"] for r in landed.lines.groupBy("source_file").count().collect()}
    assert lines == good
    assert [r.line for r in landed.lines.where(F.col("source_file").endswith("pair.csv.gz")).orderBy("ingest_pos").collect()] == ["1,a", "2,b"]
    rows, rejected, failed = readers.read_tolerant(spark, [src, f"{src}/many"], "k long, name string", glob="*.gz")
    assert rows.count() == 50_002 and rejected.count() == 0 and failed.count() == 41


def test_headings_per_file(spark, tmp_path):
    src = str(tmp_path / "in")
    a = put(f"{src}/a.csv", "report\nunits\nday,pack,qty\n01.02.2023,p,1\n\n02.02.2023,\"q, big\",2.5\n")
    b = put(f"{src}/b.csv", "report\r\nunits\r\nqty, Pack Name ,Unnamed: 2,day\r\n3,r,junk,03.02.2023\r\nmany,s,,03.02.2023\r\n")
    c = put(f"{src}/c.csv", "report\nunits\npack,qty,pack,route\nt,4,other,north\nt,5,other,north,more\nt,,,\n")
    d = put(f"{src}/d.csv", "report\n")
    got = landing.read_sheets(spark, src, SCHEMA, 2, renames={"Pack Name": "pack"}, formats={"day": "dd.MM.yyyy"})
    day = lambda k: datetime.date(2023, 2, k)
    assert sorted((tuple(r) for r in got.rows.collect()), key=lambda r: r[-2:]) == [
        (day(1), "p", 1.0, None, a, 3), (day(2), "q, big", 2.5, None, a, 5), (day(3), "r", 3.0, None, b, 3), (None, "t", 4.0, "north", c, 3), (None, "t", None, None, c, 5)]
    assert sorted(tuple(r) for r in got.rejected.collect()) == [(b, 4, "many,s,,03.02.2023", "qty is no double"), (c, 4, "t,5,other,north,more", "more fields than the heading")]
    assert sorted(tuple(r) for r in got.account().collect()) == [(a, None, 2, 2, 0), (b, None, 2, 1, 1), (c, None, 3, 2, 1), (d, None, 0, 0, 0)]


def test_landed_positions_feed_fill_down_and_skip(spark, tmp_path, rows):
    f = put(str(tmp_path / "in" / "s.csv"), "title\ncode,v\n,1\nA,2\n,3\nB,4\n,5\n")
    got = landing.read_sheets(spark, str(tmp_path / "in"), "code string, v int", 1).rows
    assert rows(fill_down(got, "code", "ingest_pos", source="source_file", block_rows=2), "code", "v") == [("A", 2), ("A", 3), ("B", 4), ("B", 5)]
    assert rows(readers.skip_leading(got, 5), "v", "source_file") == [(4, f), (5, f)]


def test_window_join_equals_brute_force(spark, make, rows):
    random.seed(2)
    start = datetime.date(2022, 1, 1)
    on = lambda n: start + datetime.timedelta(days=n)
    facts = [(random.choice("hab"), on(random.randrange(300)), k) for k in range(400)] + [("a", None, -1), (None, on(3), -2), ("zz", on(3), -3)]
    wins = [(random.choice("ha"), on(s), on(s + random.choice((-1, 0, 5, 40, 200))), k) for k, s in enumerate(random.choices(range(-50, 350), k=40))]
    wins += [("b", on(-5000), datetime.date(9999, 12, 31), 98), ("a", None, on(9), 99), ("a", on(5), None, 100)]
    left, right = make(facts, "item string, day date, n int"), make(wins, "item string, s date, e date, w int")
    want = []
    for item, day, n in facts:
        hit = [w for i, s, e, w in wins if item and day and i == item and s and e and s <= day <= e]
        want += [(n, w) for w in hit] or [(n, None)]
    for bucket in (1, 32, 1000):
        out = joining.within_window(left, right, "item", "day", "s", "e", bucket_days=bucket)
        assert out.columns == ["item", "day", "n", "s", "e", "w"]
        assert sorted(rows(out, "n", "w"), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_wb" in plan and "_db" in plan
    assert joining.within_window(left.limit(0), right, "item", "day", "s", "e").count() == 0
    assert joining.within_window(left, right.limit(0), "item", "day", "s", "e").count() == len(facts)


def test_sheets_keep_every_row(make, rows):
    df = make([(k % 7, k) for k in range(100)], "a int, b int").repartition(5)
    want = sorted(((k % 7, k) for k in range(100)), key=lambda r: (-r[0], r[1]))
    assert rows(ordering.into_sheets(df, ["-a", "b"], 30)) == sorted((a, b, n // 30, n % 30) for n, (a, b) in enumerate(want))
    assert ordering.into_sheets(df.limit(0), ["a"]).count() == 0


def test_pivot_columns_from_the_data(make, rows):
    df = make([("x", "2", 1.0), ("x", "10", 2.0), ("y", "2", None), (None, "7", 1.0), ("y", None, 3.0)], "k string, c string, val double")
    assert reshaping.pivot_sum(df, ["k"], "c").columns == ["k", "10", "2"] and rows(reshaping.pivot_sum(df, ["k"], "c")) == [("x", 2.0, 1.0), ("y", None, 0.0)]
    assert rows(reshaping.pivot_mean(df, ["k"], "c")) == [("x", 2.0, 1.0)]
    with pytest.raises(ValueError, match="pivot_map"):
        reshaping.found_values(df, "c", 2)
    got = {r.k: r.cells for r in reshaping.pivot_map(df, ["k"], "c", F.sum("val")).collect()}
    assert got == {"x": {"10": 2.0, "2": 1.0}, "y": {"2": None}, None: {"7": 1.0}}
    with pytest.raises(Exception, match="outside the pivot list"):
        reshaping.pivot_sum(df, ["k"], "c", ["2"]).collect()
    other = reshaping.pivot_sum(df, ["k"], "c", ["2"], other="rest")
    assert other.columns == ["k", "2", "rest"] and rows(other) == [("x", 1.0, 2.0), ("y", 0.0, None)]
    assert reshaping.pivot_two_keys(df, ["k"], "c", "k").columns == ["k", "10_x", "10_y", "2_x", "2_y"]


def test_asof_lookup_equals_brute_force(make, rows):
    random.seed(6)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    facts = [(random.choice("hhhab"), day(random.randrange(200)), k) for k in range(300)] + [("a", None, -1), (None, day(4), -2), ("zz", day(4), -3)]
    looks = list({(k, d): (k, d, v) for k, d, v in [(random.choice("ha"), day(random.randrange(-20, 210)), random.choice((None, 1.5, 2.0, 7.0))) for _ in range(60)]}.values())
    looks += [("b", None, 9.0), (None, day(1), 9.0)]
    left, right = make(facts, "item string, day date, n int"), make(looks, "item string, seen date, price double")
    for strict in (False, True):
        want = []
        for item, d, n in facts:
            hit = [(s, v) for k, s, v in looks if item and d and k == item and s and (s < d if strict else s <= d)]
            want.append((n, max(hit, key=lambda x: x[0])[1] if hit else None))
        for block in (1, 30, 5000):
            out = windows.asof_lookup(left, right, ["item"], "day", ["price"], "seen", strict, block)
            assert out.columns == ["item", "day", "n", "price"] and sorted(rows(out, "n", "price"), key=repr) == sorted(want, key=repr)
    assert windows.asof_lookup(left.limit(0), right, ["item"], "day", ["price"], "seen").count() == 0
    assert windows.asof_lookup(left, right.limit(0), ["item"], "day", ["price"], "seen").where("price is not null").count() == 0


def test_sketches_stay_within_their_bound(spark):
    df = spark.range(200_000).select(F.expr("date_add(date'2023-01-01', cast(id % 60 as int))").alias("day"), (F.col("id") % 2).alias("k"), ((F.col("id") * 7) % 50_000).alias("v"))
    days = sketches.daily_sketches(df, ["k"], "day", "v")
    for start, stop in (("2023-01-01", "2023-01-02"), ("2023-01-05", "2023-02-10"), ("2023-01-01", "2023-04-01")):
        near = {r.k: r.n for r in sketches.distinct_over(days, ["k"], start, stop).collect()}
        exact = {r.k: r.n for r in sketches.exact_over(df, ["k"], "day", "v", start, stop).collect()}
        assert near.keys() == exact.keys() and all(abs(near[k] / exact[k] - 1) < sketches.relative_error() for k in exact)


def test_report_is_all_or_nothing(spark, tmp_path, make, rows):
    path = str(tmp_path / "report")
    assert manifest.read_sheets_of(spark, path) == {}
    first = {"Full Data": make([(1, "a"), (2, "b")], "v int, t string"), "Top": make([(3, "c")], "v int, t string"), "None": make([], "v int, t string"), "Other": make([1.5], "x double")}
    manifest.write_sheets(first, path, {"Full Data": ["-v"], "Top": ["-v"]})
    same = lambda: {n: rows(df) for n, df in manifest.read_sheets_of(spark, path).items()}
    was = same()
    assert was == {"Full Data": [(1, "a"), (2, "b")], "Top": [(3, "c")], "None": [], "Other": [(1.5,)]}
    broken = {"Top": make([(9, "z")], "v int, t string"), "Other": spark.range(3).select((F.raise_error(F.lit("midway")).cast("double")).alias("x"))}
    with pytest.raises(Exception, match="midway"):
        manifest.write_sheets(broken, path)
    assert same() == was
    manifest.write_sheets({"Top": make([(4, "d")], "v int, t string")}, path)
    assert same() == {"Top": [(4, "d")]}


def test_small_files_are_packed_once(spark, tmp_path, rows):
    src, dest, packed = (str(tmp_path / n) for n in ("in", "table", "packed"))
    for k in range(30):
        put(f"{src}/{k % 3}/d{k}.csv", "".join(f"{k},{j}\n" for j in range(50 + k)))
    ingest.ingest_daily(spark, src, "k int, j int", dest, str(tmp_path / "log"), recursiveFileLookup="true")
    want = rows(ingest.read_ingested(spark, dest))
    assert rows(ingest.read_packed(spark, dest, packed)) == want
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(dest) for f in fs if f.endswith(".parquet"))
    assert ingest.pack_ingested(spark, dest, packed, target_bytes=size // 4) == 30
    assert rows(ingest.read_packed(spark, dest, packed)) == want and ingest.pack_ingested(spark, dest, packed) == 0
    files = [f for d, _, fs in os.walk(packed) for f in fs if f.endswith(".parquet") and d.endswith("rows")]
    assert 3 <= len(files) <= 5
    put(f"{src}/late.csv", "99,1\n")
    ingest.ingest_daily(spark, src, "k int, j int", dest, str(tmp_path / "log"), recursiveFileLookup="true")
    assert rows(ingest.read_packed(spark, dest, packed)) == rows(ingest.read_ingested(spark, dest)) and len(rows(ingest.read_packed(spark, dest, packed))) == len(want) + 1
    assert ingest.pack_ingested(spark, dest, packed) == 1
