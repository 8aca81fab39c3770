"""The relational building blocks, one query each, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stocktide import functions as E
from stocktide.operators import joining as J
from stocktide.operators import ordering as O
from stocktide.operators import reshaping as S
from stocktide.operators import sketches
from stocktide.operators import windows as W
from stocktide.plans.returns import label_lists
from stocktide.session import checkpoint_root
from stocktide.sources import landing, manifest, readers, writers
from stocktide.streaming.ingest import ingest_daily, pack_ingested, read_ingested, read_packed
from stocktide.workload.registry import Inputs, Registry

R = Registry()
add = R.add
C = F.col


def path(i: Inputs, name: str) -> str:
    return f"{i.sf_dir}/{name}.parquet"


def spot(i: Inputs, name: str) -> str:
    """A new folder for one run in the shared checkpoint area."""
    return f"{checkpoint_root(i.spark)}/stocktide/{name}-{uuid.uuid4().hex}"


# --- scans and sinks ------------------------------------------------------------------------------------------------------

add("s00_scan_table", lambda i: readers.read_table(i.spark, path(i, "customer")), "select * from {customer}")
add("s01_scan_columns", lambda i: readers.read_table(i.spark, path(i, "orders"), columns=["o_orderkey", "o_custkey", "o_totalprice"]),
    "select o_orderkey, o_custkey, o_totalprice from {orders}")


def folder(c: str = "source_file"):
    """The folder that a row's file was written to."""
    return F.regexp_extract(c, "/folder=([^/]+)/[^/]+$", 1).alias("folder")


def _many_files(i: Inputs):
    """Suppliers written as one folder of files per nation, scanned as one table."""
    out = spot(i, "files")
    writers.write_table(i.supplier.withColumn("folder", C("s_nationkey")), out, "csv", partition_by=["folder"])
    back = readers.read_many(i.spark, out, "csv", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", glob="*.csv",
                             file_column="source_file", recursiveFileLookup="true")
    return back.select(*i.supplier.columns, folder())


def _file_rows(i: Inputs):
    """Rows per file of the lines, written as one folder of files per return flag."""
    out = spot(i, "counted")
    writers.write_table(i.lineitem.withColumn("folder", C("l_returnflag")), out, partition_by=["folder"])
    counts = writers.row_counts(readers.read_many(i.spark, out, recursiveFileLookup="true"))
    return counts.groupBy(folder()).agg(F.sum("rows").alias("rows"))


add("s02_scan_many_files", _many_files, "select *, cast(s_nationkey as varchar) as folder from {supplier}")
add("s03_tag_sources", lambda i: readers.tag_sources({
        "customer": i.customer.select(C("c_name").alias("name"), C("c_nationkey").alias("nation"), C("c_mktsegment").alias("segment")),
        "supplier": i.supplier.select(C("s_name").alias("name"), C("s_nationkey").alias("nation"))}),
    """select c_name as name, c_nationkey as nation, c_mktsegment as segment, 'customer' as source from {customer}
    union all select s_name, s_nationkey, null, 'supplier' from {supplier}""")


def _tolerant(i: Inputs):
    """Orders as text with an unreadable code on pending ones; good and rejected rows are counted per status."""
    out = spot(i, "tolerant")
    text = i.orders.select("o_orderkey", F.when(C("o_orderstatus") == "P", F.lit("n/a")).otherwise(C("o_custkey").cast("string")).alias("code"),
                           "o_orderstatus")
    writers.write_table(text, out, "csv")
    good, bad, _ = readers.read_tolerant(i.spark, out, "o_orderkey long, code long, o_orderstatus string")
    kept = good.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"))
    return kept.unionByName(bad.agg(F.lit("rejected").alias("o_orderstatus"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("codes")))


add("s04_tolerant_scan", _tolerant, """select o_orderstatus, count(*) as n, cast(sum(o_custkey) as bigint) as codes from {orders} where o_orderstatus <> 'P' group by 1
    union all select 'rejected', count(*), null from {orders} where o_orderstatus = 'P'""")


def _files(df, order: str, out: str, heading: dict | None = None, titles: int = 0) -> None:
    """Write (folder, ``order``, line) as one text file per folder with its lines in order, below ``titles`` title lines and a heading."""
    body = df.select("folder", F.lit(1).alias("part"), C(order).alias("at"), "line")
    if heading:
        folders = df.select("folder").distinct()
        top = folders.select("folder", F.lit(0).alias("part"), F.lit(titles).alias("at"), F.element_at(F.create_map(*[
            F.lit(x) for pair in heading.items() for x in pair]), C("folder").cast("int") % len(heading)).alias("line"))
        above = folders.select("folder", F.lit(0).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(titles - 1))).alias("at"), F.lit("title").alias("line")) if titles else None
        body = body.unionByName(top) if above is None else body.unionByName(top).unionByName(above)
    placed = body.repartition("folder").sortWithinPartitions("folder", "part", "at")
    placed.select("folder", "line").write.partitionBy("folder").text(out)


def _line_positions(i: Inputs):
    """Events in one file per type, in order of their id; positions are those of the landed lines."""
    out = spot(i, "lines")
    _files(i.events.select(C("event_type").alias("folder"), "event_id", C("event_id").cast("string").alias("line")), "event_id", out)
    landed = landing.land_lines(i.spark, out, recursiveFileLookup="true")
    return readers.skip_leading(landed.lines, 2).select(folder(), "ingest_pos", C("line").cast("long").alias("event_id"))


_HEADINGS = {0: "key,name,nation,balance", 1: "name,key,Unnamed: 2,nation", 2: "balance,  supplier key ,nation,name"}


def _headed(i: Inputs):
    """Suppliers in one file per nation, in three layouts below two title lines."""
    out = spot(i, "headed")
    k, n, b = C("s_suppkey").cast("string"), C("s_name"), F.when(C("s_suppkey") % 10 == 3, F.lit("n/a")).otherwise(C("s_acctbal").cast("string"))
    nation = C("s_nationkey").cast("string")
    line = (F.when(C("s_nationkey") % 3 == 0, F.concat_ws(",", k, n, nation, b)).when(C("s_nationkey") % 3 == 1, F.concat_ws(",", n, k, F.lit("x"), nation))
            .otherwise(F.concat_ws(",", b, k, nation, n)))
    _files(i.supplier.select(nation.alias("folder"), "s_suppkey", line.alias("line")), "s_suppkey", out, _HEADINGS, 2)
    return landing.read_sheets(i.spark, out, "key long, name string, nation int, balance double, route string", 2, renames={"supplier key": "key"}, recursiveFileLookup="true")


add("s08_line_positions", _line_positions, """select event_type as folder, p as ingest_pos, event_id from
    (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as p from {events}) e where p >= 2""")
add("s00_headed_sheets", lambda i: _headed(i).rows.select("key", "name", "nation", "balance", "route", "ingest_pos"),
    """select s_suppkey as key, s_name as name, s_nationkey as nation, case when s_nationkey % 3 <> 1 then s_acctbal end as balance, cast(null as varchar) as route,
    2 + row_number() over (partition by s_nationkey order by s_suppkey) as ingest_pos from {supplier} qualify s_nationkey % 3 = 1 or s_suppkey % 10 <> 3""")
add("s04_rejected_rows", lambda i: _headed(i).rejected.select(C("ingest_pos").alias("line_no"), "line", "reason"),
    """select line_no, case when s_nationkey % 3 = 0 then s_suppkey || ',' || s_name || ',' || s_nationkey || ',n/a' else 'n/a,' || s_suppkey || ',' || s_nationkey || ',' || s_name end
    as line, 'balance is no double' as reason from (select *, 2 + row_number() over (partition by s_nationkey order by s_suppkey) as line_no from {supplier}) s
    where s_nationkey % 3 <> 1 and s_suppkey % 10 = 3""")
add("s11_file_ledger", lambda i: _headed(i).account().select(folder(), C("fault").isNotNull().alias("failed"), "rows_read", "rows_appended", "rows_rejected"),
    """select cast(s_nationkey as varchar) as folder, false as failed, count(*) as rows_read, count(*) - count(case when s_nationkey % 3 <> 1 and s_suppkey % 10 = 3 then 1 end) as rows_appended,
    count(case when s_nationkey % 3 <> 1 and s_suppkey % 10 = 3 then 1 end) as rows_rejected from {supplier} group by s_nationkey""")


def _landed_sheet(i: Inputs):
    """Codes that stand only on the first line of their block, in one file per event type; fill-down runs on the landed positions."""
    out = spot(i, "blocks")
    code = F.when(C("user_id") % 7 == 0, C("user_id").cast("string")).otherwise("")
    _files(i.events.select(C("event_type").alias("folder"), "event_id", F.concat_ws(",", code, C("event_id").cast("string")).alias("line")), "event_id", out)
    lines = landing.land_lines(i.spark, out, recursiveFileLookup="true").lines
    sheet = lines.select("source_file", "ingest_pos", F.expr("try_cast(split(line, ',')[0] as bigint)").alias("code"), F.split("line", ",")[1].cast("long").alias("event_id"))
    return W.fill_down(sheet, "code", "ingest_pos", source="source_file", block_rows=4096).select(folder(), "event_id", "code")


add("w03_fill_down_landed", _landed_sheet, """select * from (select event_type as folder, event_id, last_value(case when user_id % 7 = 0 then user_id end ignore nulls)
    over (partition by event_type order by event_id rows between unbounded preceding and current row) as code from {events}) f where code is not null""")
add("s05_ensure_columns", lambda i: readers.ensure_columns(i.customer.withColumn("Unnamed: 7", F.lit(1)), {"c_name": "string", "route": "string"}),
    "select *, cast(null as varchar) as route from {customer}")
add("s06_tidy_headings", lambda i: readers.tidy_headings(readers.rename_by_position(i.supplier, ["key", "supplier\nname", "nation\nkey", "balance"]),
                                                         {"key": "supplier key"}),
    "select s_suppkey as \"supplier key\", s_name as \"supplier name\", s_nationkey as \"nation key\", s_acctbal as balance from {supplier}")
add("s07_literal_table", lambda i: i.part.join(F.broadcast(readers.literal_table(i.spark, [("PROMO", 1), ("SMALL", 2)], "p_type string, tag int")), "p_type")
    .groupBy("p_type", "tag").agg(F.count(F.lit(1)).alias("n")),
    "select p_type, case p_type when 'PROMO' then 1 else 2 end as tag, count(*) as n from {part} where p_type in ('PROMO', 'SMALL') group by 1")
add("s08_skip_leading", lambda i: readers.skip_leading(i.events.select("event_id", "value"), 2, "event_id"),
    "select event_id, value from {events} where event_id >= 2")


def _write_report(i: Inputs):
    sheets = {"By Status": i.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
              "By Priority": i.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))}
    places = writers.write_report(sheets, spot(i, "report"), order={"By Status": ["-n"]})
    first, second = (i.spark.read.parquet(places[n]) for n in sheets)
    return first.select(C("o_orderstatus").alias("k"), "n").unionByName(second.select(C("o_orderpriority").alias("k"), "n"))


def _write_table(i: Inputs):
    out = spot(i, "table")
    writers.write_table(i.orders, out, order=["o_orderdate", "o_orderkey"])
    return i.spark.read.parquet(out)


def _ingest(i: Inputs):
    """Orders arriving in two drops of several files each; the third run finds nothing new."""
    out = spot(i, "ingest")
    files = i.orders.withColumn("folder", C("o_orderstatus"))
    for drop in (files.where("folder = 'F'"), files.where("folder <> 'F'"), None):
        if drop is not None:
            writers.write_table(drop, f"{out}/drops", mode="append", partition_by=["folder"])
        ingest_daily(i.spark, f"{out}/drops", i.orders.schema, f"{out}/table", f"{out}/checkpoint", "parquet", recursiveFileLookup="true")
    return read_ingested(i.spark, f"{out}/table").select(*i.orders.columns, folder())


add("s09_write_report", _write_report, """select o_orderstatus as k, count(*) as n from {orders} group by 1
    union all select o_orderpriority, count(*) from {orders} group by 1""")
add("s10_write_table", _write_table, "select * from {orders}")
add("s11_row_counts", _file_rows, "select l_returnflag as folder, count(*) as rows from {lineitem} group by 1")
add("x01_ingest_daily", _ingest, "select *, o_orderstatus as folder from {orders}")


def _packed(i: Inputs):
    """Orders ingested as one folder per file, half of them packed to larger files, read as one table."""
    out = spot(i, "packed")
    files = i.orders.withColumn("folder", F.date_format("o_orderdate", "yyyy-MM"))
    for drop in (files.where("folder < '1998'"), files.where("folder >= '1998'")):
        writers.write_table(drop.repartition("folder"), f"{out}/drops", mode="append", partition_by=["folder"])
        ingest_daily(i.spark, f"{out}/drops", i.orders.schema, f"{out}/table", f"{out}/checkpoint", "parquet", recursiveFileLookup="true")
        if not manifest.committed(i.spark, f"{out}/packed").count():
            pack_ingested(i.spark, f"{out}/table", f"{out}/packed")
    return read_packed(i.spark, f"{out}/table", f"{out}/packed").select(*i.orders.columns, folder())


def _versions(i: Inputs):
    """Two versions of a report with two sheets of one shape and one of another; the second replaces the first."""
    out, n = spot(i, "versions"), F.count(F.lit(1)).alias("n")
    counts = {"By Status": i.orders.groupBy(C("o_orderstatus").alias("k")).agg(n), "By Priority": i.orders.groupBy(C("o_orderpriority").alias("k")).agg(n)}
    manifest.write_sheets({"By Status": counts["By Status"].where("k = 'F'")}, out)
    manifest.write_sheets({**counts, "Part": i.part.select("p_brand").distinct()}, out, {"By Status": ["-n"]})
    got = manifest.read_sheets_of(i.spark, out)
    tagged = [got[name].select(F.lit(name).alias("sheet"), "k", "n") for name in counts]
    return tagged[0].unionByName(tagged[1]).unionByName(got["Part"].select(F.lit("Part").alias("sheet"), C("p_brand").alias("k"), F.lit(1).cast("long").alias("n")))


add("x01_packed_files", _packed, "select *, strftime(o_orderdate, '%Y-%m') as folder from {orders}")
add("s09_versioned_report", _versions, """select 'By Status' as sheet, o_orderstatus as k, count(*) as n from {orders} group by 2
    union all select 'By Priority', o_orderpriority, count(*) from {orders} group by 2 union all select distinct 'Part', p_brand, 1 from {part}""")
add("x02_duplicate_keys", lambda i: J.duplicate_keys(i.lineitem, ["l_orderkey", "l_linenumber"]),
    "select l_orderkey, l_linenumber, count(*) as instances from {lineitem} group by 1, 2 having count(*) > 1")

# --- projections and predicates -------------------------------------------------------------------------------------------

add("p01_project", lambda i: i.part.select(C("p_partkey").alias("item"), (C("p_retailprice") * 2 + C("p_size")).alias("score")),
    "select p_partkey as item, p_retailprice * 2 + p_size as score from {part}")
add("p02_equality", lambda i: i.orders.where(C("o_orderstatus") == "P"), "select * from {orders} where o_orderstatus = 'P'")
add("p03_comparison", lambda i: i.customer.where(C("c_acctbal") > 5000), "select * from {customer} where c_acctbal > 5000")
add("p04_ilike", lambda i: i.part.where(C("p_name").ilike("%RING%") & ~C("p_brand").ilike("brand#2%")),
    "select * from {part} where p_name ilike '%RING%' and p_brand not ilike 'brand#2%'")
add("p05_not_like", lambda i: i.part.where(~C("p_type").like("%S%")), "select * from {part} where p_type not like '%S%'")
add("p06_in_list", lambda i: i.part.where(C("p_type").isin("PROMO", "LARGE")), "select * from {part} where p_type in ('PROMO', 'LARGE')")
add("p07_null_tests", lambda i: i.customer.join(i.outlet_type, F.concat(F.lit("Outlet "), C("c_custkey")) == C("outlet"), "left")
    .groupBy(C("type").isNull().alias("untyped")).agg(F.count(F.lit(1)).alias("n")),
    """select type is null as untyped, count(*) as n from {customer} left join {outlet_type} on outlet = 'Outlet ' || c_custkey group by 1""")
add("p08_half_open_period", lambda i: i.orders.where(E.in_period(C("o_orderdate").cast("date"), "1998-01-01", "1998-07-01")),
    "select * from {orders} where cast(o_orderdate as date) >= date '1998-01-01' and cast(o_orderdate as date) < date '1998-07-01'")
_BAND = """select c_custkey, case when c_acctbal > 0 then c_acctbal end as bal from {customer}"""
add("p09_negation_keeps_null", lambda i: i.customer.select("c_custkey", F.when(C("c_acctbal") > 0, C("c_acctbal")).alias("bal"))
    .where(E.not_true(C("bal") >= 5000)), f"select * from ({_BAND}) b where not coalesce(bal >= 5000, false)")
add("p10_having", lambda i: i.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")).where(C("qty") > 800),
    "select l_partkey, sum(l_quantity) as qty from {lineitem} group by 1 having sum(l_quantity) > 800")
add("p11_case", lambda i: i.part.select("p_partkey", E.choose([(C("p_size") <= 10, F.lit(1)), (C("p_size") <= 30, F.lit(2)), (C("p_type") == "PROMO", F.lit(3))]).alias("band")),
    "select p_partkey, case when p_size <= 10 then 1 when p_size <= 30 then 2 when p_type = 'PROMO' then 3 else 0 end as band from {part}")
add("p12_alias_reuse", lambda i: i.customer.withColumn("half", C("c_acctbal") / 2).withColumn("sign", F.when(C("half") > 0, "plus").otherwise("minus")).select("c_custkey", "half", "sign"),
    "select c_custkey, c_acctbal / 2 as half, case when half > 0 then 'plus' else 'minus' end as sign from {customer}")
add("p13_wildcard_columns", lambda i: i.lineitem.groupBy("l_returnflag").agg(*[F.count(c).alias(c) for c in readers.columns_like(i.lineitem, contains="key")]),
    "select l_returnflag, count(l_orderkey) as l_orderkey, count(l_partkey) as l_partkey, count(l_suppkey) as l_suppkey from {lineitem} group by 1")
add("p14_column_by_date", lambda i: i.brand_day.withColumn("_last", F.max("ship_day").over(Window.partitionBy("basepack")))
    .where(C("ship_day") == C("_last")).select("basepack", "ship_day", "orders"),
    "select basepack, ship_day, orders from {brand_day} qualify ship_day = max(ship_day) over (partition by basepack)")

# --- joins ----------------------------------------------------------------------------------------------------------------

add("j01_inner", lambda i: i.lines.join(i.part, C("l_partkey") == C("p_partkey")).groupBy("p_type").agg(F.sum("qty").alias("qty")),
    "select p_type, sum(qty) as qty from {lines} join {part} on l_partkey = p_partkey group by 1")
add("j02_inner_composite", lambda i: i.rpl_town.join(i.town_class, ["town", "basepack"]).groupBy("classification").agg(F.sum("norm_qty").alias("qty")),
    "select classification, sum(norm_qty) as qty from {rpl_town} join {town_class} using (town, basepack) group by 1")
add("j03_left_enrich", lambda i: J.enrich(i.visits, i.outlet_geo.select("outlet_code", "region"), ["outlet_code"]).groupBy("region").agg(F.count(F.lit(1)).alias("n")),
    "select region, count(*) as n from {visits} left join {outlet_geo} using (outlet_code) group by 1")
add("j04_left_composite", lambda i: J.enrich(i.rpl_yesterday.select("customer_code", "sku_code"), i.lock, ["customer_code", "sku_code"]),
    "select customer_code, sku_code, lower_band, upper_band from {rpl_yesterday} left join {lock} using (customer_code, sku_code)")
add("j05_left_anti", lambda i: J.anti(i.customer, i.orders.where(C("o_orderstatus") == "P"), C("c_custkey") == C("o_custkey")),
    "select c.* from {customer} c left join (select distinct o_custkey from {orders} where o_orderstatus = 'P') o on c_custkey = o_custkey where o_custkey is null")
add("j06_not_in", lambda i: J.not_in(i.part, "p_partkey", i.lines.where((C("os") == "O") & (C("ls") == "O") & (C("rf") == "N")), "l_partkey"),
    "select * from {part} where p_partkey not in (select l_partkey from {lines} where os = 'O' and ls = 'O' and rf = 'N')")
add("j06_not_in_with_null", lambda i: J.not_in(i.part, "p_partkey", i.lines.select(F.when(C("qty") > 1, C("l_partkey")).alias("v")), "v"),
    "select * from {part} where p_partkey not in (select case when qty > 1 then l_partkey end from {lines})")
add("j07_left_semi", lambda i: J.semi(i.part.withColumnRenamed("p_partkey", "l_partkey"), i.lines.where(C("qty") >= 50), ["l_partkey"]),
    "select p_partkey as l_partkey, p_name, p_brand, p_type, p_size, p_retailprice from {part} where p_partkey in (select l_partkey from {lines} where qty >= 50)")
add("j08_semi_by_distinct", lambda i: J.semi(i.customer.withColumnRenamed("c_custkey", "o_custkey"), i.orders.where(C("o_totalprice") > 400000), ["o_custkey"]),
    """select c_custkey as o_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from {customer} c
    join (select distinct o_custkey from {orders} where o_totalprice > 400000) o on c_custkey = o_custkey""")
_OPEN = "select o_custkey as k, count(*) as {0} from {{orders}} where o_orderstatus = '{1}' group by 1"
add("j09_full_outer", lambda i: J.full_zero(
        i.orders.where(C("o_orderstatus") == "O").groupBy(C("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("open")),
        i.orders.where(C("o_orderstatus") == "F").groupBy(C("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("done")), ["k"]),
    f"select k, coalesce(open, 0) as open, coalesce(done, 0) as done from ({_OPEN.format('open', 'O')}) a full join ({_OPEN.format('done', 'F')}) b using (k)")


def _spans(i: Inputs):
    """One window per brand: from its first large shipment to 200 days later."""
    big = i.sales.where(C("qty") >= 50).groupBy(C("p_brand").alias("brand")).agg(F.min("ship_day").alias("start"))
    return big.withColumn("end", F.date_add("start", 200))


_SPANS = "(select p_brand as brand, min(ship_day) as start, min(ship_day) + 200 as stop from {sales} where qty >= 50 group by 1)"


def _overlaps(i: Inputs):
    """Three windows a brand that overlap, one of them open to the far future."""
    first = i.sales.groupBy(C("p_brand").alias("brand")).agg(F.min("ship_day").alias("d"))
    parts = [first.select("brand", F.date_add("d", a).alias("start"), (F.date_add("d", b) if b else F.lit("9999-12-31").cast("date")).alias("end"), F.lit(t).alias("tag"))
             for a, b, t in ((0, 400, "x"), (300, 500, "y"), (350, 0, "z"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OVER3 = "(select brand, d + a as start, case when b = 0 then date '9999-12-31' else d + b end as stop, t as tag from (select p_brand as brand, min(ship_day) as d from {sales} group by 1) f, (values (0, 400, 'x'), (300, 500, 'y'), (350, 0, 'z')) v(a, b, t))"
add("j10_overlapping_windows", lambda i: J.within_window(i.brand_day.withColumnRenamed("basepack", "brand"), _overlaps(i), "brand", "ship_day", "start", "end")
    .groupBy("brand", "tag").agg(F.sum("orders").alias("qty"), F.count(F.lit(1)).alias("days")),
    f"""select b.basepack as brand, tag, sum(orders) as qty, count(*) as days from {{brand_day}} b left join {_OVER3} s on b.basepack = s.brand and ship_day >= start and ship_day <= stop
    group by 1, 2""")
add("j10_interval_join", lambda i: J.within_window(i.brand_day.withColumnRenamed("basepack", "brand"), _spans(i), "brand", "ship_day", "start", "end")
    .groupBy("brand", C("start").isNotNull().alias("inside")).agg(F.sum("orders").alias("qty")),
    f"""select b.basepack as brand, start is not null as inside, sum(orders) as qty from {{brand_day}} b
    left join {_SPANS} s on b.basepack = s.brand and ship_day >= start and ship_day <= stop group by 1, 2""")
_SHEET = "(select event_id as pos, case when event_type = 'signup' then user_id end as code, value from {events})"


def _sheet(i: Inputs):
    return i.events.select(C("event_id").alias("pos"), F.when(C("event_type") == "signup", C("user_id")).alias("code"), "value")


add("j11_range_join_as_fill", lambda i: W.fill_down(_sheet(i), "code", "pos", block_rows=4096).groupBy("code").agg(F.count(F.lit(1)).alias("n")),
    f"""select code, count(*) as n from (select last_value(code ignore nulls) over (order by pos rows between unbounded preceding and current row) as code
    from {_SHEET} s) f where code is not null group by 1""")
_CM = "(select o_custkey as k, cast(year(o_orderdate) as int) as y, sum(cast(o_totalprice as decimal(18,2))) as amt from {orders} group by 1, 2)"
add("j12_later_pairs", lambda i: J.later_pairs(
        i.orders.groupBy(C("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum(C("o_totalprice").cast("decimal(18,2)")).alias("amt")), ["k"], "y", "amt")
    .groupBy("period_from", "period_to").agg(F.count("k").alias("n")),
    f"select a.y as period_from, b.y as period_to, count(distinct a.k) as n from {_CM} a left join {_CM} b on a.k = b.k and a.y <= b.y and a.amt <= b.amt group by 1, 2")
add("j13_cross_to_total", lambda i: J.share_of_total(i.lines.groupBy("l_suppkey").agg(F.sum("qty").alias("qty")), "qty", "share"),
    "select l_suppkey, qty, qty / (select sum(qty) from {lines}) as share from (select l_suppkey, sum(qty) as qty from {lines} group by 1) s")
add("j14_scalar_subquery", lambda i: J.with_total(i.customer, i.customer.agg(E.mean(C("c_acctbal").cast("decimal(18,2)")).alias("m")))
    .where(C("c_acctbal") > C("m")).drop("m"),
    "select * from {customer} where c_acctbal > (select cast(sum(cast(c_acctbal as decimal(18,2))) as double) / count(*) from {customer})")
add("j15_eav_self_join", lambda i: i.daily_kpi.groupBy("basepack").agg(
        E.total_when(C("attribute") == "Secondary Achievement", "value").alias("ach"), E.total_when(C("attribute") == "Business Contribution", "value").alias("con")),
    """select a.basepack, a.value as ach, b.value as con from {daily_kpi} a join {daily_kpi} b using (basepack)
    where a.attribute = 'Secondary Achievement' and b.attribute = 'Business Contribution'""")
add("j16_coarse_key", lambda i: J.salted_join(
        i.supplier.select(C("s_nationkey").alias("n"), "s_suppkey"), i.customer.groupBy(C("c_nationkey").alias("n"), "c_mktsegment").agg(F.count(F.lit(1)).alias("c")),
        ["n"], ["s_suppkey"], 8),
    """select s_nationkey as n, s_suppkey, c_mktsegment, c from {supplier} join (select c_nationkey as n, c_mktsegment, count(*) as c from {customer} group by 1, 2) k
    on s_nationkey = n""")
add("j17_keys_with_values", lambda i: i.supplier.select("s_suppkey", "s_name", "s_acctbal"), "select s_suppkey, s_name, s_acctbal from {supplier}")

# --- aggregations ---------------------------------------------------------------------------------------------------------

add("a01_group_sum", lambda i: i.lineitem.groupBy("l_returnflag").agg(E.total("l_quantity").alias("qty")), "select l_returnflag, sum(l_quantity) as qty from {lineitem} group by 1")
add("a02_avg_max_min_count", lambda i: i.lineitem.groupBy("l_suppkey").agg(
        E.mean("l_quantity").alias("a"), F.max("l_quantity").alias("mx"), F.min("l_shipdate").cast("date").alias("mn"), F.count(F.lit(1)).alias("n")),
    "select l_suppkey, avg(l_quantity) as a, max(l_quantity) as mx, cast(min(l_shipdate) as date) as mn, count(*) as n from {lineitem} group by 1")
add("a03_ratio_of_sums", lambda i: i.sccf_outlet.groupBy("outlet").agg(E.ratio_of_sums("inv_qty", "ord_qty").alias("fill")),
    "select outlet, sum(inv_qty) / nullif(sum(ord_qty), 0) as fill from {sccf_outlet} group by 1")
add("a04_count_distinct", lambda i: i.lines.groupBy("rf").agg(F.countDistinct("o_custkey").alias("n")), "select rf, count(distinct o_custkey) as n from {lines} group by 1")


def _sketched(i: Inputs):
    """Distinct customers per return flag over two years, exactly and from daily sketches; only whether they agree within the bound is returned."""
    days = sketches.daily_sketches(i.lines, ["rf"], "ship_day", "o_custkey")
    near = sketches.distinct_over(days, ["rf"], "1996-01-01", "1998-01-01", "near")
    exact = sketches.exact_over(i.lines, ["rf"], "ship_day", "o_custkey", "1996-01-01", "1998-01-01")
    return exact.join(near, "rf", "left").select("rf", "n", (F.abs(C("near") / C("n") - 1) <= sketches.relative_error()).alias("within_bound"))


add("a04_distinct_over_days", _sketched, """select rf, count(distinct o_custkey) as n, true as within_bound from {lines}
    where ship_day >= date '1996-01-01' and ship_day < date '1998-01-01' group by 1""")
add("a05_conditional", lambda i: i.lines.groupBy("l_suppkey").agg(E.total_when(C("ls") == "O", "qty").alias("open"), E.count_when(C("rf") == "R").alias("returned")),
    "select l_suppkey, sum(case when ls = 'O' then qty end) as open, count(case when rf = 'R' then 1 end) as returned from {lines} group by 1")
add("a06_string_list", lambda i: i.towns.select("r_name", "n_name").distinct().groupBy("r_name").agg(S.joined_list("n_name").alias("names"))
    .select("r_name", E.shorten("names", 40).alias("names")),
    """select r_name, case when length(s) > 40 then left(s, 40) || ' ...' else s end as names from
    (select r_name, string_agg(n_name, ', ' order by n_name) as s from (select distinct r_name, n_name from {towns}) t group by 1) x""")
add("a07_distinct", lambda i: i.part.select("p_brand", "p_type").distinct(), "select distinct p_brand, p_type from {part}")
add("a08_first_per_key", lambda i: O.first_per_key(i.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]),
    "select * from {orders} qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")


def _sets(i: Inputs):
    keys = ["c_mktsegment", "n_name", "r_name"]
    base = i.towns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = S.sets_of(base, [["c_mktsegment", "r_name"], ["n_name"], []], [F.sum("_n").alias("n")], keys)
    return out.drop("_gid")


add("a09_grouping_sets", _sets, "select c_mktsegment, n_name, r_name, count(*) as n from {towns} group by grouping sets ((c_mktsegment, r_name), (n_name), ())")
add("a10_grand_total", lambda i: S.with_grand_total(i.sccf_outlet, ["region", "channel"], ["ord_qty", "loss_qty"]),
    """select region, channel, sum(ord_qty) as ord_qty, sum(loss_qty) as loss_qty from {sccf_outlet} group by 1, 2
    union all select 'Total', '', sum(ord_qty), sum(loss_qty) from {sccf_outlet}""")
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
add("a11_cross_totals", lambda i: S.cross_totals(i.sales.select("r_name", "p_type", "qty"), "r_name", "p_type", _TYPES, "qty"),
    "select coalesce(r_name, 'Total') as r_name, " + ", ".join(f"sum(case when p_type = '{t}' then qty end) as \"{t}\"" for t in _TYPES)
    + ", sum(qty) as \"Total\" from {sales} group by rollup (r_name)")
add("a12_row_sum", lambda i: i.dr.select("customer_code", "basepack_code", E.sum_known(*[f"`{c}`" for c in readers.columns_like(i.dr, contains="Dispatched")]).alias("known"),
                                         E.sum_strict(*[f"`{c}`" for c in readers.columns_like(i.dr, contains="Final")]).alias("strict")),
    """select customer_code, basepack_code, coalesce(`Dispatched Qty W1`, 0) + coalesce(`Dispatched Qty W2`, 0) as known,
    `Final Customer Qty W1` + `Final Customer Qty W2` as strict from {dr}""")
add("a13_sum_of_ratios", lambda i: i.sccf_outlet.groupBy("region").agg(F.round(E.total(E.ratio("inv_qty", "ord_qty") * 100), 6).alias("pct")),
    "select region, round(sum(inv_qty / ord_qty * 100), 6) as pct from {sccf_outlet} group by 1")
add("a14_global", lambda i: i.lineitem.agg(E.total("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")), "select sum(l_quantity) as qty, count(*) as n from {lineitem}")
add("a15_mean_row", lambda i: S.append_mean_row(S.pivot_sum(i.hht_orders, ["town"], "category", _TYPES, "order_qty"), "town", _TYPES),
    "with p as (select town, " + ", ".join(f"sum(case when category = '{t}' then order_qty end) as \"{t}\"" for t in _TYPES)
    + " from {hht_orders} group by 1) select * from p union all select 'avg.', " + ", ".join(f'avg("{t}")' for t in _TYPES) + " from p")
add("a16_group_by_ordinal", lambda i: i.orders.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    "select cast(year(o_orderdate) as int) as y, o_orderstatus, count(*) as n from {orders} group by 1, 2")

# --- windows --------------------------------------------------------------------------------------------------------------

add("w01_share_of_group", lambda i: J.share_of_group(i.lines.groupBy("rf", "l_suppkey").agg(F.sum("qty").alias("qty")), ["rf"], "qty", "share"),
    "select rf, l_suppkey, qty, qty / sum(qty) over (partition by rf) as share from (select rf, l_suppkey, sum(qty) as qty from {lines} group by 1, 2) s")
add("w02_rank", lambda i: W.rank_in_group(i.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice"),
    "select p_brand, p_partkey, p_retailprice, rank() over (partition by p_brand order by p_retailprice desc) as seq from {part}")
add("w03_fill_down", lambda i: W.fill_down(_sheet(i), "code", "pos", block_rows=2048, drop_leading=False),
    f"select pos, last_value(code ignore nulls) over (order by pos rows between unbounded preceding and current row) as code, value from {_SHEET} s")
add("w04_next_block", lambda i: W.block_bounds(_sheet(i), "code", "pos"),
    f"""select code, min_pos, coalesce(lead(min_pos) over (order by min_pos) - 1, (select max(pos) from {_SHEET} m)) as max_pos from
    (select code, min(pos) as min_pos from {_SHEET} s where code is not null group by 1) f""")
add("w05_previous_period", lambda i: W.report_calendar(i.lines, "ship_day"),
    """select day, lag(day, 1) over (order by day) as prev_1, lag(day, 2) over (order by day) as prev_2, lead(day, 1) over (order by day) as next_1,
    lead(day, 2) over (order by day) as next_2 from (select distinct ship_day as day from {lines}) d""")
_ASKED = "(select report_date, basepack, sum(prim_ord_qty) as qty from {primary_daily} group by 1, 2)"
add("w05_asof_lookup", lambda i: W.asof_lookup(i.primary_daily.groupBy("report_date", "basepack").agg(F.sum("prim_ord_qty").alias("qty")),
                                               i.brand_day.where(C("stock") > 100), ["basepack"], "report_date", ["ship_day", "stock"], "ship_day", strict=True),
    f"""select p.report_date, p.basepack, qty, ship_day, stock from {_ASKED} p asof left join (select basepack, ship_day, stock from {{brand_day}} where stock > 100) s
    on p.basepack = s.basepack and p.report_date > s.ship_day""")
add("w06_delta", lambda i: W.period_delta(i.outlet_month.groupBy("basepack", "yr").agg(F.sum("qty").alias("qty")), ["basepack"], "yr", "qty"),
    """select basepack, yr, qty, qty - lag(qty) over (partition by basepack order by yr) as delta from
    (select basepack, yr, sum(qty) as qty from {outlet_month} group by 1, 2) s""")
add("w07_trailing_mean", lambda i: i.brand_day.groupBy("basepack").agg(W.trailing_mean("ship_day", "orders", "1998-03-22", 5).alias("avg_5")),
    """select basepack, case when count(case when ship_day between date '1998-03-17' and date '1998-03-21' then orders end) = 5
    then sum(case when ship_day between date '1998-03-17' and date '1998-03-21' then orders end) / 5 end as avg_5 from {brand_day} group by 1""")
add("w08_month_to_date", lambda i: i.brand_day.groupBy("basepack").agg(W.month_to_date("ship_day", "orders", "1998-03-22").alias("mtd")),
    "select basepack, sum(case when ship_day between date '1998-03-01' and date '1998-03-22' then orders end) as mtd from {brand_day} group by 1")

# --- order, sets, reshape -------------------------------------------------------------------------------------------------

add("o01_order_by", lambda i: O.report_order(i.part, ["-p_size", "p_brand", "p_partkey"]), "select * from {part} order by p_size desc, p_brand, p_partkey")
add("o02_top_k", lambda i: O.top_k(i.lines.groupBy("l_partkey").agg(F.sum("qty").alias("qty")), 50, ["-qty", "l_partkey"]),
    "select l_partkey, sum(qty) as qty from {lines} group by 1 order by 2 desc, 1 limit 50")
add("o03_top_k_then_join", lambda i: O.top_k(i.lines.groupBy("l_partkey").agg(F.sum("qty").alias("qty")), 10, ["-qty", "l_partkey"])
    .join(i.part.select(C("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"),
    """select l_partkey, qty, p_name from (select l_partkey, sum(qty) as qty from {lines} group by 1 order by 2 desc, 1 limit 10) t
    join {part} on l_partkey = p_partkey""")
add("o04_row_cap", lambda i: O.into_sheets(i.orders, ["-o_totalprice", "o_orderkey"]),
    """select * exclude (n), n // 1000000 as sheet, n % 1000000 as sheet_row from
    (select *, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as n from {orders}) o""")
add("o05_text_dates_by_value", lambda i: O.sorted_days(i.sccf_daily, "report_date", E.DAY_DOTTED),
    "select distinct report_date, strptime(report_date, '%d.%m.%Y')::date as day from {sccf_daily}")
add("u01_union_all", lambda i: label_lists(i.ps_list, i.ns_list), "select sku, 'PS' as psns_label from {ps_list} union all select sku, 'NS' from {ns_list}")
add("u02_union_distinct", lambda i: i.customer.select(C("c_nationkey").alias("n")).union(i.supplier.select("s_nationkey")).distinct(),
    "select c_nationkey as n from {customer} union select s_nationkey from {supplier}")
add("u03_append", lambda i: i.ps_list.unionByName(i.ns_list), "select sku from {ps_list} union all select sku from {ns_list}")
add("u04_append_different", lambda i: i.customer.select("c_custkey", "c_name").unionByName(i.supplier.select(C("s_name").alias("c_name"), "s_acctbal"), allowMissingColumns=True),
    "select c_custkey, c_name, null as s_acctbal from {customer} union all select null, s_name, s_acctbal from {supplier}")
add("r01_pivot_sum", lambda i: S.pivot_sum(i.hht_orders, ["town", "company"], "category", _TYPES, "order_qty"),
    "select town, company, " + ", ".join(f"sum(case when category = '{t}' then order_qty end) as \"{t}\"" for t in _TYPES) + " from {hht_orders} group by 1, 2")
# the years of the next three come from the data, on both sides
add("r02_pivot_two_keys", lambda i: S.pivot_two_keys(S.melt(i.sccf_outlet.groupBy("region", "month").agg(F.sum("loss_qty").alias("loss"), F.sum("inv_qty").alias("inv")),
                                                            ["region", "month"], {"loss": "loss", "inv": "inv"}), ["region"], "month", "attr"),
    """select * from (pivot (select region, month || '_loss' as k, loss_qty as v from {sccf_outlet} union all select region, month || '_inv', inv_qty from {sccf_outlet})
    on k using sum(v) group by region)""")
add("r03_pivot_mean", lambda i: S.pivot_mean(i.sccf_outlet, ["town"], "month", value="ord_qty"),
    "select * from (pivot (select town, month, ord_qty from {sccf_outlet}) on month using avg(ord_qty) group by town)")
add("r04_pivot_single", lambda i: S.pivot_single(i.sccf_outlet.groupBy("town", "month").agg(F.sum("ord_qty").alias("ord"), F.sum("inv_qty").alias("inv")),
                                                 ["town"], "month", None, ["ord", "inv"]),
    """select * from (pivot (select town, 'ord_' || month as k, ord_qty as v from {sccf_outlet} union all select town, 'inv_' || month, inv_qty from {sccf_outlet})
    on k using sum(v) group by town)""")
add("r05_measures_to_long", lambda i: S.melt(i.brand_day, ["basepack", "ship_day"], {"orders": "orders", "stock": "stock"}),
    "select basepack, ship_day, 'orders' as attr, orders as val from {brand_day} union all select basepack, ship_day, 'stock', stock from {brand_day}")
add("r06_reorder", lambda i: i.nation.select("n_name", "n_regionkey", "n_nationkey"), "select n_name, n_regionkey, n_nationkey from {nation}")

# --- scalar functions -----------------------------------------------------------------------------------------------------

_BAL = "case when c_acctbal > 0 then c_acctbal end"


def bal():
    """Account balance where positive, else null."""
    return F.when(C("c_acctbal") > 0, C("c_acctbal"))


def cust(key: str, expr, sql: str) -> None:
    add(key, lambda i: i.customer.select("c_custkey", expr().alias("v")), f"select c_custkey, {sql} as v from {{customer}}")


def part(key: str, expr, sql: str) -> None:
    add(key, lambda i: i.part.select("p_partkey", expr().alias("v")), f"select p_partkey, {sql} as v from {{part}}")


def order(key: str, expr, sql: str) -> None:
    add(key, lambda i: i.orders.select("o_orderkey", expr().alias("v")), f"select o_orderkey, {sql} as v from {{orders}}")




def day():
    return C("o_orderdate").cast("date")


def dot():
    return F.date_format(day(), E.DAY_DOTTED)


part("f01_upper", lambda: F.upper("p_name"), "upper(p_name)")
add("f02_upper_all_text", lambda i: E.upper_text(i.part),
    "select p_partkey, upper(p_name) as p_name, upper(p_brand) as p_brand, upper(p_type) as p_type, p_size, p_retailprice from {part}")
part("f03_left", lambda: F.left(C("p_name"), F.lit(4)), "left(p_name, 4)")
part("f04_right", lambda: F.right(C("p_name"), F.lit(4)), "right(p_name, 4)")
part("f05_length", lambda: F.length("p_name"), "cast(length(p_name) as int)")
cust("f06_concat", lambda: E.join_text("c_name", F.when(bal().isNotNull(), F.lit("!"))), f"concat(c_name, case when {_BAL} is not null then '!' end)")
cust("f07_pipe_concat", lambda: F.concat(C("c_name"), F.when(bal().isNotNull(), F.lit("!"))), f"c_name || case when {_BAL} is not null then '!' end")
part("f08_first_word", lambda: E.first_word("p_name"), "split_part(p_name, ' ', 1)")
part("f09_replace_values", lambda: E.replace_values("p_type", {"PROMO": "P", "SMALL": "S"}), "case p_type when 'PROMO' then 'P' when 'SMALL' then 'S' else p_type end")
add("f10_flat_names", lambda i: i.region.toDF(*[E.flat_name(n) for n in ("region\nkey", "region\nname")]),
    "select r_regionkey as \"region key\", r_name as \"region name\" from {region}")
_DOT = "lpad(cast(day(o_orderdate) as varchar), 2, '0') || '.' || lpad(cast(month(o_orderdate) as varchar), 2, '0') || '.' || year(o_orderdate)"
order("f11_parse_moment", lambda: E.parse_moment(dot(), E.DAY_DOTTED), f"strptime({_DOT}, '%d.%m.%Y')")
order("f12_parse_day", lambda: E.parse_day(dot(), E.DAY_DOTTED), f"strptime({_DOT}, '%d.%m.%Y')::date")
order("f13_text_to_date", lambda: E.day_from_text("o_orderdate"), "cast(left(cast(o_orderdate as varchar), 10) as date)")
order("f14_format_date", lambda: F.date_format(day(), E.DAY_WORDED), "strftime(o_orderdate, '%d %b %Y')")
order("f15_day_before", lambda: E.day_before(day()), "strftime(cast(o_orderdate as date) - 1, '%d %b %Y')")
order("f16_month_diff", lambda: E.months_apart(day(), F.lit("2001-12-31").cast("date")), "cast(datediff('month', cast(o_orderdate as date), date '2001-12-31') as int)")
order("f17_weekday", lambda: E.weekday_tag(day()), "upper(strftime(o_orderdate, '%a'))")
order("f18_run_date_text", lambda: F.concat(F.date_format(F.lit("2023-03-19").cast("date"), E.DAY_WORDED), F.lit(" "), C("o_orderstatus")), "'19 Mar 2023 ' || o_orderstatus")
part("f19_arithmetic", lambda: E.ratio(C("p_retailprice") - C("p_size") * 2 + 1, C("p_size") - 25), "(p_retailprice - p_size * 2 + 1) / nullif(p_size - 25, 0)")
cust("f20_floor", lambda: E.floor_number("c_acctbal"), "floor(c_acctbal)")
cust("f21_ceil", lambda: E.ceil_number("c_acctbal"), "ceil(c_acctbal)")
cust("f22_round_half_up", lambda: E.round_half_up(C("c_acctbal") / 8, 2), "round(c_acctbal / 8, 2)")
cust("f23_round_half_even", lambda: E.round_half_even(C("c_acctbal") / 8, 2), "round_even(c_acctbal / 8 * 100, 0) / 100")
cust("f24_round_to_integer", lambda: E.round_half_even(C("c_custkey") / 2), "round_even(c_custkey / 2, 0)")
cust("f25_least_known", lambda: E.least_known(bal(), F.lit(4000.0)), f"least({_BAL}, 4000)")
cust("f26_least_strict", lambda: E.least_strict(bal(), F.lit(4000.0)), f"case when {_BAL} is not null then least({_BAL}, 4000) end")
cust("f27_floor_zero", lambda: E.floor_zero(C("c_acctbal") - 2000), "case when c_acctbal - 2000 <= 0 then 0 else c_acctbal - 2000 end")
cust("f28_null_default", lambda: E.or_zero(bal()), f"case when {_BAL} is null then 0 else {_BAL} end")
add("f29_fill_frame", lambda i: i.customer.select("c_custkey", bal().alias("v"), F.when(bal() > 500, C("c_nationkey")).alias("n")).fillna(0),
    f"select c_custkey, coalesce({_BAL}, 0) as v, coalesce(case when c_acctbal > 500 then c_nationkey end, 0) as n from {{customer}}")
add("f30_fill_numbers", lambda i: i.customer.select("c_custkey", bal().alias("v"), F.when(bal() > 500, C("c_name")).alias("t")).fillna(0),
    f"select c_custkey, coalesce({_BAL}, 0) as v, case when c_acctbal > 500 then c_name end as t from {{customer}}")
add("f31_fill_column", lambda i: i.customer.select("c_custkey", bal().alias("v"), F.when(bal() > 500, C("c_name")).alias("t")).fillna("none", ["t"]),
    f"select c_custkey, {_BAL} as v, coalesce(case when c_acctbal > 500 then c_name end, 'none') as t from {{customer}}")
cust("f32_override_if_present", lambda: E.first_known(bal(), F.lit(-1.0)), f"coalesce({_BAL}, -1)")
cust("f33_keep_where", lambda: E.keep_where(C("c_mktsegment") == "BUILDING", "c_name", "c_mktsegment"), "case when c_mktsegment = 'BUILDING' then c_name else c_mktsegment end")
cust("f34_where", lambda: F.when(bal() > 4000, F.lit("high")).otherwise(F.lit("low")), f"case when {_BAL} > 4000 then 'high' else 'low' end")
cust("f35_select_default_zero", lambda: E.choose([(bal() > 8000, F.lit(3)), (bal() > 4000, F.lit(2))]), f"case when {_BAL} > 8000 then 3 when {_BAL} > 4000 then 2 else 0 end")
cust("f36_numeric", lambda: C("c_acctbal").cast("decimal(18,3)"), "cast(c_acctbal as decimal(18,3))")
cust("f37_int", lambda: C("c_custkey").cast("string").cast("int"), "cast(cast(c_custkey as varchar) as int)")
cust("f38_text", lambda: C("c_custkey").cast("string"), "cast(c_custkey as varchar)")
cust("f39_long", lambda: C("c_nationkey").cast("long"), "cast(c_nationkey as bigint)")
cust("f40_percent_text", lambda: E.percent_text(C("c_custkey") * 100.0 / 1024), "concat(round(c_custkey * 100.0e0 / 1024, 2), '%')")
part("f41_shorten", lambda: E.shorten("p_name", 8), "case when length(p_name) > 8 then concat(left(p_name, 8), ' ...') else p_name end")
