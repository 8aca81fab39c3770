"""Run registered queries in Spark and their SQL twins, and compare the row multisets.

``python tests/compare.py [sf_dir] [key prefix ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def cell(v, digits=12):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.{digits}g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows_of(columns, rows, digits=12):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(cell(r[k], digits) for k in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    data = [tuple(r) for r in df.collect()]
    got = rows_of(df.columns, data)
    if sql is None:
        return None, sum(got.values()), None, ""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    other = cur.fetchall()
    want = rows_of(names, other)
    note = ""
    if sorted(names) != sorted(df.columns):
        note = f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    elif got != want:
        extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
        note = f"{sorted(names)}\n   spark only {extra}\n   sql only {lost}"
    elif rows_of(df.columns, data, 17) != rows_of(names, other, 17):
        return True, sum(got.values()), sum(want.values()), "(equal to 12 digits)"
    return got == want and not note, sum(got.values()), sum(want.values()), note


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from stocktide.session import configure

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = configure(SparkSession.builder.master("local[8]"), partitions=8, **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if argv[1:] and not any(key.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            ok, n, m, note = compare(spark, con, sf_dir, fn, oracle.get(key))
        except Exception as e:  # report and go on
            ok, n, m, note = False, None, None, str(e)[:600]
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {key} {n} {m} {time.time() - t:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
