"""Run the named queries and their comparison SQL side by side.

    python tests/compare.py [folder] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as contract
from surecal.plans.fixtures import TABLES


def connect(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return db


def _key(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_key(r[i]) for i in order) for r in rows),
        key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r],
    )


def compare(spark, db, sf, name):
    """None when equal, else what differs."""
    df = contract.queries()[name](spark, sf)
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want_names, want = table(columns, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{dict(zip(got_names, g))} != {dict(zip(got_names, w))}"
    return None


def main():
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls = connect(sf), contract.oracle_sql()
    for name in args[1:] or contract.queries():
        began = time.time()
        try:
            if name in sqls:
                result = compare(spark, db, sf, name) or "ok"
            else:
                result = f"no SQL, {contract.queries()[name](spark, sf).count()} rows"
        except Exception as error:
            result = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:28s} {time.time() - began:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main()
