"""Compare Spark queries with their SQL on the same Parquet tables.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    """None if both give the same columns and rows, else a description."""
    relation = con.sql(sql)
    expected_columns, expected = list(relation.columns), relation.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    a, b = normal(df.columns, got), normal(expected_columns, expected)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0][0]} != {wrong[0][1]}"
    return None


def main(sf_dir="/root/testdata/sf0.01", *names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(sf_dir), registered.oracle_sql(), 0
    for name, run in registered.queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        try:
            if name in sql:
                result = compare(run(spark, sf_dir), con, sql[name])
            else:
                result = None if run(spark, sf_dir).count() else "no rows"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        seconds = time.perf_counter() - started
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if result else 'ok  '} {kind} {seconds:6.2f}s {name} {result or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(*sys.argv[1:])
