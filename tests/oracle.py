"""Compare registered queries with their SQL twins in DuckDB: ``python tests/oracle.py [folder] [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, connection, name, build, sql, folder):
    start = time.time()
    df = build(spark, folder)
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(spark_rows)} (no SQL)", took
    cursor = connection.execute(sql)
    duck_columns, duck_rows = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != duck_columns:
        return False, f"columns differ: {spark_columns} | {duck_columns}", took
    if spark_rows == duck_rows:
        return True, f"rows={len(spark_rows)}", took
    ours, theirs = set(spark_rows), set(duck_rows)
    return (
        False,
        f"rows {len(spark_rows)} vs {len(duck_rows)}; only spark {sorted(ours - theirs)[:3]}; "
        f"only sql {sorted(theirs - ours)[:3]}",
        took,
    )


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        if glob.glob(f"{folder}/{table}.parquet"):
            connection.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return connection


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note, took = compare(spark, connection, name, build, oracles.get(name), folder)
        except Exception as error:  # report and go on with the next query
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
