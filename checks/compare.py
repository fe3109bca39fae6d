"""Compare the queries with their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.inputs import TABLES
from checks.oracle import ORACLE
from checks.queries import QUERIES


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablehealth-checks")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])

    def plain(value):
        return repr(float(value)) if isinstance(value, float) else repr(value)

    return [columns[at] for at in order], sorted(tuple(plain(r[at]) for at in order) for r in rows)


def compare(
    spark: SparkSession, folder: str, name: str, queries: dict = QUERIES, oracle: dict = ORACLE
) -> tuple[bool, str]:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    start = time.time()
    df = queries[name](spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in oracle:
        return True, f"{len(left[1])} rows, {spent:.1f} s, no SQL"
    result = con.execute(oracle[name])
    right = rows_of([d[0] for d in result.description], result.fetchall())
    if left == right:
        return True, f"{len(left[1])} rows, {spent:.1f} s"
    if left[0] != right[0]:
        return False, f"columns {left[0]} and {right[0]}"
    only_left = sorted(set(left[1]) - set(right[1]))[:2]
    only_right = sorted(set(right[1]) - set(left[1]))[:2]
    return False, f"{len(left[1])} and {len(right[1])} rows\n   spark {only_left}\n   sql   {only_right}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            fine, text = compare(spark, folder, name)
        except Exception as error:  # report and go on to the next query
            fine, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not fine
        print("ok  " if fine else "FAIL", name, text[:1500], flush=True)
    print(len(QUERIES), "queries,", bad, "bad; without SQL:", sorted(set(QUERIES) - set(ORACLE)))
