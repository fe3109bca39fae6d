from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tablehealth.operators import drift
from tablehealth.sources import footers


def test_columns_of_many_tables(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).selectExpr("id", "cast(id as decimal(9,2)) `a b`", "array(named_struct('x', id)) deep", "timestamp'2024-01-01' at").write.parquet(f"{root}/one")
    spark.range(3).selectExpr("id % 2 kind", "cast(id as string) body").write.partitionBy("kind").parquet(f"{root}/two")
    pq.write_table(pa.table({"n": pa.array([1], pa.int32()), "t": pa.array([0], pa.timestamp("us"))}), f"{root}/three.parquet")
    (tmp_path / "empty").mkdir()
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    tables = spark.createDataFrame(
        [("p", "one", f"{root}/one"), ("p", "two", f"file://{root}/two"), ("q", "three", f"{root}/three.parquet"),
         ("q", "empty", f"{root}/empty"), ("q", "bad", f"{root}/bad.parquet"), ("q", "gone", f"{root}/gone"), ("q", "null", None)],
        "project_id string, `table` string, path string",
    )
    rows = footers.columns(tables.withColumn("error", F.lit("theirs"))).collect()
    found = {}
    for r in rows:
        found.setdefault(r.table, []).append((r.ordinal, r.column, r.data_type))
    assert sorted(found["one"]) == [
        (1, "id", "bigint"), (2, "a b", "decimal(9,2)"), (3, "deep", "array<struct<x:bigint>>"), (4, "at", "timestamp")
    ]
    assert sorted(found["two"]) == [(1, "body", "string"), (2, "kind", None)]
    assert sorted(found["three"]) == [(1, "n", "int"), (2, "t", "timestamp_ntz")]
    for name in ("empty", "bad", "gone", "null"):
        assert found[name] == [(None, None, None)]
    assert {r.table for r in rows if r.error} == {"empty", "bad", "gone", "null"}
    assert footers.columns(tables.limit(0)).collect() == []


def test_drift_against_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2).selectExpr("id", "id % 2 part").write.partitionBy("part").parquet(path)
    tables = spark.createDataFrame([("t", path)], "`table` string, path string")
    declared = spark.createDataFrame([("t", 0, "ID", "text"), ("t", 1, "part", "integer")], "`table` string, pos int, `column` string, data_type string")
    rows = drift.detect(footers.columns(tables), declared).collect()
    assert [(r.column_name, r.drift_type, r.db_type) for r in rows] == [("id", "type_changed", "bigint")]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    data = spark.range(0, 500, 1, 3).selectExpr(
        "if(id % 5 = 0, null, id - 7) n", "date_add(date'2024-02-27', cast(id % 9 as int)) `the.day`", "id % 2 = 0 flag",
        "if(id = 3, double('NaN'), id / 4) ratio", "cast(id as decimal(9,2)) price", "concat('t', id) text", "cast(null as int) nothing",
    )
    data.write.parquet(path)
    fields = list(enumerate(data.schema.fields, 1))
    assert "PushedAggregation: [COUNT(*), COUNT(n), MIN(n), MAX(n)" in plan_of(footers._pushed(spark, path, fields[:1], fields[:1]))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    rows = {r.column: r for r in footers.counts(spark, "t", path).collect()}
    assert [(c, r.total_rows, r.non_null_count, r.min_val, r.max_val) for c, r in rows.items()] == [
        ("n", 500, 400, "-6", "492"), ("the.day", 500, 500, "2024-02-27", "2024-03-06"), ("flag", 500, 500, None, None),
        ("ratio", 500, 500, None, None), ("price", 500, 500, None, None), ("text", 500, 500, None, None), ("nothing", 500, 0, None, None),
    ]
    rows = {r.column: r for r in footers.counts(spark, "t", path, scan=True).collect()}
    assert (rows["ratio"].min_val, rows["ratio"].max_val) == ("0.0", "NaN")
    assert (rows["price"].min_val, Decimal(rows["price"].max_val)) == ("0.00", 499)


def test_counts_of_odd_tables(spark, tmp_path):
    nested = str(tmp_path / "nested")
    spark.range(4).selectExpr("named_struct('a', id, 'b', 1) s", "if(id = 0, null, array(id, id)) list", "id").write.parquet(nested)
    rows = footers.counts(spark, "t", nested).collect()
    assert [(r.column, r.total_rows, r.non_null_count, r.max_val) for r in rows] == [("s", 4, 4, None), ("list", 4, 3, None), ("id", 4, 4, "3")]
    empty = str(tmp_path / "none")
    spark.range(0).write.parquet(empty)
    assert [tuple(r)[4:] for r in footers.counts(spark, "t", empty, scan=True).collect()] == [(0, 0, None, None)]
    bare = str(tmp_path / "bare.parquet")
    pq.write_table(pa.table({"n": pa.array([3, None, 8])}), bare, write_statistics=False)
    assert [tuple(r)[4:] for r in footers.counts(spark, "t", bare).collect()] == [(3, 2, "3", "8")]
    parts = str(tmp_path / "parts")
    spark.range(6).selectExpr("id", "id % 3 k").write.partitionBy("k").parquet(parts)
    assert [tuple(r)[2:] for r in footers.counts(spark, "t", parts).collect()] == [
        ("id", "bigint", 6, 6, "0", "5"), ("k", "int", 6, 6, "0", "2")
    ]
