import pytest
from pyspark.sql import functions as F

from tablehealth.operators import profile, snapshots

FIGURES = ["table", "ordinal", "column", "data_type", "total_rows", "non_null_count", "null_rate", "min_val", "max_val"]


def figures(rows):
    return sorted(tuple(map(str, r)) for r in rows.select(*FIGURES).collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 3000, 1, 4).selectExpr(
        "case when id % 3 = 0 then 'a/b=c' when id % 50 = 1 then null when id % 50 = 2 then '' else concat('d', id % 4) end as part",
        "id - 100 as number", "date_add(date'2024-01-01', cast(id % 40 as int)) as `the day`", "id / 7 as ratio",
        "cast(id as decimal(30,4)) / 3 as wide", "cast(id % 9 as decimal(9,2)) as price", "if(id % 5 = 0, null, concat('t', id)) as text",
        "array(id % 6) as list", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as moment",
        "parse_json(concat('{\"k\": ', id % 8, '}')) as loose", "cast(null as int) as nothing",
    )


def test_merged_parts_equal_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "s")
    snapshots.save(snapshots.summarize(table, "t", F.col("part")), path)
    stored = snapshots.read(spark, path)
    assert stored.where("column = 'number'").count() == 6
    rows = snapshots.merge(stored)
    assert figures(rows) == figures(profile.profile(table, "t"))
    exact = {r.column: r.unique_count for r in profile.profile(table, "t").collect()}
    for r in rows.collect():
        assert not r.is_exact and abs(r.unique_count - exact[r.column]) <= 3 * snapshots.RSD * exact[r.column], r


def test_a_part_is_replaced_and_others_stay(spark, table, tmp_path):
    path = str(tmp_path / "s")
    data = table.select("part", "number", "text")
    snapshots.save(snapshots.summarize(data.where("part = 'd1' and number < 500 or part = 'd2'"), "t", F.col("part")), path)
    snapshots.save(snapshots.summarize(data, "other", F.lit(7)), path)
    snapshots.save(snapshots.summarize(data.where("part = 'd1'"), "t", F.col("part")), path)
    rows = snapshots.merge(snapshots.read(spark, path))
    assert figures(rows.where("table = 't'")) == figures(profile.profile(data.where("part in ('d1', 'd2')"), "t"))
    assert figures(rows.where("table = 'other'")) == figures(profile.profile(data, "other"))


def test_changed_schemas_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.save(snapshots.summarize(spark.range(5), "t", F.lit("old")), path)
    snapshots.save(snapshots.summarize(spark.range(3).selectExpr("cast(id as string) id", "id + 1 as more"), "t", F.lit("new")), path)
    snapshots.save(snapshots.summarize(spark.range(0), "t", F.lit("none")), path)
    rows = {(r.column, r.data_type): (r.total_rows, r.unique_count, r.max_val) for r in snapshots.merge(snapshots.read(spark, path)).collect()}
    assert rows == {("id", "bigint"): (5, 5, "4"), ("id", "string"): (3, 3, None), ("more", "bigint"): (3, 3, "3")}
