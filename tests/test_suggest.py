import json

import pytest
from pyspark.sql import functions as F

from tablehealth.operators import profile as p
from tablehealth.operators import suggest as s

PROFILE = (
    "table string, ordinal int, column string, data_type string, total_rows bigint, "
    "non_null_count bigint, unique_count bigint, is_exact boolean, values array<string>, "
    "sample_values array<string>"
)


def profile_row(spark, column, filled, unique, samples=None, values=None, total=100):
    df = spark.createDataFrame(
        [("t", 1, column, "int", total, filled, unique, True, values, samples)], PROFILE
    )
    rate = lambda part: F.when(F.col("total_rows") == 0, 0.0).otherwise(
        F.bround(part / F.col("total_rows") * 100, 2)
    )
    return df.select(
        "*",
        rate(F.col("total_rows") - F.col("non_null_count")).alias("null_rate"),
        rate(F.col("unique_count")).alias("unique_rate"),
    )


def suggested(profile, **options):
    rows = s.suggest(profile, s.rules(**options)).orderBy("ordinal", "rule_order").collect()
    return [(r.test_name, r.confidence) for r in rows]


def test_readings_exact_lists(readings):
    rows = s.suggest_table(readings, "readings").orderBy("ordinal", "rule_order").collect()
    assert [(r["column"], r.test_name, r.confidence) for r in rows] == [
        ("sensor_id", "not_null", "high"),
        ("sensor_id", "unique", "high"),
        ("station_id", "unique", "medium"),
        ("state", "not_null", "high"),
        ("state", "accepted_values", "high"),
        ("level", "not_null", "high"),
    ]
    assert [r["values"] for r in rows if r.test_name == "accepted_values"] == [["idle", "live", "off"]]


def test_readings_sampled_lists(readings):
    few = readings.orderBy("sensor_id").limit(10)
    profile = p.profile(few, "t").join(
        p.sample_values(few, order_by=["sensor_id"]).select("ordinal", "sample_values"), "ordinal"
    )
    rows = s.suggest(profile, s.rules(values="sample")).collect()
    lists = {r["column"]: r["values"] for r in rows if r.test_name == "accepted_values"}
    assert lists == {
        "sensor_id": ["501", "502", "503"],
        "station_id": ["31", "32", "33"],
        "state": ["idle", "live"],
        "level": ["12.00", "4.50", "7.25"],
    }


@pytest.mark.parametrize(
    "column, filled, unique, samples, expected",
    [
        ("user_id", 100, 100, [], {"not_null", "unique"}),
        ("status", 100, 3, ["placed", "shipped", "completed"], {"not_null", "accepted_values"}),
        ("order_id", 100, 95, [], {"not_null", "unique"}),
        ("notes", 50, 50, [], set()),
    ],
)
def test_synthetic_profiles(spark, column, filled, unique, samples, expected):
    got = suggested(profile_row(spark, column, filled, unique, samples), values="sample")
    assert {name for name, _ in got} == expected


def test_confidence_depends_on_known_values(spark):
    assert ("accepted_values", "medium") in suggested(profile_row(spark, "status", 100, 3))
    known = profile_row(spark, "status", 100, 2, values=["active", "inactive"])
    assert ("accepted_values", "high") in suggested(known)


def test_time_and_id_name_rules(spark):
    assert suggested(profile_row(spark, "Seen_At", 9950, 5000, total=10000)) == [("not_null", "medium")]
    assert suggested(profile_row(spark, "seen_at", 9900, 5000, total=10000)) == []
    assert suggested(profile_row(spark, "user_id", 95, 50)) == [("not_null", "medium")]
    assert suggested(profile_row(spark, "user_id", 94, 50)) == []
    assert suggested(profile_row(spark, "ID", 95, 90)) == [("not_null", "medium"), ("unique", "medium")]
    assert suggested(profile_row(spark, "paid", 95, 90)) == []


def test_one_null_in_a_million(spark):
    row = profile_row(spark, "x", 999_999, 500, total=1_000_000)
    assert row.first().null_rate == 0.0
    assert suggested(row) == []
    assert suggested(row, parity=True) == [("not_null", "high")]
    at = profile_row(spark, "x_at", 999_999, 500, total=1_000_000)
    assert suggested(at) == [("not_null", "medium")]


def test_few_rows_and_empty_tables(spark):
    row = profile_row(spark, "x", 9, 2, total=9)
    assert suggested(row) == [("not_null", "high")]
    assert s.notes(row).first().note == "Only 9 rows: suggestions may not be reliable"
    empty = profile_row(spark, "x", 0, 0, total=0)
    assert suggested(empty) == [("not_null", "high")]
    assert s.notes(empty).count() == 1
    assert s.notes(profile_row(spark, "x", 10, 2, total=10)).count() == 0


def test_grouping_and_registry_form(spark):
    profile = profile_row(spark, "status", 100, 2, values=["a", "b"])
    row = s.as_test_entries(s.grouped(profile)).first()
    assert [t.name for t in row.tests] == ["not_null", "accepted_values"]
    assert row.tests[0].config is None
    assert json.loads(row.tests[1].config) == {"values": ["a", "b"]}


def test_rules_are_data(spark):
    extra = s.Rule("positive", F.lit("low"), F.col("unique_count") > 5, F.lit("because"))
    rows = s.suggest(profile_row(spark, "x", 100, 50), [*s.rules(), extra]).collect()
    assert [(r.test_name, r.rule_order) for r in rows] == [("not_null", 1), ("positive", 7)]
    with pytest.raises(ValueError):
        s.rules(values="guess")


def test_rules_do_not_shuffle(spark):
    plan = s.suggest(profile_row(spark, "x", 100, 50))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_texts_get_their_list(spark):
    long = "y" * (p.LONG_TEXT + 1)
    df = spark.range(20).select(F.when(F.col("id") < 10, long).otherwise("short").alias("t"))
    for mode in ("exact", "refined"):
        rows = s.suggest_table(df, mode=mode).collect()
        assert [r["values"] for r in rows if r.test_name == "accepted_values"] == [["short", long]]
