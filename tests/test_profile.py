import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehealth.operators import profile as p


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_readings_profile(readings):
    rows = by_column(p.profile(readings, "readings"))
    picked = {
        c: (r.non_null_count, r.unique_count, r.null_rate, r.unique_rate, r.min_val, r.max_val, r.is_likely_pk)
        for c, r in rows.items()
    }
    assert picked == {
        "sensor_id": (12, 12, 0.0, 100.0, "501", "512", True),
        "station_id": (11, 11, 8.33, 91.67, "31", "41", False),
        "state": (12, 3, 0.0, 25.0, None, None, False),
        "level": (12, 11, 0.0, 91.67, "-1.50", "30.00", False),
    }
    assert {r.total_rows for r in rows.values()} == {12}
    assert rows["state"]["values"] == ["idle", "live", "off"] and rows["level"]["values"] is None
    assert [r.ordinal for r in sorted(rows.values(), key=lambda r: r.ordinal)] == [1, 2, 3, 4]


def test_modes_agree_on_small_data(readings):
    exact = sorted(map(tuple, p.profile(readings, "t").collect()))
    refined = sorted(map(tuple, p.profile(readings, "t", mode="refined").collect()))
    assert refined == exact
    approx = by_column(p.profile(readings, "t", mode="approx"))
    assert not approx["sensor_id"].is_likely_pk and not approx["sensor_id"].is_exact
    assert approx["station_id"].non_null_count == 11


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c map<string,int>")
    for mode in p.MODES:
        rows = by_column(p.profile(df, mode=mode))
        assert {(r.total_rows, r.non_null_count, r.unique_count) for r in rows.values()} == {(0, 0, 0)}
        assert {(r.null_rate, r.unique_rate, r.is_likely_pk) for r in rows.values()} == {(0.0, 0.0, False)}


def test_all_null_column(spark):
    df = spark.range(20).select(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("s"))
    for r in p.profile(df).collect():
        assert (r.total_rows, r.non_null_count, r.unique_count, r.null_rate) == (20, 0, 0, 100.0)
        assert r["values"] == []


def test_no_columns_and_unknown_columns(spark, readings):
    with pytest.raises(ValueError):
        p.profile(spark.createDataFrame([], "a int").drop("a"))
    with pytest.raises(ValueError):
        p.profile(readings, columns=["nope"])
    with pytest.raises(ValueError):
        p.profile(readings, mode="fast")
    assert [r["column"] for r in p.profile(readings, columns=["state"]).collect()] == ["state"]


def test_odd_and_case_colliding_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a b` int, `x.y` int, Id int, id int")
    assert [r["column"] for r in p.profile(df).orderBy("ordinal").collect()] == ["a b", "x.y", "Id", "id"]


@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_wide_table_keeps_every_column(spark, mode):
    df = spark.createDataFrame([tuple(range(205))] * 3, ", ".join(f"col{i} int" for i in range(205)))
    rows = p.profile(df, mode=mode).collect()
    assert len(rows) == 205 and {r.non_null_count for r in rows} == {3}


def test_special_types(spark):
    df = spark.sql(
        """select map('a', 1) m, array(1, 2) a, named_struct('x', 1) s, x'0102' b, true t,
                  parse_json('{"k": 1}') v, date'2024-01-02' d, timestamp_ntz'2024-01-02 03:04:05' ts,
                  interval '1' day i, interval '2' year y
           union all
           select map('b', 1), array(1, 3), null, x'0103', false,
                  parse_json('{"k": 2}'), null, null, null, null"""
    )
    for mode in p.MODES:
        rows = by_column(p.profile(df, mode=mode))
        assert {c: r.unique_count for c, r in rows.items()} == {
            "m": 2, "a": 2, "s": 1, "b": 2, "t": 2, "v": 2, "d": 1, "ts": 1, "i": 1, "y": 1
        }
        assert rows["d"].min_val == "2024-01-02" and rows["ts"].max_val == "2024-01-02 03:04:05"
        assert rows["m"].min_val is None and rows["i"].min_val is not None
    assert by_column(p.profile(df))["b"]["values"] == ["0102", "0103"]


def test_long_texts_are_told_apart_whole(spark):
    base = "x" * (p.LONG_TEXT + 50)
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "a",), ("short",), (None,)], "t string")
    row = p.profile(df).first()
    assert (row.total_rows, row.non_null_count, row.unique_count) == (5, 4, 3)
    assert row["values"] == sorted([base + "a", base + "b", "short"])
    listed = p.accepted_values(df, ["t"]).first()
    assert listed["values"] == sorted([base + "a", base + "b", "short"])


def test_value_list_stops_at_ten(spark):
    df = spark.range(11).select((F.col("id") % 10).alias("ten"), "id")
    rows = by_column(p.profile(df.repartition(7)))
    assert rows["ten"]["values"] == [str(i) for i in range(10)]
    assert rows["id"]["values"] is None
    assert [r["column"] for r in p.accepted_values(df, ["ten", "id"]).collect()] == ["ten"]


def test_hot_value_is_combined_before_the_shuffle(spark):
    df = spark.range(0, 100000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k")
    )
    row = p.profile(df).first()
    assert (row.total_rows, row.unique_count) == (100000, 66667)


def test_profile_never_expands_rows(readings):
    plan = p.profile(readings)._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_refined_counts_near_unique_columns_exactly(spark):
    df = spark.range(5000).select("id", (F.col("id") % 700).alias("mid"), (F.col("id") % 3).alias("few"))
    rows = by_column(p.profile(df, mode="refined"))
    assert rows["id"].is_likely_pk and rows["id"].is_exact
    assert rows["few"]["values"] == ["0", "1", "2"] and rows["few"].is_exact
    assert not rows["mid"].is_exact and abs(rows["mid"].unique_count - 700) < 150


def test_samples(readings):
    rows = by_column(p.sample_values(readings, order_by=["sensor_id"]))
    assert rows["sensor_id"].sample_values == ["501", "502", "503"]
    assert rows["level"].sample_values == ["4.50", "12.00", "7.25"]
    assert p.sample_rows(readings).count() == 5
    assert [r.sensor_id for r in p.sample_rows(readings, 2, ["sensor_id"]).collect()] == [501, 502]


def test_many_tables(readings, spark):
    rows = p.profile_many({"o": readings, "r": spark.range(3)}).collect()
    assert sorted((r.table, r["column"]) for r in rows) == [
        ("o", "level"), ("o", "sensor_id"), ("o", "state"), ("o", "station_id"), ("r", "id")
    ]


def test_long_values_of_other_types_are_listed(spark):
    df = spark.range(40).select(F.sequence(F.lit(0), F.lit(200) + F.col("id") % 2).alias("a"))
    row = p.profile(df).first()
    assert row.unique_count == 2 and [len(v) > 700 for v in row["values"]] == [True, True]
    assert len(p.accepted_values(df, ["a"]).first()["values"]) == 2


def test_values_that_only_look_alike(spark):
    df = spark.sql(
        """select * from values (0.0d, timestamp'2024-10-27 00:30:00Z', '1'), (-0.0d, timestamp'2024-10-27 01:30:00Z', '1 '),
           (double('nan'), null, null) t(d, ts, s)"""
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # both times read 02:30 there
    try:
        rows = by_column(p.profile(df))
        assert (rows["d"].unique_count, rows["ts"].unique_count, rows["s"].unique_count) == (2, 2, 2)
        assert rows["ts"]["values"] == ["2024-10-27 02:30:00"] * 2 and rows["d"].max_val == "NaN"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_coarse_estimates_do_not_change_decisions(spark):
    df = spark.range(0, 40000, 1, 4).select("id", (F.col("id") % 10).alias("ten"), (F.col("id") % 37000).alias("most"))
    rows = by_column(p.profile(df, mode="refined", rsd=0.15))
    assert rows["id"].is_likely_pk and rows["most"].is_exact and len(rows["ten"]["values"]) == 10


def test_whole_numbers_share_words(spark):
    edge = [-(2**63), 2**63 - 1, -65, -64, -1, 0, 63, 64, None, 0, -1]
    df = spark.createDataFrame([(x, None if x is None else x % 50) for x in edge], "a long, b long").selectExpr(
        "a", "cast(b as byte) b", "b > 20 t", "date_add(date'1969-12-31', cast(b as int)) d",
        "cast((b - 25) / 100 as decimal(18,2)) m", "cast(b as decimal(30,5)) w", "cast(b / 4 as float) f",
        "timestamp_millis(b * 3) ts",
    )
    rows = by_column(p.profile(df))
    want = df.selectExpr(*(f"count(distinct {c}) as {c}" for c in df.columns)).first()
    assert {c: r.unique_count for c, r in rows.items()} == want.asDict()
    assert {r.non_null_count for r in rows.values()} == {10}
    for c in df.columns:
        ends = df.selectExpr(f"cast(min({c}) as string)", f"cast(max({c}) as string)").first()
        assert (rows[c].min_val, rows[c].max_val) == ((None, None) if c == "t" else tuple(ends)), c
        listed = sorted(r[0] for r in df.selectExpr(f"cast({c} as string) x").distinct().collect() if r[0] is not None)
        assert rows[c]["values"] == listed, c
    guessed = by_column(p.profile(df, mode="approx"))
    assert {(c, r.min_val, r.max_val) for c, r in guessed.items()} == {(c, r.min_val, r.max_val) for c, r in rows.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(-200, 200)), max_size=60))
def test_any_whole_numbers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a long")
    row = p.profile(df).first()
    there = {v for v in values if v is not None}
    ends = (str(min(there)), str(max(there))) if there else (None, None)
    assert (row.total_rows, row.unique_count, row.min_val, row.max_val) == (len(values), len(there), *ends)
    assert row["values"] == (sorted(map(str, there)) if len(there) <= p.LISTED_VALUES else None)


def test_dense_numbers_travel_as_words(spark):
    df = spark.range(0, 64_000, 1, 1).selectExpr("id", "date_from_unix_date(cast(id % 6400 as int)) d")
    values = p._values(df, p._fields(df, "t", None))
    assert values.groupBy("at").count().collect() == [(0, 1000), (1, 100)]


def test_repeatable_rows_for_any_partitioning(spark):
    df = spark.range(500).selectExpr(
        "id % 490 as a", "if(id % 7 = 0, null, cast(id % 5 as string)) as `b.c`", "map('k', id % 3) as m", "cast(string(id) as binary) as A"
    )
    draws = [p.repeatable_rows(d, 9) for d in (df, df.repartition(7), df.coalesce(1).sortWithinPartitions("`b.c`"))]
    assert draws[0].columns == df.columns
    texts = [sorted(map(str, d.collect())) for d in draws]
    assert texts[0] == texts[1] == texts[2] and len(set(texts[0])) == 9
    assert sorted(map(str, p.repeatable_rows(df, 9, "x").collect())) != texts[0]
    assert "TakeOrderedAndProject" in draws[0]._jdf.queryExecution().executedPlan().toString()
    assert p.repeatable_rows(df.limit(0)).count() == 0 and p.repeatable_rows(df, 900).count() == 500
    pair = spark.createDataFrame([("ab", ""), ("a", "b"), (None, "")], "x string, y string")
    assert p.repeatable_rows(pair.unionAll(pair), 9).distinct().count() == 3
