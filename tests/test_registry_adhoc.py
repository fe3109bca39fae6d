import pytest

from tablehealth.operators import registry as r
from tablehealth.schemas import REGISTRY_COLUMNS, REGISTRY_MODELS
from tablehealth.sources import adhoc, tables


def columns(spark, rows):
    full = [("p", m, c, pos, d, [(t, None) if isinstance(t, str) else t for t in tests]) for m, c, pos, d, tests in rows]
    return spark.createDataFrame(full, REGISTRY_COLUMNS)


def merged(spark, old, new):
    rows = r.merge_columns(columns(spark, old), columns(spark, new)).orderBy("model", "pos").collect()
    return [(x.model, x["column"], x.pos, x.description, [t.name for t in x.tests]) for x in rows]


def test_new_entry(spark):
    assert merged(spark, [], [("m", "order_id", 1, "PK", ["not_null", "unique"])]) == [
        ("m", "order_id", 1, "PK", ["not_null", "unique"])
    ]


def test_other_models_kept_and_tests_kept(spark):
    got = merged(
        spark,
        [("another", "x", 1, "X", []), ("m", "order_id", 1, "", ["not_null", "unique"])],
        [("m", "order_id", 1, "Key", ["relationships", "unique"]), ("m", "status", 2, "S", [])],
    )
    assert got == [
        ("another", "x", 1, "X", []),
        ("m", "order_id", 1, "Key", ["not_null", "unique", "relationships"]),
        ("m", "status", 3, "S", []),
    ]


def test_description_is_kept_and_config_is_ignored(spark):
    old = [("m", "c", 1, "old", [("accepted_values", '{"values":[1]}')])]
    new = [("m", "c", 1, "new", [("accepted_values", '{"values":[2]}')])]
    row = r.merge_columns(columns(spark, old), columns(spark, new)).first()
    assert row.description == "old" and [t.config for t in row.tests] == ['{"values":[1]}']


def test_repeats_inside_one_proposal_are_both_added(spark):
    assert merged(spark, [("m", "c", 1, "", ["a"])], [("m", "c", 1, "", ["b", "a", "b"])])[0][4] == ["a", "b", "b"]


def test_unnamed_columns_are_skipped(spark):
    assert merged(spark, [], [("m", "", 1, "x", []), ("m", None, 2, "x", []), ("m", "c", 3, "x", [])]) == [
        ("m", "c", 3, "x", [])
    ]


def test_repeated_proposals_merge_in_order(spark):
    new = [("m", "c", 2, "second", ["b", "c"]), ("m", "c", 1, "", ["a", "b", "b"]), ("m", "c", 3, "third", ["d"])]
    assert merged(spark, [], new) == [("m", "c", 1, "second", ["a", "b", "b", "c", "d"])]


def test_model_descriptions(spark):
    old = spark.createDataFrame([("p", "a", "old", []), ("p", "b", "old", [("t", None)]), ("p", "c", "old", [])], REGISTRY_MODELS)
    new = spark.createDataFrame(
        [("p", "a", "new", 1), ("p", "b", "", 1), ("p", "d", "fresh", 1), ("p", "d", "last", 2), ("p", "d", "", 3)],
        "project_id string, model string, description string, pos int",
    )
    rows = {x.model: (x.description, len(x.tests)) for x in r.merge_models(old, new).collect()}
    assert rows == {"a": ("new", 0), "b": ("old", 1), "c": ("old", 0), "d": ("last", 0)}


def test_reads_and_save(spark, tmp_path):
    reg = columns(spark, [("m", "b", 2, "B", ["u"]), ("m", "a", 1, "A", []), ("n", "z", 1, "Z", [])])
    assert [x["column"] for x in r.documented_columns(reg, "m").collect()] == ["a", "b"]
    assert r.documented_columns(reg, "m", "q").count() == 0
    models = spark.createDataFrame([("p", "m", "", [("unique_key", '{"x":1}')])], REGISTRY_MODELS)
    assert [x.name for x in r.model_tests(models, "m").collect()] == ["unique_key"]
    target = str(tmp_path / "v1")
    r.save(reg, target)
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(Exception):
        r.save(reg, target)


def test_guard(spark):
    spark.sql("create table if not exists guarded (a int) using parquet")
    for sql in (
        "drop table guarded",
        "insert into guarded values (1)",
        "with t as (select 1 a) insert into guarded select a from t",
        "WITH t AS (select 1 a)\n INSERT OVERWRITE guarded SELECT a FROM t",
        "select reflect('java.lang.System', 'currentTimeMillis')",
        "select `java_method` /* x */ ('java.lang.System', 'nanoTime')",
        "select identifier('reflect')('java.lang.System', 'nanoTime')",
        "select transform(a) using 'cat' as (b) from guarded",
        "with t as (select nothing from nowhere) select * from t",
        "select '--' a, reflect('java.lang.System','currentTimeMillis') b",
        "select '/*' a, java_method('java.lang.System', 'nanoTime') b, '*/' c",
        "select /* a /* b */ */ reflect /**/ ('java.lang.System', 'nanoTime')",
        r"select '\\'--' a, reflect('java.lang.System', 'nanoTime')".replace("\\\\", "\\"),
        r"select r'\' a, reflect('java.lang.System', 'nanoTime'), ''",
        "select system.builtin.reflect('java.lang.System', 'nanoTime')",
        "select transform(a) using r'cat' as (b) from guarded",
        "select 'open",
        "select 'reflect(1)' a",
        "select " + ", ".join(f"id + {n} c{n}" for n in range(60)) + ", REFLECT ('java.lang.System', 'nanoTime') from range(2)",
        "select * from range(2) where id in (select length(java_method('java.lang.System', 'nanoTime')) from guarded)",
        "",
        "-- hi\nselect 1",
    ):
        with pytest.raises(ValueError):
            adhoc.execute_query(spark, sql)
    with pytest.raises(Exception):
        adhoc.execute_query(spark, "select 1; drop table guarded")
    assert spark.table("guarded").count() == 0


def test_reads_pass_and_are_limited(spark):
    assert adhoc.execute_query(spark, " select * from range(1000)").count() == 1000
    assert adhoc.execute_query(spark, " select * from range(1000)", limit=200).count() == 200
    for text in ("reflect (1)", "-- x", "/* x", "using 'a'", "identifier(a)(b)", "insert into x", "ScriptTransformation"):
        sql = "select '" + text.replace("'", "''") + "' as a -- reflect(1)"
        assert adhoc.execute_query(spark, sql + "\n/* java_method(2) */").count() == 1
    assert adhoc.execute_query(spark, "select 1 as `reflect` from range(1)").first().reflect == 1
    assert adhoc.execute_query(spark, "with t as (select 'insert into x' a) select * from t").first().a == "insert into x"
    assert adhoc.execute_query(spark, "select :x + 1 as y", {"x": 1}).first().y == 2
    assert adhoc.execute_query(spark, "explain insert into guarded values (1)").count() == 1
    assert adhoc.execute_query(spark, "values (1), (2)").count() == 2
    assert adhoc.execute_query(spark, "select * from range(3) a join range(2) b using (id)").count() == 2
    assert spark.table("guarded").count() == 0


def test_tables(spark, readings, tmp_path):
    readings.write.mode("overwrite").saveAsTable("readings_t")
    assert tables.table_exists(spark, "default", "readings_t")
    assert not tables.table_exists(spark, "default", "missing_t")
    assert tables.read_table(spark, "readings_t", "default").count() == 12
    path = str(tmp_path / "o")
    readings.write.parquet(path)
    assert tables.read_table(spark, path).count() == 12
    with pytest.raises(ValueError):
        tables.read_table(spark, "x; drop table y")
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:x", "s", "t", column="id", lower=0, upper=9, partitions=1)
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:x", "s", "t t", column="id", lower=0, upper=9, partitions=8)
