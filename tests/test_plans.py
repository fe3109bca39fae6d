"""Shapes of physical plans that matter on large inputs."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tablehealth.operators import audit, drift, lineage, profile, registry
from tablehealth.schemas import REGISTRY_COLUMNS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return plan(df)


def test_a_profile_scans_once(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = executed(profile.profile(df, columns=["l_orderkey", "l_returnflag"])).split("Initial Plan")[0]
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {"struct<l_orderkey:bigint,l_returnflag:string>"}
    assert len(re.findall(r"FileScan parquet", text)) == 1 and "Expand" not in text
    text = plan(profile.profile(df, columns=["l_orderkey", "l_returnflag"], mode="approx"))
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", text) == ["struct<l_orderkey:bigint,l_returnflag:string>"]


def test_a_profiled_join_is_computed_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
        customer = spark.read.parquet(f"{FOLDER}/customer.parquet")
        joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        text = executed(profile.profile(joined)).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall("FileScan parquet", text)) == 2


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderkey < 100")
    text = plan(profile.profile(df, columns=["o_orderstatus"]))
    assert "LessThan(o_orderkey,100)" in text


MODELS = (
    "id pos", "string(id) node_id", "string(id) name", "if(id % 2 = 0, 'text', '') description",
    "array(named_struct('name', 'c', 'description', '', 'tests', array('unique'))) columns",
)


def test_listed_models_are_computed_once(spark):
    """A sort by ranges reads its input twice, but not what the input is computed from."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed(name):
        seen.add(1)
        return f"m{name}"

    models = spark.range(40).selectExpr("string(id % 3) project_id", *MODELS, "'view' materialized", "'s' schema")
    listed = audit.list_models(models.withColumn("name", parsed("name"))).collect()
    assert [(r.project_id, r.name) for r in listed] == sorted((str(i % 3), f"m{i}") for i in range(40))
    assert seen.value == 40


def test_top_k_is_cut_before_the_shuffle(spark):
    models = spark.range(100).selectExpr("string(id % 3) project_id", *MODELS)
    for df in (audit.worst_models(audit.audit_models(models)), audit.first_by_name(models)):
        text = plan(df)
        first, last = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
        assert first < text.index("Exchange") < last  # the plan is printed from the last step up


def test_top_k_of_a_single_project_is_not_sorted_whole(spark):
    models = spark.range(100).selectExpr("'only' project_id", *MODELS)
    text = plan(audit.worst_models(audit.audit_models(models)))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_one_project_with_most_models(spark):
    models = spark.range(0, 20000, 1, 4).selectExpr(
        "if(id % 3 = 0, 'small_' || id, 'big') project_id", "id pos", "string(id) node_id", "'m' || id name",
        "if(id % 2 = 0, 'text', '') description",
        "array(named_struct('name', 'c', 'description', '', 'tests', array('unique'))) columns",
    )
    audited = audit.audit_models(models)
    row = audit.audit_projects(audited).where("project_id = 'big'").first()
    assert (row.total_models, row.tested_columns, row.test_score) == (13333, 13333, 100.0)
    assert audit.worst_models(audited).where("project_id = 'big'").count() == 10


def test_one_model_that_feeds_most_others(spark):
    models = spark.range(0, 20000, 1, 4).selectExpr(
        "'p' project_id", "string(id) node_id", "'m' || id name", "id pos",
        "if(id = 0, array(), array('model.p.m0', 'model.p.m' || (id - 1) % 8)) depends_on",
    )
    hub = lineage.fan_out(models).orderBy(F.desc("downstream_count")).first()
    assert hub.model == "m0" and hub.downstream_count == 19999 + 2500
    assert hub.consumers[:4] == ["m1", "m1", "m2", "m3"] and len(hub.consumers) == 10
    summary = lineage.summarize(lineage.graph_nodes(models), lineage.node_depths(models)).first()
    assert (summary.orphan_models, summary.high_fan_out_models, summary.max_chain_depth) == (20000 - 8, 8, 9)


def test_one_table_with_most_columns(spark):
    actual = spark.range(0, 30000, 1, 4).selectExpr(
        "if(id % 3 = 0, 'hot', 't' || id) `table`", "int(id) ordinal", "'c' || id `column`", "'int' data_type"
    )
    declared = spark.range(0, 30000, 1, 4).selectExpr(
        "if(id % 3 = 0, 'hot', 't' || id) `table`", "int(id) pos", "'C' || id `column`",
        "if(id % 2 = 0, 'bigint', 'date') data_type",
    )
    rows = drift.summarize(drift.compare(actual, declared))
    assert rows.where("`table` = 'hot'").first().type_changes == 5000
    assert rows.count() == 20001


def test_one_column_proposed_very_often(spark):
    proposals = spark.range(0, 30000, 1, 4).selectExpr(
        "'p' project_id", "'m' model", "if(id % 3 = 0, 'hot', 'c' || id) `column`", "id pos",
        "if(id < 9, '', 'text ' || id) description",
        "array(named_struct('name', 't' || (id div 3) % 5, 'config', string(id))) tests",
    )
    merged = registry.merge_columns(spark.createDataFrame([], REGISTRY_COLUMNS), proposals)
    hot = merged.where("`column` = 'hot'").first()
    assert hot.description == "text 9"
    assert [(t.name, t.config) for t in hot.tests] == [("t0", "0"), ("t1", "3"), ("t2", "6"), ("t3", "9"), ("t4", "12")]
    assert merged.count() == 20001


def test_orphans_reuse_the_partitioning_of_the_join(spark):
    models = spark.range(0, 1000, 1, 4).selectExpr(
        "string(id % 2) project_id", "string(id) node_id", "'m' || id name", "id pos", "array('model.p.m1') depends_on"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(lineage.orphans(lineage.graph_nodes(models)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2  # the models and the counted consumers
