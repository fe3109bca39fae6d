import json

import pytest
from pyspark.sql import functions as F

from tablehealth import Workspace
from tablehealth.operators import audit, registry
from tablehealth.schemas import REGISTRY_COLUMNS
from tablehealth.sources import manifest
from tests.manifests import sample


@pytest.fixture(scope="module")
def workspace(spark, readings):
    data = sample()
    own = data["nodes"]["model.sky.dim_nights"]
    own["name"] = own["alias"] = "readings"
    own["columns"] = {"sensor_id": {}, "gone": {"data_type": "int"}, "state": {"data_type": "int"}}
    data["nodes"]["model.sky.Scratch-Pad"]["schema"] = None
    other = {"nodes": {"model.sea.rpt_monthly": data["nodes"]["model.sky.rpt_monthly.v2"]}}
    texts = [("sky", json.dumps(data)), ("sea", json.dumps(other))]
    manifests = manifest.parse_manifests(
        spark.createDataFrame(texts, "p string, j string"), F.col("j"), F.col("p")
    ).cache()

    def open_table(schema, table):
        if (schema, table) == ("serving", "readings"):
            return readings
        return spark.table(f"{schema}.{table}")

    return Workspace(spark, manifests, open_table)


def test_listing_and_details(workspace):
    assert {r.name for r in workspace.list_models().where("project_id = 'sky'").collect()} >= {"Scratch-Pad", "readings"}
    row = workspace.get_model_details("stg_frames").first()
    assert row.sql_preview == row.raw_sql and len(row.columns) == 3
    assert [c.name for c in row.column_details] == [c.name for c in row.columns] and not row.sql_is_cut
    assert [c.has_description for c in row.column_details] == [bool(c.description.strip()) for c in row.columns]
    long = workspace.models.limit(1).withColumn("raw_sql", F.repeat(F.lit("x"), 2001))
    assert audit.details(long).first().sql_is_cut and len(audit.details(long).first().sql_preview) == 2000
    assert audit.model_path(workspace.models, "stg_frames").first()[1] == "sky/landing/stg_frames.sql"
    assert audit.node_id(workspace.models, "stg_frames").first()[1] == "model.sky.stg_frames"
    assert workspace.get_model_details("nope").count() == 0


def test_audits_and_health(workspace):
    totals = {r.project_id: r.total_models for r in workspace.audit_project().collect()}
    assert totals == {"sky": 7, "sea": 1}
    assert workspace.check_test_coverage().count() == 8
    assert {r.project_id: r.max_chain_depth for r in workspace.analyze_dag().collect()} == {"sky": 4, "sea": 1}
    rows = {r.project_id: (r.total_models, r.orphan_models) for r in workspace.get_project_health().collect()}
    assert rows["sky"] == (7, 3)
    assert workspace.recommended_actions().count() >= 3
    assert workspace.worst_models().where("project_id = 'sky'").count() == 7
    assert [r.model for r in workspace.naming_violations().collect()] == ["Scratch-Pad"]
    assert {r.name for r in workspace.orphans("node_id").where("project_id = 'sky'").collect()} >= {"Scratch-Pad"}
    assert {r.name for r in workspace.roots().where("project_id = 'sky'").collect()} == {
        "stg_frames", "stg_targets", "Scratch-Pad"
    }
    assert workspace.hubs().count() == 0


def test_profiles_drift_and_suggestions(workspace, spark):
    rows = {r["column"]: r for r in workspace.profile_model("readings").collect()}
    assert len(rows) == 4 and len(rows["state"].sample_values) == 3
    assert workspace.sample_rows("readings", 2).count() == 2
    drift = workspace.detect_schema_drift("readings").collect()
    assert [(r.column_name, r.drift_type) for r in drift] == [
        ("station_id", "added_in_db"), ("level", "added_in_db"), ("gone", "removed_from_db"), ("state", "type_changed")
    ]
    actual = spark.createDataFrame(
        [("sky", "readings", 1, "sensor_id", "int"), ("sea", "rpt_monthly", 1, "total", "int"), ("sea", "rpt_monthly", 2, "x", "int")],
        "project_id string, table string, ordinal int, column string, data_type string",
    )
    found = {(r.project_id, r.table, r.column_name) for r in workspace.detect_all_drift(actual).collect()}
    assert ("sea", "rpt_monthly", "x") in found and ("sky", "rpt_monthly", "total") in found
    assert ("sea", "rpt_monthly", "total") not in found
    assert workspace.suggest_tests("readings").count() == 6
    assert workspace.suggest_tests("readings", values="sample").count() == 6
    assert workspace.suggestion_note("readings").count() == 0
    for unknown in ("nope", "Scratch-Pad", "rpt_monthly"):  # none, without a schema, in two projects
        with pytest.raises(ValueError):
            workspace.profile_model(unknown)
    assert workspace.profile_all(["readings"]).count() == 4


def test_docs_flow(workspace, spark):
    proposals = workspace.generate_model_docs("readings")
    empty = spark.createDataFrame([], REGISTRY_COLUMNS)
    merged = workspace.update_docs(empty, proposals)
    rows = registry.documented_columns(merged, "readings", "sky").collect()
    assert [r["column"] for r in rows] == ["sensor_id", "station_id", "state", "level"]
    assert [t.name for t in rows[2].tests] == ["not_null", "accepted_values"]
    assert workspace.generate_model_docs("stg_frames").count() == 0  # its table does not exist
    with pytest.raises(ValueError):
        workspace.generate_model_docs("nope")


def test_previews_keep_all_columns(workspace, spark):
    rows = workspace.preview_docs("readings", project_id="sky").orderBy("ordinal").collect()
    assert [r["column"] for r in rows] == ["sensor_id", "station_id", "state", "level"]
    assert {r.project_id for r in rows} == {"sky"} and rows[0].total_rows == 12
    assert [t.test_name for t in rows[2].tests] == ["not_null", "accepted_values"]
    row = workspace.preview_docs("stg_frames").first()  # its table does not exist
    assert row["column"] is None and row.model == "stg_frames"


def test_a_name_in_two_projects(workspace, spark, readings):
    def open_table(schema, table):
        return readings if table != "readings" else readings.select(F.raise_error(F.lit("lost")).alias("x"))

    two = Workspace(spark, workspace.manifests, open_table)
    with pytest.raises(ValueError):
        two.generate_model_docs("rpt_monthly")
    rows = two.generate_model_docs("rpt_monthly", project_id="sea").collect()
    assert {r.project_id for r in rows} == {"sea"} and len(rows) == 4
    assert two.profile_all(["rpt_monthly"], project_id="sky").count() == 4
    assert two.generate_model_docs("readings").count() == 0  # its table opens, but cannot be read


def test_models_are_parsed_once(workspace):
    plan = workspace.recommended_actions()._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_sql" not in plan and "get_json_object(entry" not in plan


def test_sql(workspace):
    assert workspace.execute_query("select 1 as one").first().one == 1
