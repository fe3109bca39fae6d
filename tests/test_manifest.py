import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tablehealth.functions import text
from tablehealth.operators import audit, lineage
from tablehealth.plans import health
from tablehealth.sources import manifest
from tests.manifests import column, model, sample


@pytest.fixture(scope="module")
def manifests(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("manifests")
    (folder / "sky.json").write_text(json.dumps(sample(), indent=2))
    return manifest.read_manifests(spark, str(folder), F.lit("sky")).cache()


def test_models(manifests):
    models = {r.name: r for r in manifest.with_summary(manifest.assets(manifests)).collect()}
    assert [m.name for m in sorted(models.values(), key=lambda m: m.pos)] == [
        "stg_frames", "stg_targets", "int_matches", "fct_brightness", "dim_nights", "rpt_monthly", "Scratch-Pad"
    ]
    frames = models["stg_frames"]
    assert (frames.schema, frames.materialized, frames.has_description) == ("landing", "incremental", True)
    assert (frames.column_count, frames.documented_column_count) == (3, 2)
    assert frames.raw_sql == "-- stg_frames\nselect 1" and frames.compiled_sql == ""
    assert models["rpt_monthly"].node_id == "model.sky.rpt_monthly.v2"
    assert frames.original_file_path == "sky/landing/stg_frames.sql"


def test_columns_sources_dependencies(manifests):
    models = manifest.assets(manifests)
    cols = manifest.asset_columns(models).where("model = 'dim_nights'").orderBy("pos").collect()
    assert [c["column"] for c in cols] == ["night", "moon"]
    assert cols[0].tests == ["unique", "not_null"]
    assert {(s.name, s.identifier, s.loaded_at_field) for s in manifest.sources(manifests).collect()} == {
        ("camera", "camera_log", None), ("catalogue", "catalogue", "seen")
    }
    deps = manifest.dependencies(models).where("name = 'Scratch-Pad'").collect()
    assert [d.dep_id for d in deps] == [None]
    assert manifest.exposures(manifests).first().depends_on == ["model.sky.rpt_monthly.v2"]


def test_lookup_and_upstream(manifests):
    models = manifest.assets(manifests)
    assert [r.dep_id for r in audit.upstream(models, "fct_brightness").orderBy("dep_pos").collect()] == [
        "model.sky.int_matches", "model.sky.stg_targets"
    ]
    assert audit.upstream(models, "nope").count() == 0
    assert audit.find_model(models, "nope").count() == 0
    assert audit.find_model(models, "rpt_monthly").first().node_id == "model.sky.rpt_monthly.v2"


def test_first_of_equal_names_wins(spark):
    nodes = {"model.b.same": model("same", "s", "view", "first"), "model.a.same": model("same", "s", "view", "second")}
    df = spark.createDataFrame([(json.dumps({"nodes": nodes}),)], "j string")
    models = manifest.assets(manifest.parse_manifests(df, F.col("j"), F.lit("p")))
    assert audit.find_model(models, "same").first().description == "first"
    assert audit.first_by_name(models).count() == 1


def test_missing_fields_fall_back(spark):
    nodes = {
        "model.p.m": {"name": "m", "resource_type": "model", "description": None, "raw_sql": "select 1",
                      "columns": {"c": {"description": None}}},
        "seed.p.s": {"name": "s", "resource_type": "seed"},
    }
    df = spark.createDataFrame([(json.dumps({"nodes": nodes}),)], "j string")
    models = manifest.with_summary(manifest.assets(manifest.parse_manifests(df, F.col("j"), F.lit("p"))))
    row = models.first()
    assert models.count() == 1
    assert (row.alias, row.materialized, row.description, row.raw_sql) == ("m", "view", "", "select 1")
    assert (row.has_description, row.column_count, row.documented_column_count) == (False, 1, 0)
    assert row.depends_on == [] and row.tags == [] and row.columns[0].tests == []


def test_broken_files_surface(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(sample()))
    (tmp_path / "bad.json").write_text('{"nodes": {"model.x": ')
    found = manifest.read_manifests(spark, str(tmp_path))
    bad = manifest.manifest_errors(found).collect()
    assert len(bad) == 1 and bad[0].project_id.endswith("bad.json")
    assert manifest.assets(found).count() == 7


def test_sample_audit(manifests):
    models = audit.audit_models(manifest.assets(manifests))
    row = audit.audit_projects(models).first()
    assert (row.total_models, row.models_with_description, row.models_with_any_test) == (7, 3, 4)
    assert (row.total_columns, row.documented_columns, row.tested_columns) == (12, 5, 4)
    assert (row.model_doc_score, row.column_doc_score, row.test_score, row.naming_score, row.overall_score) == (
        42.9, 41.7, 57.1, 85.7, 51.8
    )
    worst = [r.name for r in audit.worst_models(models).orderBy("rank").collect()]
    assert set(worst[:2]) == {"rpt_monthly", "Scratch-Pad"} and worst[-1] == "dim_nights"
    assert [r.model for r in audit.naming_violations(models).collect()] == ["Scratch-Pad"]
    bands = {r.name: (r.test_pct, r.doc_pct, r.band) for r in audit.coverage_bands(models).collect()}
    assert bands["stg_frames"] == (33, 67, "yellow") and bands["rpt_monthly"] == (0, 0, "red")
    assert bands["dim_nights"] == (50, 100, "yellow")
    assert audit.coverage_bands(models, sort=True).collect()[-1].name == "dim_nights"
    assert {r.name: r.layer for r in models.collect()} == {
        "stg_frames": "staging", "stg_targets": "staging", "int_matches": "intermediate", "Scratch-Pad": "other",
        "fct_brightness": "marts_fact", "dim_nights": "marts_dim", "rpt_monthly": "other",
    }
    listed = audit.list_models(manifest.assets(manifests)).collect()
    assert [r.name for r in listed] == sorted(r.name for r in listed)
    assert {r.name: r.columns_documented for r in listed}["int_matches"] == "no cols"


def test_model_audit_is_narrow_and_matches_the_row_form(manifests):
    models = manifest.assets(manifests)
    nested = audit.audit_models(models)
    assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
    rows = audit.audit_items(models, manifest.asset_columns(models))
    assert sorted(map(str, nested.select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_sample_graph_and_health(manifests):
    models, exposures = manifest.assets(manifests), manifest.exposures(manifests)
    nodes = lineage.graph_nodes(models, exposures)
    # By name the exposure misses the report, as its id ends in a version; by id it does not.
    assert {r.name for r in lineage.orphans(nodes).collect()} == {"rpt_monthly", "Scratch-Pad"}
    by_id = lineage.graph_nodes(models, exposures, "node_id")
    assert {r.name for r in lineage.orphans(by_id).collect()} == {"Scratch-Pad"}
    assert {r.name for r in lineage.roots(models).collect()} == {"stg_frames", "stg_targets", "Scratch-Pad"}
    summary = lineage.summarize(nodes, lineage.node_depths(models))
    row = summary.first()
    assert (row.total_models, row.orphan_models, row.root_models, row.high_fan_out_models) == (7, 2, 3, 0)
    assert (row.max_chain_depth, row.is_deep, row.has_cycle) == (4, False, False)
    audited = audit.audit_models(models)
    board = health.dashboard(audit.audit_projects(audited), summary)
    actions = health.dashboard_actions(board, audited).orderBy("priority").collect()
    assert [r.priority for r in actions] == list(range(1, len(actions) + 1))
    assert any("2 orphan models" in r.action for r in actions)
    assert health.report_actions(audit.audit_projects(audited)).count() > 0


AUDIT = "project_id string, pos int, node_id string, name string, description string, columns array<struct<name:string,description:string,tests:array<string>>>"


def audited(spark, *models):
    rows = [("p", i, name, name, text, columns) for i, (name, text, columns) in enumerate(models)]
    return audit.audit_models(spark.createDataFrame(rows, AUDIT))


def test_audit_cases(spark):
    full = audited(spark, ("domes", "Domes", [("dome", "Which", ["unique"]), ("width", "Metres", ["not_null"])]))
    row = audit.audit_projects(full).first()
    assert (row.model_doc_score, row.column_doc_score, row.test_score, row.overall_score) == (100, 100, 100, 100)
    zero = audited(spark, ("a", "", [("c", "", [])]), ("b", None, [("c", None, None)]))
    row = audit.audit_projects(zero).first()
    assert (row.model_doc_score, row.column_doc_score, row.test_score, row.overall_score) == (0, 0, 0, 10)
    names = audited(spark, ("Dome3", "", []), ("dome_3", "", []), ("dome three", "", []))
    assert audit.naming_violations(names).count() == 2
    part = audited(spark, ("m", "", [("a", "A", ["unique"]), ("b", " \t ", []), ("c", "", ['{"x": {}}'][:0])]))
    row = audit.audit_projects(part).first()
    assert (row.column_doc_score, row.test_score) == (33.3, 100)
    worst = audited(spark, ("good", "G", [("a", "A", ["unique"])]), ("bare", "", [("a", "", [])]))
    assert audit.worst_models(worst).orderBy("rank").first().name == "bare"


def test_audit_without_models_or_columns(spark):
    row = audit.audit_projects(audited(spark).where("false"), by=()).first()
    assert (row.total_models, row.overall_score, row.naming_score) == (0, 100.0, 100.0)
    rows = {r.name: r for r in audited(spark, ("d", "Text", []), ("e", "  ", None)).collect()}
    assert (rows["d"].doc_coverage, rows["d"].test_coverage, rows["e"].doc_coverage) == (1.0, 0.0, 0.0)


def test_percentages_round_half_to_even(spark):
    eight = [(f"c{i}", "D" if i == 0 else "", []) for i in range(8)]
    assert audit.coverage_bands(audited(spark, ("m", "", eight))).first().doc_pct == 12


def test_scores_round_by_their_exact_value(spark):
    rng = random.Random(6)
    values = [rng.randrange(0, 20001) / 200 for _ in range(3000)] + [0.0, 100.0, 0.05, 78.55, 0.25, 99.95]
    values += [math.nextafter(v, d) for v in values[:500] for d in (0, 100)]
    values += [a * 0.25 + b * 0.3 + c * 0.35 + d * 0.1 for a, b, c, d in
               ([rng.randrange(0, 1001) / 10 for _ in range(4)] for _ in range(3000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.round_tenth(F.col("v")).alias("r"))
    assert all(r.r == round(r.v, 1) for r in rows.collect())


def test_test_entries(spark):
    df = spark.createDataFrame([("not_null",), ('{"accepted_values": {"values": [1]}}',), ("{}",)], "t string")
    rows = df.select(text.test_name(F.col("t")).alias("n"), text.test_config(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("not_null", None), ("accepted_values", '{"values":[1]}'), ("", None)]
    assert column("x")["tests"] == []


def test_identifiers():
    assert text.validate_identifier("a_1") == "a_1"
    assert not text.is_safe_identifier("a" * 129) and text.is_safe_identifier("a" * 128)
    for bad in ("1a", "a-b", "a; drop", ""):
        with pytest.raises(ValueError):
            text.validate_identifier(bad)
