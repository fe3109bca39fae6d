import os

from tablehealth.operators import registry
from tablehealth.operators.versions import Versions
from tablehealth.schemas import REGISTRY_COLUMNS


def rows(spark, *given):
    return spark.createDataFrame([(p, "m", c, n, d, []) for n, (p, c, d) in enumerate(given, 1)], REGISTRY_COLUMNS)


def flat(df):
    return sorted((str(r.project_id), r["column"], r.pos, r.description) for r in df.collect())


def test_a_merge_writes_the_touched_projects_alone(spark, tmp_path):
    path = str(tmp_path / "r")
    store = Versions(spark, path)
    assert store.last() == -1 and store.read().count() == 0
    first = rows(spark, *((f"p{i}", "a", "") for i in range(100)))
    assert store.merge(first) == 0
    new = rows(spark, ("p7", "a", "filled"), ("p7", "b", "new"), ("fresh/x=1", "c", "other"))
    assert store.merge(new) == 1
    folders = [x for x in os.listdir(f"{path}/data/version=1") if x.startswith("project=")]
    assert len(folders) == 2
    assert flat(store.read()) == flat(registry.merge_columns(store.read(0), new))
    assert store.read().count() == 102 and flat(store.read(0)) == flat(first)


def test_only_folders_of_touched_projects_are_opened(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "r"))
    store.merge(rows(spark, *((f"p{i}", "a", "") for i in range(50))))
    one = store._rows(0, store._pointers(0).where("project = 'p-p7'"))
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "project = p-p7" in plan.lower()


def test_a_lost_merge_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    store = Versions(spark, path)
    store.merge(rows(spark, ("p", "a", "kept")))
    rows(spark, ("p", "a", "lost")).selectExpr("*", "'p-p' as project").write.partitionBy("project").parquet(f"{path}/data/version=1")
    assert flat(store.read()) == [("p", "a", 1, "kept")]
    assert store.merge(rows(spark, ("p", "b", "again"))) == 1
    assert flat(store.read()) == [("p", "a", 1, "kept"), ("p", "b", 2, "again")]


def test_null_and_empty_projects(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "r"))
    store.merge(rows(spark, (None, "a", "x"), ("", "a", "y"), ("p", "a", "z")))
    assert len(flat(store.read())) == 3
    assert store.merge(rows(spark, ("", "b", "w"))) == 1
    assert store.merge(rows(spark).limit(0)) == 2
    assert len(flat(store.read())) == 4
