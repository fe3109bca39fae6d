"""Documentation registry: merge proposals without losing what is there, read it, save it.

``columns`` has (project_id, model, column, pos, description, tests), ``models`` has
(project_id, model, description, tests). Proposals have the same shape; the ``pos`` of a proposed
column is its 1-based place in the proposal. A registry holds one row per key; proposals may
repeat a key, the earlier one (by ``pos``) then goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN_KEY = ["project_id", "model", "column"]
MODEL_KEY = ["project_id", "model"]


def merge_columns(registry: DataFrame, proposals: DataFrame) -> DataFrame:
    """Registry with the proposed columns merged in; nothing is removed.

    An existing description stays, an empty one is filled. Tests are added when no existing test
    has the name. New columns follow the existing ones of their model: ``pos`` orders them, with
    gaps where a proposal named columns that existed.
    """
    offered = _combine(proposals.where(_filled(F.col("column"))))
    old = registry.select(
        *COLUMN_KEY,
        F.col("pos").alias("old_pos"),
        F.col("description").alias("old_description"),
        _list(F.col("tests")).alias("old_tests"),
    )
    # One row per model. Where one model dominates the proposals, adaptive execution splits its
    # rows in this left join; a ranking per model would pass them through one task.
    last = registry.groupBy(*MODEL_KEY).agg(F.max("pos").alias("last_pos"))
    offered = offered.join(last, MODEL_KEY, "left")
    merged = old.join(offered, COLUMN_KEY, "full_outer")
    added = F.filter(
        _list(F.col("new_tests")),
        lambda t: ~F.exists(_list(F.col("old_tests")), lambda o: o["name"] == t["name"]),
    )
    return merged.select(
        *COLUMN_KEY,
        F.coalesce("old_pos", F.coalesce("last_pos", F.lit(0)) + F.col("new_pos")).alias("pos"),
        F.coalesce(_nonempty("old_description"), _nonempty("new_description"), F.lit("")).alias(
            "description"
        ),
        F.concat(_list(F.col("old_tests")), added).alias("tests"),
    )


def merge_models(registry: DataFrame, proposals: DataFrame) -> DataFrame:
    """Registry of models with proposed descriptions: a non-empty one replaces the old."""
    latest = proposals.groupBy(*MODEL_KEY).agg(
        F.max_by(
            "description", F.when(_filled(F.col("description")), F.col("pos"))
        ).alias("new_description")
    )
    return registry.join(latest, MODEL_KEY, "full_outer").select(
        *MODEL_KEY,
        F.coalesce(_nonempty("new_description"), "description", F.lit("")).alias("description"),
        _list(F.col("tests")).alias("tests"),
    )


def from_suggestions(test_entries: DataFrame, project_id: str, model: str) -> DataFrame:
    """Proposals from suggested tests (see ``suggest.as_test_entries``)."""
    return test_entries.select(
        F.lit(project_id).alias("project_id"),
        F.lit(model).alias("model"),
        "column",
        F.col("ordinal").cast("bigint").alias("pos"),
        F.lit("").alias("description"),
        "tests",
    )


def documented_columns(registry: DataFrame, model: str, project_id: str | None = None) -> DataFrame:
    """Columns of one model with description and tests, in order."""
    chosen = registry.where((F.col("model") == model) & _filled(F.col("column")))
    if project_id is not None:
        chosen = chosen.where(F.col("project_id") == project_id)
    return chosen.orderBy("project_id", "pos").select(
        "project_id", "column", "pos", "description", "tests"
    )


def model_tests(models: DataFrame, model: str, project_id: str | None = None) -> DataFrame:
    """Tests defined on a model itself."""
    chosen = models.where(F.col("model") == model)
    if project_id is not None:
        chosen = chosen.where(F.col("project_id") == project_id)
    return chosen.select("project_id", F.inline("tests"))


def save(registry: DataFrame, path: str) -> None:
    """Write a registry to a new folder. It fails if the folder exists: a merge reads the old
    version while the new one is written, so the two must not be the same."""
    registry.write.mode("errorifexists").parquet(path)


def _combine(proposals: DataFrame) -> DataFrame:
    """One row per proposed column: first non-empty description, tests of each name from the first
    proposal that has the name, with the repeats that proposal has.

    Both groupings combine before the shuffle and hold one entry per test name, so a column that
    is proposed very often stays small.
    """
    place = F.coalesce("pos", F.lit(0)).cast("bigint")
    about = proposals.groupBy(*COLUMN_KEY).agg(
        F.min(place).alias("new_pos"),
        F.min_by(
            "description", F.when(_filled(F.col("description")), place)
        ).alias("new_description"),
    )
    numbered = F.transform(
        _list(F.col("tests")),
        lambda t, i: F.struct(i.alias("i"), t["name"].alias("name"), t["config"].alias("config")),
    )
    names = F.array_distinct(F.transform("numbered", lambda t: t["name"]))
    by_name = proposals.select(*COLUMN_KEY, place.alias("pos"), numbered.alias("numbered")).select(
        *COLUMN_KEY, "pos", "numbered", F.explode(names).alias("name")
    )
    first = by_name.groupBy(*COLUMN_KEY, "name").agg(
        F.min(
            F.struct(
                "pos", F.filter("numbered", lambda t: t["name"] == F.col("name")).alias("entries")
            )
        ).alias("first")
    )
    flat = F.flatten(
        F.collect_list(
            F.transform(
                "first.entries",
                lambda t: F.struct(
                    F.col("first.pos").alias("pos"),
                    t["i"].alias("i"),
                    t["name"].alias("name"),
                    t["config"].alias("config"),
                ),
            )
        )
    )
    tests = first.groupBy(*COLUMN_KEY).agg(F.array_sort(flat).alias("ordered"))
    return about.join(tests, COLUMN_KEY, "left").select(
        *COLUMN_KEY,
        "new_pos",
        "new_description",
        F.transform(
            "ordered", lambda t: F.struct(t["name"].alias("name"), t["config"].alias("config"))
        ).alias("new_tests"),
    )


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _nonempty(name: str) -> Column:
    return F.when(_filled(F.col(name)), F.col(name))


def _list(tests: Column) -> Column:
    return F.coalesce(tests, F.array().cast("array<struct<name:string,config:string>>"))
