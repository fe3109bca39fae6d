"""Documentation, test and naming coverage of models, projects and fleets of projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.functions.text import (
    is_model_name,
    is_present,
    layer_of,
    naming_issue,
    percent,
    round_even,
    round_tenth,
    test_name,
)

# Weights of the overall score, band limits, length of the worst list.
WEIGHTS = (
    ("model_doc_score", 0.25),
    ("column_doc_score", 0.30),
    ("test_score", 0.35),
    ("naming_score", 0.10),
)
RED_BELOW = 20
YELLOW_BELOW = 60
WORST = 10
SQL_PREVIEW = 2000  # characters of SQL shown with a model's details

_COUNTERS = ("total_columns", "documented_columns", "tested_columns")


def audit_models(models: DataFrame) -> DataFrame:
    """Counters and ratios per model, from the model rows with their nested ``columns``.

    Everything needed is in the row, so this is a narrow projection.
    """
    columns = F.coalesce("columns", F.array())
    return _rate(
        models.select(
            *_model_fields(),
            F.size(columns).alias("total_columns"),
            F.size(F.filter(columns, lambda c: is_present(c["description"]))).alias(
                "documented_columns"
            ),
            F.size(F.filter(columns, lambda c: F.size(c["tests"]) > 0)).alias("tested_columns"),
        )
    )


def audit_items(models: DataFrame, items: DataFrame) -> DataFrame:
    """The same from columns kept as rows (project_id, node_id, description, tests).

    The items of a model are counted before they are shuffled, so a model with very many of them
    is one small row per task by then. Models without items are kept.
    """
    counts = items.groupBy("project_id", "node_id").agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(is_present(F.col("description"))).alias("documented_columns"),
        F.count_if(F.size("tests") > 0).alias("tested_columns"),
    )
    joined = models.select(*_model_fields()).join(counts, ["project_id", "node_id"], "left")
    return _rate(joined.fillna(0, list(_COUNTERS)))


def audit_projects(model_audit: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Totals and scores per project; ``by=()`` gives one row even when there are no models."""
    totals = model_audit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count_if("has_description").alias("models_with_description"),
        F.count_if(F.col("tested_columns") > 0).alias("models_with_any_test"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS],
        F.count_if(~F.col("naming_ok")).alias("naming_violations"),
    )
    models, columns = F.col("total_models"), F.col("total_columns")
    scored = totals.select(
        "*",
        percent(F.col("models_with_description"), models, 1, 100.0).alias("model_doc_score"),
        percent(F.col("documented_columns"), columns, 1, 100.0).alias("column_doc_score"),
        percent(F.col("models_with_any_test"), models, 1, 100.0).alias("test_score"),
        percent(
            F.greatest(models - F.col("naming_violations"), F.lit(0)), models, 1, 100.0
        ).alias("naming_score"),
    )
    overall = sum((F.col(score) * weight for score, weight in WEIGHTS[1:]), _first_weighted())
    return scored.withColumn("overall_score", round_tenth(overall))


def worst_models(model_audit: DataFrame, n: int = WORST) -> DataFrame:
    """The ``n`` models of each project with the least coverage, in file order where equal.

    Spark keeps the first ``n`` of each project in every task before it shuffles them.
    """
    coverage = F.col("doc_coverage") + F.col("test_coverage")
    ranked = model_audit.withColumn("coverage", coverage).withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("project_id").orderBy("coverage", "pos", "node_id")
        ),
    )
    return ranked.where(F.col("rank") <= n)


def coverage_bands(model_audit: DataFrame, sort: bool = False) -> DataFrame:
    """Coverage in whole percent with a band; in file order, or worst first with ``sort``."""
    listed = model_audit.select(
        "project_id",
        "pos",
        "node_id",
        "name",
        round_even(F.col("test_coverage") * 100).cast("int").alias("test_pct"),
        round_even(F.col("doc_coverage") * 100).cast("int").alias("doc_pct"),
        "test_coverage",
        "tested_columns",
        "total_columns",
    ).withColumn("band", _band(F.col("test_pct")))
    order = ["project_id", "test_coverage", "pos"] if sort else ["project_id", "pos"]
    return listed.orderBy(*order, "node_id").drop("test_coverage")


def naming_violations(model_audit: DataFrame) -> DataFrame:
    return model_audit.where(~F.col("naming_ok")).select(
        "project_id", F.col("name").alias("model"), F.col("naming_issue").alias("issue")
    )


def list_models(models: DataFrame) -> DataFrame:
    """Name, materialization, documentation state and column coverage, by name.

    A global sort reads its input twice, once for the limits of its ranges. What it reads is dealt out as the few columns listed,
    so that models are parsed once.
    """
    documented = F.size(F.filter("columns", lambda c: is_present(c["description"])))
    listed = models.select(
        "project_id",
        "name",
        "materialized",
        is_present(F.col("description")).alias("has_description"),
        F.when(
            F.size("columns") > 0, F.concat_ws("/", documented, F.size("columns"))
        ).otherwise("no cols").alias("columns_documented"),
        "schema",
    )
    return listed.repartition("project_id", "name").orderBy("project_id", "name")


def first_by_name(models: DataFrame) -> DataFrame:
    """Of several models with one name, the first in file order.

    The ranking is cut to one row per name within each task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("project_id", "name").orderBy("pos", "node_id"))
    return models.withColumn("rank", rank).where(F.col("rank") == 1).drop("rank")


def details(models: DataFrame) -> DataFrame:
    """Model rows with what describes them in one place; no shuffle.

    ``column_details`` tells for each declared column, in order, whether it has a description and the names of its tests;
    ``is_root`` whether the model depends on nothing; ``sql_preview`` is the start of the SQL and ``sql_is_cut`` whether there is more.
    """
    shown = F.transform(
        F.coalesce("columns", F.array()),
        lambda c: F.struct(
            c["name"].alias("name"),
            is_present(c["description"]).alias("has_description"),
            F.transform(c["tests"], test_name).alias("test_names"),
        ),
    )
    return models.select(
        "*",
        shown.alias("column_details"),
        (F.size("depends_on") == 0).alias("is_root"),
        F.substring("raw_sql", 1, SQL_PREVIEW).alias("sql_preview"),
        (F.length("raw_sql") > SQL_PREVIEW).alias("sql_is_cut"),
    )


def find_model(models: DataFrame, name: str) -> DataFrame:
    """The model of that name in each project, or no row."""
    return first_by_name(models.where(F.col("name") == name))


def model_path(models: DataFrame, name: str) -> DataFrame:
    """Path of the file that defines the model, per project."""
    return find_model(models, name).select("project_id", "original_file_path")


def node_id(models: DataFrame, name: str) -> DataFrame:
    """Full node id of the model, per project."""
    return find_model(models, name).select("project_id", "node_id")


def upstream(models: DataFrame, name: str | None = None) -> DataFrame:
    """Direct dependencies in declared order: of one model, or of every model name."""
    chosen = first_by_name(models) if name is None else find_model(models, name)
    return chosen.select(
        "project_id", "name", F.posexplode("depends_on").alias("dep_pos", "dep_id")
    )


def _model_fields() -> list[Column | str]:
    name, text = F.col("name"), F.coalesce("description", F.lit(""))
    return [
        "project_id",
        "pos",
        "node_id",
        "name",
        is_present(text).alias("has_description"),
        F.length(text).alias("description_len"),
        is_model_name(name).alias("naming_ok"),
        naming_issue(name).alias("naming_issue"),
        layer_of(name).alias("layer"),
    ]


def _rate(counted: DataFrame) -> DataFrame:
    total = F.col("total_columns")
    undeclared = F.when(F.col("has_description"), 1.0).otherwise(0.0)
    return counted.select(
        "*",
        F.when(total == 0, undeclared)
        .otherwise(F.col("documented_columns") / total)
        .alias("doc_coverage"),
        F.when(total == 0, 0.0).otherwise(F.col("tested_columns") / total).alias("test_coverage"),
    )


def _first_weighted() -> Column:
    score, weight = WEIGHTS[0]
    return F.col(score) * weight


def _band(pct: Column) -> Column:
    return F.when(pct < RED_BELOW, "red").when(pct < YELLOW_BELOW, "yellow").otherwise("green")
