"""Catalog manifests as DataFrames: many projects at once, keyed by ``project_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.functions.text import is_present
from tablehealth.schemas import CORRUPT, MANIFEST, MANIFEST_EXPOSURE, MANIFEST_NODE, MANIFEST_SOURCE


def read_manifests(
    spark: SparkSession, paths: str | list[str], project_id: Column | None = None
) -> DataFrame:
    """Manifest JSON files, one row per file; the file path is the default project key.

    A file that does not parse stays in the result and shows up in :func:`manifest_errors`.
    """
    raw = (
        spark.read.schema(MANIFEST)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
    )
    key = F.col("_metadata.file_path") if project_id is None else project_id
    return raw.select(key.alias("project_id"), *MANIFEST.names)


def parse_manifests(df: DataFrame, text: Column, project_id: Column) -> DataFrame:
    """The same table from manifests held as text in a column.

    Parsing costs far more than moving the text, so rows are dealt over all tasks first, however few files they came from.
    Each column parses what it holds and skips the rest.
    """
    raw = df.select(project_id.alias("project_id"), text.alias("text")).repartition(F.xxhash64("text"))

    def part(name: str) -> Column:
        return F.from_json("text", T.StructType([MANIFEST[name]]))[name].alias(name)

    whole = F.from_json("text", MANIFEST, {"columnNameOfCorruptRecord": CORRUPT})[CORRUPT]
    return raw.select("project_id", *(part(n) for n in MANIFEST.names if n != CORRUPT), whole.alias(CORRUPT))


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """Manifests that did not parse, with their text and whether any nodes could be read."""
    return manifests.where(F.col(CORRUPT).isNotNull()).select(
        "project_id", CORRUPT, F.col("nodes").isNotNull().alias("has_nodes")
    )


def assets(manifests: DataFrame, spread: bool = False) -> DataFrame:
    """Models of all projects with their details; ``pos`` is the order in the file.

    ``spread`` deals the models over all tasks before they are parsed, for manifests of very many models.
    """
    is_model = F.get_json_object("entry", "$.resource_type") == "model"
    nodes = _entries(manifests, "nodes", "node_id", "node", MANIFEST_NODE, is_model, spread)
    empty_map = F.col("node.columns").isNull()
    columns = F.when(empty_map, F.array()).otherwise(
        F.transform(
            F.map_entries("node.columns"),
            lambda entry, i: F.struct(
                i.alias("pos"),
                entry["key"].alias("name"),
                F.coalesce(entry["value"]["description"], F.lit("")).alias("description"),
                entry["value"]["data_type"].alias("data_type"),
                F.coalesce(entry["value"]["tests"], F.array().cast("array<string>")).alias("tests"),
            ),
        )
    )
    config = F.coalesce(F.col("node.config"), F.lit("{}"))
    return nodes.select(
        "project_id",
        "pos",
        "node_id",
        F.col("node.name").alias("name"),
        F.coalesce("node.alias", "node.name").alias("alias"),
        F.coalesce("node.description", F.lit("")).alias("description"),
        F.col("node.original_file_path").alias("original_file_path"),
        F.col("node.database").alias("database"),
        F.col("node.schema").alias("schema"),
        F.coalesce(F.get_json_object(config, "$.materialized"), F.lit("view")).alias(
            "materialized"
        ),
        F.coalesce("node.raw_code", "node.raw_sql", F.lit("")).alias("raw_sql"),
        F.coalesce("node.compiled_code", "node.compiled_sql", F.lit("")).alias("compiled_sql"),
        columns.alias("columns"),
        F.coalesce("node.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"),
        F.coalesce("node.tags", F.array().cast("array<string>")).alias("tags"),
        config.alias("config"),
    )


def with_summary(models: DataFrame) -> DataFrame:
    """Add ``has_description``, ``column_count`` and ``documented_column_count``; no shuffle."""
    return models.select(
        "*",
        is_present(F.col("description")).alias("has_description"),
        F.size("columns").alias("column_count"),
        F.size(F.filter("columns", lambda c: is_present(c["description"]))).alias(
            "documented_column_count"
        ),
    )


def asset_columns(models: DataFrame) -> DataFrame:
    """One row per declared column."""
    column = F.explode("columns").alias("c")
    return models.select("project_id", "node_id", F.col("name").alias("model"), column).select(
        "project_id",
        "node_id",
        "model",
        F.col("c.pos").alias("pos"),
        F.col("c.name").alias("column"),
        F.col("c.description").alias("description"),
        F.col("c.data_type").alias("data_type"),
        F.col("c.tests").alias("tests"),
    )


def dependencies(models: DataFrame) -> DataFrame:
    """One row per dependency; a model without any keeps one row with nulls."""
    return models.select(
        "project_id",
        "node_id",
        "name",
        F.posexplode_outer("depends_on").alias("dep_pos", "dep_id"),
    )


def sources(manifests: DataFrame) -> DataFrame:
    return _entries(manifests, "sources", "source_id", "s", MANIFEST_SOURCE).select(
        "project_id",
        "pos",
        "source_id",
        F.col("s.name").alias("name"),
        F.col("s.source_name").alias("source_name"),
        F.coalesce("s.identifier", "s.name").alias("identifier"),
        F.col("s.database").alias("database"),
        F.col("s.schema").alias("schema"),
        F.coalesce("s.description", F.lit("")).alias("description"),
        F.col("s.loaded_at_field").alias("loaded_at_field"),
    )


def exposures(manifests: DataFrame) -> DataFrame:
    return _entries(manifests, "exposures", "exposure_id", "x", MANIFEST_EXPOSURE).select(
        "project_id",
        "pos",
        "exposure_id",
        F.col("x.name").alias("name"),
        F.col("x.type").alias("type"),
        F.coalesce("x.description", F.lit("")).alias("description"),
        F.coalesce("x.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"),
    )


def _entries(
    manifests: DataFrame, field: str, key: str, value: str, schema: T.StructType, only: Column | None = None,
    spread: bool = False,
) -> DataFrame:
    """The entries of an id-keyed object in file order, each parsed as a row of its own.

    The outer form is used because for the inner one Spark infers a filter on the exploded map,
    and that would parse the text of a manifest a second and third time.
    """
    rows = manifests.select("project_id", F.posexplode_outer(field).alias("pos", key, "entry"))
    rows = rows.where(F.col(key).isNotNull() if only is None else F.col(key).isNotNull() & only)
    if spread:
        rows = rows.repartition("project_id", key)
    return rows.select("project_id", "pos", key, F.from_json("entry", schema).alias(value))
