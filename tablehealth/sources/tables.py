"""Table sources and catalog lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablehealth.functions.text import validate_identifier
from tablehealth.schemas import TABLE_COLUMNS


def read_table(spark: SparkSession, table: str, schema: str | None = None, format: str = "parquet"):
    """A catalog table, or files when ``table`` is a path."""
    if "/" in table:
        return spark.read.format(format).load(table)
    names = [validate_identifier(part) for part in ([schema] if schema else []) + table.split(".")]
    return spark.table(".".join(names))


def read_jdbc(
    spark: SparkSession,
    url: str,
    schema: str,
    table: str,
    *,
    column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table, read by range partitions of ``column``.

    A partitioned read is required: without one the whole table would pass through one task.
    ``lower`` and ``upper`` only place the partition borders, no row is left out. Column pruning
    and filters reach the database. Needs the database's JDBC driver on the class path.
    """
    for name in (schema, table, column):
        validate_identifier(name)
    if partitions < 2:
        raise ValueError("partitions must be at least 2")
    return spark.read.jdbc(
        url,
        f"{schema}.{table}",
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=dict(properties or {}),
    )


def table_exists(spark: SparkSession, schema: str, table: str) -> bool:
    validate_identifier(schema)
    validate_identifier(table)
    return spark.catalog.tableExists(f"{schema}.{table}")


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (table, column) in ordinal order, from the schemas alone: no job runs."""
    rows = [
        (table, ordinal, field.name, field.dataType.simpleString(), field.nullable)
        for table, df in tables.items()
        for ordinal, field in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, TABLE_COLUMNS)
