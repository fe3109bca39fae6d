"""Schema drift between actual and declared columns, for any number of tables at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.functions.text import types_agree
from tablehealth.functions.typing import canonical_type

# Kinds of drift, in the order in which they are listed.
ADDED = "added_in_db"
REMOVED = "removed_from_db"
CHANGED = "type_changed"


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def compare(
    actual: DataFrame,
    declared: DataFrame,
    *,
    by: str | Sequence[str] = "table",
    canonical: bool = False,
) -> DataFrame:
    """Every actual and declared column with its kind of drift, null where there is none.

    ``actual`` has (by, ordinal, column, data_type), ``declared`` has (by, pos, column, data_type); ``by`` names one or
    more columns that tell tables apart, say project and table. Names match without regard to case. Repeated
    entries are combined before the shuffle. Of several declarations of a name the last counts; actual spellings that
    differ only in case are all kept, so there are no more rows than actual columns and declared names.
    """
    by = _names(by)
    key = F.lower("column").alias("name_key")
    entry = ["column", "data_type"]
    found = actual.groupBy(*by, key, *entry).agg(F.min(F.col("ordinal").cast("long")).alias("place")).select(
        *by, "name_key", F.struct("place", *entry).alias("f")
    )
    last = F.max(F.struct(F.col("pos").cast("long").alias("place"), *entry)).alias("s")
    stated = declared.groupBy(*by, key).agg(last)
    pairs = found.join(stated, [*by, "name_key"], "full_outer")
    actual_type, declared_type = F.col("f.data_type"), F.col("s.data_type")
    agree = types_agree(declared_type, actual_type)
    if canonical:
        agree = agree | (canonical_type(declared_type) == canonical_type(actual_type))
    kind = (
        F.when(F.col("s").isNull(), ADDED)
        .when(F.col("f").isNull(), REMOVED)
        .when(~agree, CHANGED)
    )
    return pairs.select(
        *by,
        F.when(F.col("s").isNull(), F.col("f.column")).otherwise(F.col("name_key")).alias(
            "column_name"
        ),
        kind.alias("drift_type"),
        actual_type.alias("db_type"),
        declared_type.alias("manifest_type"),
        F.coalesce("f.place", "s.place").alias("position"),
    )


def detect(
    actual: DataFrame,
    declared: DataFrame,
    *,
    by: str | Sequence[str] = "table",
    canonical: bool = False,
) -> DataFrame:
    """The drifted columns only, with a message."""
    drifted = compare(actual, declared, by=by, canonical=canonical).where("drift_type is not null")
    return drifted.select("*", _rank().alias("kind_order"), _message().alias("message"))


def ordered(drift: DataFrame, by: str | Sequence[str] = "table") -> DataFrame:
    """Added columns in table order, then removed in declared order, then changed in table order."""
    return drift.orderBy(*_names(by), "kind_order", "position", "column_name")


def summarize(comparison: DataFrame, by: str | Sequence[str] = "table") -> DataFrame:
    """Counts per table from :func:`compare`; clean tables are in it, as they have rows there."""
    kind = F.col("drift_type")
    return comparison.groupBy(*_names(by)).agg(
        F.count(kind).alias("total_drifts"),
        (F.count(kind) == 0).alias("is_clean"),
        *[
            F.count(F.when(kind == value, 1)).alias(label)
            for value, label in ((ADDED, "added"), (REMOVED, "removed"), (CHANGED, "type_changes"))
        ],
    )


def _rank() -> Column:
    kind = F.col("drift_type")
    return F.when(kind == ADDED, 1).when(kind == REMOVED, 2).otherwise(3)


def _message() -> Column:
    kind, name = F.col("drift_type"), F.col("column_name")
    return (
        F.when(kind == ADDED, F.concat(F.lit("Column '"), name, F.lit("' is not declared")))
        .when(kind == REMOVED, F.concat(F.lit("Column '"), name, F.lit("' is not in the table")))
        .otherwise(
            F.concat(
                F.lit("Type of '"), name, F.lit("': table has "), "db_type",
                F.lit(", declared as "), "manifest_type",
            )
        )
    )
