"""Guarded read-only SQL.

The guard keeps mistakes out; it is not a security boundary. Catalog permissions are.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# Allowed first words, those of them that may hold anything else, functions with side effects.
READ_WORDS = ("select", "with", "explain", "describe", "show", "values")
PLANNED = ("select", "with", "values")
SIDE_EFFECTS = ("reflect", "try_reflect", "java_method")

_FIELDS = "spark.sql.debug.maxToStringFields"
_PLAN = "== Physical Plan =="
_WRITE_NODE = re.compile(
    r"^[\s:+\-!'*()\d]*(?:Execute\s+\w+Command|InsertInto\w+|MergeInto\w+|UpdateTable|DeleteFromTable"
    r"|AppendData|Overwrite\w+|ReplaceData|WriteDelta)\b",
    re.MULTILINE,
)
_SCRIPT_NODE = re.compile(r"^[\s:+\-!'*()\d]*(?:Hive)?ScriptTransformation\b", re.MULTILINE)
_SIDE_EFFECT = re.compile(rf"\b(?:{'|'.join(SIDE_EFFECTS)})\(", re.IGNORECASE)


def check_read_only(spark: SparkSession, sql: str, args: dict[str, Any] | list[Any] | None = None) -> None:
    """Raise ``ValueError`` unless ``sql`` only reads.

    The first word decides what may run at all, and Spark's own plan of it what else is refused: writes behind WITH,
    functions that call Java, scripts. A text that reads like such a call, ``'reflect(1)'`` say, is refused as well.
    """
    words = sql.split(None, 1)
    first = words[0].lower() if words else ""
    if first not in READ_WORDS:
        raise ValueError(f"This statement may change data, as it does not begin with a word for reading: {first!r}")
    if first not in PLANNED:
        return
    plan = _explained(spark, sql, args)
    if first == "with" and _PLAN not in plan:  # a command runs as soon as spark.sql sees it, EXPLAIN only plans it
        raise ValueError(f"The query cannot be planned: {plan}")
    if _WRITE_NODE.search(plan):
        raise ValueError("The statement after WITH writes data")
    found = _SIDE_EFFECT.search(plan) or _SCRIPT_NODE.search(plan)
    if found:
        raise ValueError(f"Not allowed in a query that only reads: {found.group().strip()!r}")


def _explained(spark: SparkSession, sql: str, args: dict[str, Any] | list[Any] | None) -> str:
    """All plans of ``sql``, with every column written out."""
    before = spark.conf.get(_FIELDS)
    spark.conf.set(_FIELDS, str(2**31 - 1))
    try:
        text = "EXPLAIN EXTENDED " + sql
        return (spark.sql(text, args=args) if args else spark.sql(text)).first()[0]
    except ParseException as error:
        raise ValueError(f"This is no SQL: {error}") from error
    finally:
        spark.conf.set(_FIELDS, before)


def execute_query(
    spark: SparkSession,
    sql: str,
    args: dict[str, Any] | list[Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Run one read-only statement; ``limit`` keeps that many rows, without it all are returned."""
    check_read_only(spark, sql, args)
    result = spark.sql(sql, args=args) if args else spark.sql(sql)
    return result if limit is None else result.limit(limit)
