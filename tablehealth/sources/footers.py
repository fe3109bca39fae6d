"""What the footers of Parquet files tell: schemas of many tables, and row counts and ranges without reading a row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.functions.typing import has_range
from tablehealth.sources.scratch import Scratch

#: Key under which Spark keeps its own schema in a footer (fixed value).
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
#: Types whose ranges Parquet keeps exactly, and which Spark takes from there. Text may be cut there, and NaN is left out.
_STORED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_COLUMNS = "ordinal int, `column` string, data_type string, nullable boolean, error string"


def columns(tables: DataFrame) -> DataFrame:
    """A row per column of each table: the columns of ``tables``, ``ordinal``, ``column``, ``data_type``, ``nullable``, ``error``.

    ``tables`` has a ``path`` per table, a file or a folder, and whatever names the table. Tasks open the footer of the first file
    by name, so the driver sees no schema, and 100,000 tables cost as many footers, spread over all cores. Paths are opened through
    the file systems of pyarrow. Folders below the path named ``key=value`` give columns at the end, without a type, as files
    do not state it. A table that cannot be read, or a null path, gives one row with an ``error`` and no column; an empty folder
    is one of these. Columns of ``tables`` called like the new ones are replaced.
    """
    new = T._parse_datatype_string(_COLUMNS)
    keys = [f for f in tables.schema.fields if f.name.lower() not in new.fieldNames()]
    names = [f.name for f in keys]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for table in batch.itertuples(index=False, name=None):
                rows += [(*table, *found) for found in _footer(table[names.index("path")])]
            out = pd.DataFrame(rows, columns=[*names, *new.fieldNames()], dtype=object)
            yield out.where(out.notna(), None)

    spread = tables.select(*(F.col(f"`{name}`") for name in names)).repartition(F.col("path"))
    return spread.mapInPandas(read, T.StructType([*keys, *new.fields]))


def _footer(path: str | None) -> list[tuple]:
    """``ordinal``, ``column``, ``data_type``, ``nullable``, ``error`` of one table."""
    from pyarrow import fs, parquet

    try:
        if path is None:
            raise FileNotFoundError("there is no path")
        system, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        first = _first_file(system, root)
        with system.open_input_file(first) as file:
            footer = parquet.ParquetFile(file).schema_arrow
        fields = _fields(footer)
        below = first[len(root) :].split("/")[:-1]
        fields += [(part.split("=", 1)[0], None, True) for part in below if "=" in part]
        return [(at, *field, None) for at, field in enumerate(fields, 1)]
    except (OSError, ValueError) as error:  # pyarrow's own errors are of these two
        return [(None, None, None, None, f"{type(error).__name__}: {error}")]


def _first_file(system, root: str) -> str:
    """The first data file of a folder by name, or the file itself; only one branch of folders is listed at a time."""
    from pyarrow import fs

    if system.get_file_info(root).type == fs.FileType.File:
        return root
    found = [
        entry for entry in system.get_file_info(fs.FileSelector(root))
        if not entry.base_name.startswith(("_", ".")) and (entry.type == fs.FileType.Directory or entry.size)
    ]
    for entry in sorted(found, key=lambda e: (e.type == fs.FileType.Directory, e.base_name)):
        if entry.type == fs.FileType.File:
            return entry.path
        try:
            return _first_file(system, entry.path)
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"no file below {root}")


def _fields(footer) -> list[tuple[str, str, bool]]:
    """Names and types as Spark shows them."""
    from pyspark.sql.pandas.types import from_arrow_type

    stated = (footer.metadata or {}).get(_SPARK_SCHEMA)
    if stated:
        return [(f.name, f.dataType.simpleString(), True) for f in T.StructType.fromJson(json.loads(stated)).fields]
    out = []
    for field in footer:
        try:
            kind = from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString()
        except Exception:  # a type that Spark has no name for keeps its own
            kind = str(field.type)
        out.append((field.name, kind, True))
    return out


def counts(spark: SparkSession, table: str, path: str, scan: bool = False) -> DataFrame:
    """A row per column: ``table``, ``ordinal``, ``column``, ``data_type``, ``total_rows``, ``non_null_count``, ``min_val``, ``max_val``.

    Spark takes counts, and ranges of whole numbers and dates, from the footers: no row is read, however large
    the table. ``scan`` reads the columns of other types for their ranges, which are null otherwise. Spark gives up on a
    footer without a range, as of a column that is null all through a row group: then ranges come from a scan of
    their columns, and where counts are missing too, they do as well. A table with nested columns is scanned, as footers
    count the values inside them.
    """
    fields = list(enumerate(spark.read.parquet(path).schema.fields, 1))
    ranged = [(at, f) for at, f in fields if has_range(f.dataType) and (scan or isinstance(f.dataType, _STORED))]
    stored = [(at, f) for at, f in ranged if isinstance(f.dataType, _STORED)]
    flat = not any(isinstance(f.dataType, _NESTED) for _, f in fields)
    rows, known = None, []
    for known in (stored, []) if flat else ():
        rows = _stored(spark, _pushed(spark, path, fields, known))
        if rows is not None:
            break
    plain = spark.read.parquet(path)
    if rows is None:
        rows, known = plain.agg(*_counted(fields), *_ranged(ranged)), ranged
    left = [entry for entry in ranged if entry not in known]
    if left:
        rows = rows.crossJoin(plain.agg(*_ranged(left)))  # a row beside a row

    def shown(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def told(name: str, shown: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(shown)  # counts of no file at all are null

    each = F.inline(F.array(*(
        F.struct(
            F.lit(table).alias("table"), F.lit(at).alias("ordinal"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"), told("total", "total_rows"),
            told(f"n{at}", "non_null_count"), shown(f"low{at}").alias("min_val"), shown(f"high{at}").alias("max_val"),
        )
        for at, f in fields
    )))
    return rows.select(each)


def _value(field: T.StructField) -> Column:
    return F.col("`" + field.name.replace("`", "``") + "`")


def _counted(fields: list[tuple[int, T.StructField]]) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *(F.count(_value(f)).alias(f"n{at}") for at, f in fields)]


def _ranged(fields: list[tuple[int, T.StructField]]) -> list[Column]:
    ends = ((F.min, "low"), (F.max, "high"))
    return [end(_value(f)).cast("string").alias(f"{name}{at}") for at, f in fields for end, name in ends]


def _pushed(
    spark: SparkSession, path: str, fields: list[tuple[int, T.StructField]], ranged: list[tuple[int, T.StructField]]
) -> DataFrame:
    """One row: ``total``, and ``n``, ``low``, ``high`` with the place of each column, planned to come from footers."""
    own = spark.newSession()  # the two settings hold for this read alone
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    listed = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(name for name in listed if name != "parquet"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own.read.parquet(path).agg(*_counted(fields), *_ranged(ranged))


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame | None:
    """``rows``, written once; None where a footer lacks what is asked of it."""
    target = Scratch(spark, "footers").path
    try:
        rows.write.parquet(target)
    except (Py4JJavaError, PySparkException) as error:
        if "aggregatePushdown" not in str(error):
            raise
        return None
    return spark.read.schema(rows.schema).parquet(target)
