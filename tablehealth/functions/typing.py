"""Column classes, decided from the Spark schema while a plan is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType) + (
    (T.TimeType,) if hasattr(T, "TimeType") else ()
)
_INTERVALS = (T.DayTimeIntervalType, T.YearMonthIntervalType)

# Spellings of one and the same type in different engines.
SYNONYMS = {
    "string": ("string", "varchar", "character varying", "text", "char", "character", "bpchar"),
    "smallint": ("smallint", "int2", "short"),
    "int": ("int", "integer", "int4"),
    "bigint": ("bigint", "int8", "long"),
    "float": ("float", "float4", "real"),
    "double": ("double", "double precision", "float8"),
    "boolean": ("boolean", "bool"),
    "date": ("date",),
    "timestamp": ("timestamp", "timestamp_ntz", "timestamp without time zone", "datetime"),
    "timestamptz": ("timestamptz", "timestamp_ltz", "timestamp with time zone"),
    "binary": ("binary", "bytea", "blob", "varbinary"),
}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, _TEMPORAL)


def has_range(kind: T.DataType) -> bool:
    """Whether minimum and maximum are reported for a column of this type."""
    return is_numeric(kind) or is_temporal(kind) or isinstance(kind, _INTERVALS)


def is_plain_text(kind: T.DataType) -> bool:
    """Text compared byte by byte. A collation may make different texts equal, so those are not."""
    return isinstance(kind, T.StringType) and kind.simpleString() == "string"


def holds_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return holds_variant(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_variant(kind.keyType) or holds_variant(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(holds_variant(f.dataType) for f in kind.fields)
    return isinstance(kind, T.VariantType)


def canonical_type(kind: Column) -> Column:
    """Map the spellings of a type to one name; parameters in brackets are dropped."""
    bare = F.trim(F.lower(F.regexp_replace(kind, r"\s*\([^)]*\)", "")))
    name = bare
    for canonical, spellings in SYNONYMS.items():
        name = F.when(bare.isin(*spellings), F.lit(canonical)).otherwise(name)
    return name
