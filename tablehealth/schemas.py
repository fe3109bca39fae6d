"""Explicit schemas: nothing is inferred from data.

Inferring a catalog manifest would turn every node id into a struct field of its own, so the
schema below reads the id-keyed objects as maps instead.
"""

from pyspark.sql import types as T

_STR = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_DEPENDS_ON = _struct(nodes=T.ArrayType(_STR))

# A test entry is a plain name or a one-key object. Read as ARRAY<STRING>, objects arrive as JSON text.
MANIFEST_COLUMN = _struct(
    name=_STR, description=_STR, data_type=_STR, tests=T.ArrayType(_STR)
)

MANIFEST_NODE = _struct(
    name=_STR,
    alias=_STR,
    resource_type=_STR,
    description=_STR,
    original_file_path=_STR,
    database=_STR,
    schema=_STR,
    config=_STR,
    raw_code=_STR,
    raw_sql=_STR,
    compiled_code=_STR,
    compiled_sql=_STR,
    columns=T.MapType(_STR, MANIFEST_COLUMN),
    depends_on=_DEPENDS_ON,
    tags=T.ArrayType(_STR),
)

MANIFEST_SOURCE = _struct(
    name=_STR,
    source_name=_STR,
    identifier=_STR,
    database=_STR,
    schema=_STR,
    description=_STR,
    loaded_at_field=_STR,
)

MANIFEST_EXPOSURE = _struct(name=_STR, type=_STR, description=_STR, depends_on=_DEPENDS_ON)

CORRUPT = "_corrupt_manifest"

# The entries of a manifest stay JSON text until they are rows of their own, so that what one file holds can be parsed
# by many tasks, and what is not asked for is skipped.
MANIFEST = T.StructType(
    [
        T.StructField("nodes", T.MapType(_STR, _STR)),
        T.StructField("sources", T.MapType(_STR, _STR)),
        T.StructField("exposures", T.MapType(_STR, _STR)),
        T.StructField(CORRUPT, _STR),
    ]
)

TABLE_COLUMNS = T.StructType(
    [
        T.StructField("table", _STR, False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column", _STR, False),
        T.StructField("data_type", _STR, False),
        T.StructField("is_nullable", T.BooleanType(), False),
    ]
)

SAMPLE_VALUES = T.StructType(
    [
        T.StructField("table", _STR, True),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column", _STR, False),
        T.StructField("sample_values", T.ArrayType(_STR), False),
    ]
)

TEST_ENTRY = _struct(name=_STR, config=_STR)

REGISTRY_MODELS = _struct(
    project_id=_STR, model=_STR, description=_STR, tests=T.ArrayType(TEST_ENTRY)
)

REGISTRY_COLUMNS = T.StructType(
    [
        T.StructField("project_id", _STR),
        T.StructField("model", _STR),
        T.StructField("column", _STR),
        T.StructField("pos", T.LongType()),
        T.StructField("description", _STR),
        T.StructField("tests", T.ArrayType(TEST_ENTRY)),
    ]
)
