"""Profiles of tables that grow by parts: a stored summary per part and column, merged on demand.

A summary holds counts, the range and a HyperLogLog sketch of a column in one part (a day, say). A new part costs a scan of
that part alone, and a profile of the table reads a few kilobytes per part and column however large the table is. Writing
a part again replaces its summaries, so a job that was lost half-way is simply run once more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.functions import typing as kinds
from tablehealth.operators import profile as p

RSD = 0.05
_TYPED = ("whole", "real", "moment")


def summarize(df: DataFrame, table: str, part: Column, *, rsd: float = RSD) -> DataFrame:
    """A row per value of ``part`` and column of ``df``: counts, range and sketch, all parts in one scan.

    ``part`` is taken as text; null and empty are the same part. Rows of a part are summarised in every task before they
    are shuffled, so a part that holds most rows costs no more than another. An empty table has no parts. Arrays, maps
    and other types without a plain text are told apart by the text Spark gives them and have no range.
    """
    fields = p._fields(df, table, None)
    name = "part"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    data = p._by_position(df).withColumn(name, F.nullif(part.cast("string"), F.lit("")))
    figures = [
        "count(1) as total_rows",
        f"count(case when {' or '.join(f'{c} is not null' for c in p._CELL)} then 1 end) as non_null_count",
        f"hll_sketch_agg(case when {' or '.join(f'{c} is not null' for c in p._CELL)} "
        f"then xxhash64({', '.join(p._CELL)}) end, {_precision(rsd)}) as sketch",
        *(f"{f}({c}) as {end}_{c}" for c in _TYPED for end, f in p._ENDS.items()),
    ]
    parts = []
    for some in p._scans(fields):
        shown = [(i, T.StructField(f.name, _stored(f.dataType))) for i, f in some]
        cells = _cells(data, shown, name)
        ranges = p._ranges(shown, alone=False)
        grouped = cells.groupBy("part", "at").agg(*map(F.expr, [*figures, *ranges]))
        parts.append(grouped.select(*p._identities(table, some), *(c for c in grouped.columns if c != "at")))
    return p.union_all(parts)


def save(summaries: DataFrame, path: str) -> None:
    """Write summaries below ``path``, replacing those of the same table and part and no others."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table", "part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All stored summaries; table and part are text whatever they look like."""
    fields = [T.StructField(name, T.StringType()) for name in ("table", "part")]
    stored = spark.read.parquet(path).drop("table", "part").schema
    return spark.read.schema(T.StructType([*stored.fields, *fields])).parquet(path)


def merge(summaries: DataFrame) -> DataFrame:
    """The profile of each table over all given parts, as ``profile`` in ``approx`` mode returns it.

    Counts and ranges are exact, distinct counts are estimates. Columns go by name and type: one that some parts lack, or
    hold in another type, is profiled over the parts that have it. Select parts before for a profile of some of them.
    """
    types = sorted(row[0] for row in summaries.select("data_type").distinct().collect())
    fields = [(at, T.StructField(kind, _stored(T.DataType.fromDDL(kind)))) for at, kind in enumerate(types, 1)]
    at = F.array_position(F.array(*map(F.lit, types)), F.col("data_type")) - 1
    figures = [
        "max(ordinal) as ordinal",
        "sum(total_rows) as total_rows",
        "sum(non_null_count) as non_null_count",
        "hll_sketch_estimate(hll_union_agg(sketch, true)) as unique_count",
        *(f"{f}({end}_{c}) as {end}_{c}" for c in _TYPED for end, f in p._ENDS.items()),
    ]
    for end, f in p._ENDS.items():
        wide = [
            f"cast({f}(case when at = {n} then try_cast({end}_text as {x.dataType.simpleString()}) end) as string)"
            for n, (_, x) in enumerate(fields) if isinstance(x.dataType, T.DecimalType)
        ]
        figures.append(f"coalesce({', '.join(['cast(null as string)', *wide])}) as {end}_text")
    low, high = (p._if_ranged(fields, {c: f"{end}_{c}" for c in p._CELL}) for end in p._ENDS)
    merged = summaries.withColumn("at", at).groupBy("table", "column", "data_type", "at").agg(*map(F.expr, figures))
    return p._derive(merged.select("*", *map(F.expr, (
        "false as is_exact", f"{low} as min_val", f"{high} as max_val", "cast(null as array<string>) as listed",
    ))))


def _precision(rsd: float) -> int:
    """Bits of the sketch for which a merged estimate is off by ``rsd`` at one standard deviation."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))


def _stored(kind: T.DataType) -> T.DataType:
    """The type as which a column is summarised: text where its own has no plain text."""
    return kind if p._is_plain(kind) else T.StringType()


def _cells(data: DataFrame, fields: list[tuple[int, T.StructField]], part: str) -> DataFrame:
    """The cells of a profile, each with the part of its row."""
    odd = {
        data.columns[i - 1]: F.to_json(p._column(data, i))
        for i, _ in fields if kinds.holds_variant(data.schema[i - 1].dataType)
    }
    return p._cells(data.withColumns(odd) if odd else data, fields, keep=[part]).withColumnRenamed(part, "part").selectExpr(
        "*", "text as k"
    )
