"""A documentation registry kept in versions, of which a merge rewrites the projects it touches and no others.

``data/version=N`` holds the rows that version N wrote, in a folder per project; ``pointers/version=N`` says for every
project which version holds its rows. A pointer is one file, written last: a merge that is lost half-way leaves the registry as
it was, and running it again writes the same version anew. Earlier versions stay readable.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.operators import registry
from tablehealth.schemas import REGISTRY_COLUMNS

_POINTERS = "project string, held_in int"


class Versions:
    """Registry columns (see ``registry``) below ``path``, a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def last(self) -> int:
        """The latest whole version, -1 where there is none."""
        try:
            found = self._spark.read.schema(f"{_POINTERS}, version int").parquet(f"{self._path}/pointers")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        return found.agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """All columns as of a version, by default the last; an empty registry where there is none."""
        version = self.last() if version is None else version
        return self._rows(version, self._pointers(version)) if version >= 0 else self._none()

    def merge(self, proposals: DataFrame) -> int:
        """Merge proposed columns as :func:`registry.merge_columns` does; returns the new version.

        Only projects with a proposal are read and rewritten. ``proposals`` is read twice. A null project and an empty one
        share a folder, not their rows. Two merges at a time are refused: the later pointer finds the earlier.
        """
        last = self.last()
        touched = proposals.select(_folder().alias("project")).distinct()
        held = self._pointers(last) if last >= 0 else self._spark.createDataFrame([], _POINTERS)
        old = self._rows(last, held.join(touched, "project", "left_semi")) if last >= 0 else self._none()
        return self._write(registry.merge_columns(old, proposals), held, touched, last + 1)

    def _write(self, rows: DataFrame, held: DataFrame, touched: DataFrame, version: int) -> int:
        # Few files for a small project; adaptive execution splits a large one over several tasks.
        placed = rows.withColumn("project", _folder()).hint("rebalance", "project")
        placed.write.mode("overwrite").partitionBy("project").parquet(f"{self._path}/data/version={version}")
        new = touched.select("project", F.lit(version).alias("held_in"))
        pointers = held.join(touched, "project", "left_anti").unionByName(new)
        # A row per project; in one file it appears whole or not at all. Order lets a reader skip what it does not want.
        pointers.coalesce(1).sortWithinPartitions("project").write.mode("errorifexists").parquet(
            f"{self._path}/pointers/version={version}"
        )
        return version

    def _pointers(self, version: int) -> DataFrame:
        return self._spark.read.schema(_POINTERS).parquet(f"{self._path}/pointers/version={version}")

    def _rows(self, version: int, pointers: DataFrame) -> DataFrame:
        """Rows of the given projects. The join is on folder columns, so Spark opens no other project's files."""
        places = [T.StructField("version", T.IntegerType()), T.StructField("project", T.StringType())]
        schema = T.StructType([*REGISTRY_COLUMNS.fields, *places])
        data = self._spark.read.schema(schema).parquet(f"{self._path}/data").where(F.col("version") <= version)
        same = (F.col("d.project") == F.col("p.project")) & (F.col("d.version") == F.col("p.held_in"))
        return data.alias("d").join(pointers.alias("p"), same, "left_semi").drop("version", "project")

    def _none(self) -> DataFrame:
        return self._spark.createDataFrame([], REGISTRY_COLUMNS)


def _folder() -> Column:
    """A folder name for any project: never null or empty, which partitions cannot tell apart."""
    return F.concat(F.lit("p-"), F.coalesce("project_id", F.lit("")))
