"""Tables written between the rounds of an iterative job.

Lineage is cut by writing to the shared folder, so a lost executor costs a re-read and not a
recomputation of every earlier round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local session without it gets a temporary one.

    Nothing in the folder is deleted here, as results may still read from it.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"Set {_SETTING} to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tablehealth-")
    return _local_folders[app]


class Scratch:
    """Numbered versions of one table in a folder of its own."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.last = -1  # the version written last

    def write(self, df: DataFrame, version: int) -> tuple[DataFrame, int]:
        """Write one version; return it read back, and its row count taken while writing."""
        seen = Observation()
        target = f"{self.path}/version={version}"
        self.last = version
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(target)
        return self._spark.read.schema(df.schema).parquet(target), seen.get["n"]

    def all_versions(self, schema: T.StructType) -> DataFrame:
        """Every version as one table with the partition column ``version``."""
        fields = [*schema.fields, T.StructField("version", T.IntegerType())]
        return self._spark.read.schema(T.StructType(fields)).parquet(self.path)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    Worth it before a profile of anything that is not a stored columnar table: a join, a view, rows
    of text files or of a database. The profile reads column by column, and would otherwise compute
    or fetch the whole input once per column.
    """
    return Scratch(df.sparkSession, "staged").write(df, 0)[0]
