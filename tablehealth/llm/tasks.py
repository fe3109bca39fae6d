"""What the Python tasks of several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tablehealth.zip")
    package = os.path.join(ROOT, "tablehealth")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Recent(dict):
    """Values by key, made by ``make`` when missing; keeps the recently used ones in bounded memory.

    Two generations: when the young one is full it becomes the old one, and what is asked for again
    moves back. Values of keys longer than ``LONGEST`` are not kept.
    """

    LONGEST = 100

    def __init__(self, make, limit: int = 150_000) -> None:
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self.learn(key, value)
        return value

    def unknown(self, keys) -> list:
        """Those of the keys that have no value here."""
        return [k for k in keys if k not in self and k not in self._old]

    def held(self, keys) -> dict:
        """Those of the keys that have values here, with their values; they count as used."""
        found = {k: self[k] if k in self else self._old[k] for k in keys if k in self or k in self._old}
        for key, value in found.items():
            if key not in self:
                self.learn(key, value)
        return found

    def learn(self, key, value) -> None:
        """Keep a value that was made elsewhere."""
        if len(key) > self.LONGEST:
            return
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
