"""Connected components of an edge table, by alternating large-star and small-star steps.

Every round is a few joins and groupings and is written to the shared folder, so lineage stays short.
No node's neighbours are ever gathered: a step needs only their minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.sources.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node point to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``root`` for every node that has an edge and is not itself the root.

    ``edges`` holds ``a`` and ``b`` of an ordered type; loops are ignored, direction does not matter.
    The root is the smallest node of the component.
    """
    rounds = Scratch(edges.sparkSession, label)
    start = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now, _ = rounds.write(start.distinct(), 0)
    mark, version = _mark(now), 0
    while True:
        version += 1
        now, _ = rounds.write(_small_star(_large_star(now).distinct()).distinct(), version)
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
