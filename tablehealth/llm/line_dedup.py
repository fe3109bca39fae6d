"""Line dedup: remove lines that many sites share.

A HyperLogLog sketch of the sites of each line is built in every task and merged by the aggregation,
so a line costs one small row per task however often it occurs. Lines whose estimate reaches the
threshold or is near it get an exact distinct count, over originals alone, before anything is removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.llm.lines import (
    WORD,
    line_items,
    line_key,
    line_sets,
    normal_line,
    original_lines,
    text_key,
    text_of,
)
from tablehealth.sources.scratch import stage

MIN_SITES = 10
MIN_CHARS = 12
SKETCH_BITS = 10


def site(source: Column) -> Column:
    """A null source is a site of its own."""
    return F.xxhash64(source)


def shared_lines(found: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key`` of the lines that originals on at least ``min_sites`` sites hold.

    Lines shorter than ``min_chars`` are left alone. Of each group of copies only the original counts: what spreads
    by copying whole documents is for near-dedup to handle.
    """
    sets = stage(line_sets(found.select("doc_id", "source", "lines"), []))
    margin = max(2, math.ceil(4 * min_sites * 1.04 / math.sqrt(2**SKETCH_BITS)))
    likely = stage(
        sets.select(site(F.col("source")).alias("site"), F.explode("lines.key").alias("key"))
        .groupBy("key")
        .agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.count("*").alias("sets"))
        .where(F.col("sets") >= min_sites)
        .select("key", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites - margin)
        .select("key")
    )
    return (
        original_lines(sets, likely, [])
        .where(F.col("item.chars") >= min_chars)
        .groupBy(F.col("item.key").alias("key"), site(F.col("source")).alias("site"))
        .count()
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("key")
    )


def clean(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the shared lines, and ``removed_lines``.

    Reads ``doc_id``, ``source``, ``text``. A null text stays null, an empty one empty; a text of nothing
    but shared lines becomes empty. Repeated rows are treated alike. Other columns pass through; one
    that is called ``removed_lines`` is replaced.
    """
    found = stage(
        docs.select("doc_id", "source", text_of().alias("text")).select(
            "doc_id",
            "source",
            text_key(F.col("text")).alias("text_key"),
            line_items(F.col("text")).alias("lines"),
        )
    )
    texts = found.groupBy("text_key").agg(F.first("lines").alias("lines"))
    hit = stage(  # stored, so that the join below can split a text that many rows have
        texts.select("text_key", F.explode("lines.key").alias("key"))
        .join(shared_lines(found, min_sites, min_chars), "key", "left_semi")
        .groupBy("text_key")
        .agg(F.collect_set("key").alias("bad_keys"))
    ).alias("hit")
    left = docs.alias("doc")
    joined = left.join(
        hit, text_key(F.coalesce(F.col("doc.text"), F.lit(""))) == F.col("hit.text_key"), "left"
    )

    def stays(line: Column) -> Column:
        return ~(
            line.rlike(WORD) & F.array_contains(F.col("hit.bad_keys"), line_key(normal_line(line)))
        )

    lines = F.split(F.col("doc.text"), "\n")
    hit_here = F.col("hit.bad_keys").isNotNull()
    kept = F.filter(lines, stays)
    text = F.when(hit_here, F.array_join(kept, "\n")).otherwise(F.col("doc.text"))
    removed = F.when(hit_here, F.size(lines) - F.size(kept)).otherwise(F.lit(0))
    columns = [
        text.alias("text") if name == "text" else F.col(f"doc.`{name}`")
        for name in docs.columns
        if name != "removed_lines"
    ]
    return joined.select(*columns, removed.cast("long").alias("removed_lines"))


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """The documents with shared lines removed, in their own columns."""
    return clean(docs).select(*(F.col(f"`{name}`") for name in docs.columns if name != "removed_lines"))
