"""Quality rules: counts within a document, and lines that too many documents of a host repeat.

Everything is a column expression or a DataFrame operation; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.llm.lines import (
    SPACES,
    let,
    line_items,
    line_sets,
    lines_with_words,
    original_lines,
    text_key,
    text_of,
)
from tablehealth.sources.scratch import stage

MIN_WORDS = 50
MIN_DOCUMENTS = 20
HOST_SHARE = 0.005
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds at least twice.

    A window is its 64-bit hash. Texts without a repeated hash end there; otherwise hashes are sorted
    together with their places, so that equal ones meet.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def places(s: Column) -> Column:
        def met(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(
                after == x["h"], F.lit(False)
            )

        return F.array_sort(F.transform(F.filter(s, met), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(
            p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def counted(h: Column) -> Column:
        placed = F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(placed, lambda s: let(places(s), covered))
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes(words), counted))


def features(docs: DataFrame) -> DataFrame:
    """A row per document: the counts, its lines as keys, and a key of its text. No text."""
    text = F.col("text")
    lines = lines_with_words(text)
    base = docs.select("doc_id", "source", text_of().alias("text"))
    counted = base.select(
        "doc_id",
        "source",
        text_key(text).alias("text_key"),
        let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("in_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long")
        .alias("n_dup_lines"),
        line_items(text).alias("lines"),
    )
    return counted.select(
        "doc_id", "source", "text_key", "in_words.*", "n_symbols", "n_dup_lines", "lines"
    )


def common_lines(
    found: DataFrame, min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE
) -> DataFrame:
    """``source``, ``key`` of the lines that more documents of their host hold than the limit allows.

    The limit is ``min_documents``, or ``host_share`` of the host's documents if that is more. Copies
    of one document count once: removing them is the task of deduplication.
    """
    hosts = found.groupBy("source").agg(F.count("*").alias("host_docs")).alias("h")
    sets = stage(line_sets(found.select("doc_id", "source", "lines"), ["source"]))

    def over(counted: DataFrame) -> DataFrame:
        left = counted.where(F.col("n") > min_documents).alias("c")
        return left.join(hosts, F.col("c.source").eqNullSafe(F.col("h.source"))).where(
            F.col("n") > F.col("host_docs") * host_share
        ).select("c.source", "key")

    every = sets.select("source", F.explode("lines.key").alias("key"))
    likely = stage(over(every.groupBy("source", "key").agg(F.count("*").alias("n"))))
    left = original_lines(sets, likely, ["source"])
    return over(
        left.groupBy("source", F.col("item.key").alias("key")).agg(F.count("*").alias("n"))
    )


def depleted(found: DataFrame, common: DataFrame) -> DataFrame:
    """``source``, ``text_key`` of documents that lose more than half of their characters."""
    texts = found.groupBy("source", "text_key").agg(F.first("lines").alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda t, x: t + x["chars"])
    items = texts.select(
        "source", "text_key", total.alias("total"), F.explode("lines").alias("item")
    ).alias("i")
    bad = common.alias("b")
    same = F.col("i.source").eqNullSafe(F.col("b.source")) & (F.col("i.item.key") == F.col("b.key"))
    return (
        items.join(bad, same, "left_semi")
        .groupBy("source", "text_key", "total")
        .agg(F.sum("item.chars").alias("lost"))
        .where(F.col("lost") * 2 > F.col("total"))
        .select("source", "text_key")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    )


def judge(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE
) -> DataFrame:
    """``doc_id``, ``source``, ``text_key``, the counts, ``base_failed`` and ``kept``, a row per document.

    Reads ``doc_id``, ``source``, ``text``; other columns are ignored. A null text counts as empty, an
    empty one fails (no words), null sources are a host of their own. Repeated rows get equal rows,
    also when they share a ``doc_id``. An empty table gives an empty result.
    """
    found = stage(features(docs))
    lost = depleted(found, common_lines(found, min_documents, host_share)).alias("d")
    left = found.drop("lines").alias("f")
    same = F.col("f.source").eqNullSafe(F.col("d.source")) & (
        F.col("f.text_key") == F.col("d.text_key")
    )
    joined = left.join(lost.withColumn("lost", F.lit(True)), same, "left")
    return joined.select(
        "f.doc_id",
        "f.source",
        "f.text_key",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & F.col("lost").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    A verdict depends on source and text alone, so rejected pairs of the two are what is joined.
    """
    bad = judge(docs).where(~F.col("kept")).select("source", "text_key").distinct().alias("bad")
    left = docs.alias("doc")
    same = F.col("doc.source").eqNullSafe(F.col("bad.source")) & (
        text_key(F.coalesce(F.col("doc.text"), F.lit(""))) == F.col("bad.text_key")
    )
    return left.join(bad, same, "left_anti")
