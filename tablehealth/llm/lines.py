"""Lines of documents as column expressions, and the documents that are copies of one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.sources.scratch import stage

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
BANDS = 4
_MIX = [0x1B873593, -0x6E4F1A3D, 0x3C6EF372, -0x4A09E667, 0x510E527F, -0x27D4EB2F, 0x7F4A7C15, -0x0A4F8D53]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def quoted(name: str) -> Column:
    """The column of that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A name like ``name`` that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a whole text."""
    return F.unhex(F.md5(text))


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def line_key(normal: Column) -> Column:
    """Sixty bits of a normalised line's MD5."""
    return F.conv(F.substring(F.md5(normal), 1, 15), 16, 10).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def line_marks(normal: Column) -> Column:
    """Two min-hashes for each band over the three-word windows of a normalised line."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda i: F.shiftright(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 32
            ).cast("int"),
        )

    def marks(h: Column) -> Column:
        mixed = [F.array_min(F.transform(h, lambda x, c=c: x.bitwiseXOR(F.lit(c)))) for c in _MIX]
        return F.array(*mixed)

    return let(F.split(normal, " "), lambda w: let(windows(w), marks))


def line_items(text: Column) -> Column:
    """``key``, ``chars`` and ``marks`` of every line that holds a word, in order."""
    return F.transform(
        lines_with_words(text),
        lambda line: let(
            normal_line(line),
            lambda n: F.struct(
                line_key(n).alias("key"), F.length(n).alias("chars"), line_marks(n).alias("marks")
            ),
        ),
    )


def _same(left: str, right: str, names: list[str]) -> Column:
    same = F.lit(True)
    for name in names:
        same &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def line_sets(found: DataFrame, within: list[str]) -> DataFrame:
    """A row per set of lines: ``within``, ``set_key``, ``lines`` (each once), ``source`` of its earliest document."""
    keys = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["key"])))
    return (
        found.where(F.size("lines") > 0)
        .groupBy(*within, F.xxhash64(keys).alias("set_key"))
        .agg(
            F.min(F.struct(F.col("doc_id"), F.col("source"))).alias("earliest"),
            F.array_distinct(F.first("lines")).alias("lines"),
        )
        .select(
            "set_key", "lines",
            *([] if "source" in within else [F.col("earliest.source").alias("source")]), *within,
        )
    )


def original_lines(sets: DataFrame, common: DataFrame, within: list[str]) -> DataFrame:
    """``within``, ``set_key``, ``source``, ``item`` for each common line of each original set of lines.

    ``common`` holds ``within`` and ``key`` of the lines in question. A set is judged by its other lines, its own:
    if these agree with those of another set in the two min-hashes of a band, both are copies of one document, and
    the one with the smallest ``set_key`` is its original. Copies with a few words changed so count once, while
    documents with nothing in common but the lines in question each count. A set without own lines is an original.
    """
    items = sets.select("set_key", "source", F.explode("lines").alias("item")).alias("i")
    known = common.select(*within, "key", F.lit(True).alias("common")).alias("c")
    on = (F.col("i.item.key") == F.col("c.key")) & _same("i", "c", within)
    told = stage(items.join(known, on, "left").select("i.set_key", "i.source", "i.item", "c.common"))
    own = F.col("common").isNull()
    marks = [
        F.coalesce(F.min(F.when(own, F.col("item.marks")[k])).cast("long"), F.col("set_key"))
        for k in range(2 * BANDS)
    ]
    each = told.groupBy(*within, "set_key").agg(
        F.max("common").alias("common"), *(m.alias(f"m{k}") for k, m in enumerate(marks))
    ).where("common")
    bands = F.array(*(
        F.struct(F.lit(b).alias("band"), F.col(f"m{2 * b}").alias("x"), F.col(f"m{2 * b + 1}").alias("y"))
        for b in range(BANDS)
    ))
    originals = (
        each.select(*within, "set_key", F.explode(bands).alias("b"))
        .groupBy(*within, "b").agg(F.min("set_key").alias("set_key"))
        .groupBy(*within, "set_key").agg(F.count("*").alias("n"))
        .where(F.col("n") == BANDS)
    ).alias("o")
    left = told.where("common").alias("t")
    on = (F.col("t.set_key") == F.col("o.set_key")) & _same("t", "o", within)
    return left.join(originals, on, "left_semi").select("set_key", "source", "item")
