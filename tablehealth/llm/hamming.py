"""Exact top-k search in binary codes by multi-index hashing with growing segment radii.

A code is cut into segments, and each segment files the code under its own value. If a code differs
from a query by at most ``m * (r + 1) - 1`` bits, one of the ``m`` segments differs by at most ``r``. So
after all values within ``r`` of the query's segments were looked up, every code within that distance has
been verified. A query is finished once its k-th distance is that small; the others go on to ``r + 1``.

What a query has found bounds its k-th distance from above. So at each radius it looks up no more segments than it takes
to cover that bound (``s`` segments at radius ``r`` cover ``m * r + s - 1`` bits), and only codes within it are kept.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.operators.profile import union_all
from tablehealth.sources.scratch import Scratch, stage

BITS = 64
SEGMENTS = 4  # of each word of 64 bits
WIDTH = BITS // SEGMENTS


def words_of(*tables: DataFrame, vector: str) -> int:
    """How many words of 64 bits hold a sign for each element of the longest vector."""
    longest = [df.agg(F.max(F.size(vector))).first()[0] or 0 for df in tables]
    return max(1, -(-max(longest) // BITS))


def sign_code(vector: str, words: int = 1) -> Column:
    """Bit i is set where element i is positive; elements that are not there are not positive. Null for a null vector.

    A code of one word is a long, a longer one an array of longs.
    """
    def word(at: int) -> str:
        part = vector if words == 1 else f"slice({vector}, {BITS * at + 1}, {BITS})"
        return f"aggregate(transform({part}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"

    code = word(0) if words == 1 else f"array({', '.join(map(word, range(words)))})"
    return F.expr(f"if({vector} is null, null, {code})")


def _word(code: Column, at: int, words: int) -> Column:
    return code if words == 1 else F.get(code, F.lit(at))


def _segment(word: Column, number: int) -> Column:
    return F.shiftrightunsigned(word, number % SEGMENTS * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def _differ(words: int) -> list[Column]:
    """The bits in which ``q`` and ``code`` differ, word by word."""
    return [_word(F.col("q"), w, words).bitwiseXOR(_word(F.col("code"), w, words)) for w in range(words)]


def _distance(words: int) -> Column:
    first, *rest = [F.bit_count(d) for d in _differ(words)]
    return sum(rest, first).cast("int").alias("distance")


def _masks(weight: int) -> Column:
    """All segment masks with ``weight`` bits."""
    found = [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), weight)]
    return F.lit(found).cast("array<long>")


def _segments(code: str, words: int, value: str) -> Column:
    """Every segment of a code with its number."""
    return F.explode(F.array(*(
        F.struct(F.lit(s).alias("segment"), _segment(_word(F.col(code), s // SEGMENTS, words), s).alias(value))
        for s in range(SEGMENTS * words)
    ))).alias("at")


def _probes(queries: DataFrame, radius: int, words: int) -> DataFrame:
    """``q``, ``bound``, ``segment``, ``value``: segment values that differ from the query's by ``radius`` bits.

    Of as many segments, in order, as cover ``bound`` bits: all, unless the query is finished with this radius.
    Few queries may have many probes, so they are dealt over a stated number of tasks first: Spark would join small ones.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked = F.col("bound") + 1 - SEGMENTS * words * radius
    return (
        queries.repartition(tasks, F.col("q"))
        .select("q", "bound", _segments("q", words, "own"))
        .where(F.col("at.segment") < looked)
        .select("q", "bound", "at.segment", "at.own", F.explode(_masks(radius)).alias("mask"))
        .select("q", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    )


def _first_meeting(radius: int, words: int) -> Column:
    """True where no smaller radius, and no earlier segment at this one, finds the pair as well.

    Segments are looked up in order, so those that a query leaves out come after all that it looks up.
    """
    differ = _differ(words)
    clear = F.lit(True)
    for s in range(SEGMENTS * words):
        bits = F.bit_count(_segment(differ[s // SEGMENTS], s))
        clear &= F.when(F.col("segment") > s, bits > radius).otherwise(bits >= radius)
    return clear


def _filed(codes: DataFrame, words: int) -> DataFrame:
    return codes.select("code", "first_id", "n", _segments("code", words, "value")).select("code", "first_id", "n", "at.*")


def top_codes(codes: DataFrame, queries: DataFrame, k: int, words: int = 1) -> DataFrame:
    """``q``, ``code``, ``distance``: for each query code enough nearest codes to hold k rows.

    ``codes`` has a row per distinct ``code`` with its ``first_id`` and row count ``n``; ``queries`` has
    distinct ``q``.
    """
    scratch, segments = Scratch(codes.sparkSession, "topk"), SEGMENTS * words
    filed, total = stage(_filed(codes, words)), codes.count()
    best_first, query = Window.partitionBy("q").orderBy("distance", "first_id"), Window.partitionBy("q")
    pending, held, finished = queries.select("q", F.lit(BITS * words).alias("bound")), None, []
    for radius in range(WIDTH + 1):
        covered = segments * (radius + 1) - 1
        found = (
            _probes(pending, radius, words)
            .hint("merge")  # there are many more probes than Spark's estimate knows
            .join(filed, ["segment", "value"])
            .where((_distance(words) <= F.col("bound")) & _first_meeting(radius, words))
            .select("q", "code", "first_id", "n", _distance(words))
        )
        if held is not None:
            found = found.unionByName(held.select(found.columns))
        best = found.withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= k)
        reach = F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, 0))
        marked = (
            best.withColumn("reach", reach).drop("at")
            .withColumn("bound", F.min(F.when(F.col("reach") >= k, F.col("distance"))).over(query))
            .withColumn("all_found", F.count("*").over(query) >= total)
            .withColumn("done", F.coalesce(F.col("bound") <= covered, F.lit(False)) | F.col("all_found"))
        )
        now, _ = scratch.write(marked.drop("reach", "all_found"), radius)
        if radius == WIDTH:
            finished.append(now)
            break
        finished.append(now.where("done"))
        held = now.where("not done")
        state = now.groupBy("q").agg(F.min("bound").alias("best"), F.max("done").alias("done"))
        pending, left = scratch.write(
            pending.join(state, "q", "left").where("done is null or not done")
            .select("q", F.coalesce("best", "bound").alias("bound")),
            100 + radius,
        )
        if not left:
            break
    return union_all([f.select("q", "code", "distance") for f in finished])


def search(rows: DataFrame, queries: DataFrame, k: int, id_column: str, vector: str) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``distance``: the k nearest rows of each query row.

    Exact in Hamming distance between sign codes, which have as many words of 64 bits as the longest vector needs; of a shorter
    one the rest is not positive. Equal distances go by id. A row is its own neighbour if
    it is among the rows. Rows or queries without an id or a vector have no place in the result; a null
    element is not positive. Repeated rows count each time. With fewer than k rows all are returned, with
    an empty table none. Other columns are ignored.
    """
    words = words_of(rows, queries, vector=vector)

    def coded(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
            .select("id", sign_code("v", words).alias("code"))
            .where("id is not null and code is not null")
        )

    known, asked = stage(coded(rows)), stage(coded(queries))
    codes = stage(known.groupBy("code").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
    best = top_codes(codes, asked.select(F.col("code").alias("q")).distinct(), k, words)
    within = Window.partitionBy("code").orderBy("id")
    members = known.withColumn("at", F.row_number().over(within)).where(F.col("at") <= k)
    nearest = Window.partitionBy("q").orderBy("distance", "id", "at")
    ranked = (
        best.join(members, "code")
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("q", "rank", "id", "distance")
    )
    return asked.join(ranked, asked["code"] == ranked["q"]).select(
        asked["id"].alias("query_id"), "rank", ranked["id"].alias("id"), "distance"
    )
