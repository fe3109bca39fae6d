"""Conversation structure repair: the cheapest edits that make roles take turns.

Rows are put in one global order by a range sort of their keys, without their texts, so a conversation of any length is
spread over as many tasks as its rows need. It is cut into stretches of bounded length. Each distinct sequence of roles and
faults is evaluated once, by the grammar of ``grammar``; matrices of stretches are joined level by level, a bounded number at
a time, and the states found at the top are handed down again. Only then do edits meet the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.grammar import INSERT, INSERTED, NEVER, STATES, Grammar, Matrices, product
from tablehealth.llm.tasks import ship, slices
from tablehealth.sources.scratch import stage

#: A stretch is at most 2**STRETCH rows; each further level joins those whose places agree in all but so many bits.
STRETCH = 12
LEVELS = (20, 28, 33, 41, 49, 57, 63)
#: Symbols of the sequences that share a grammar.
GRAMMAR_SYMBOLS = 1 << 20

_ANY, _BLANKS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
_NODE = "first long, cost array<long>, rank array<long>, illegal long, begins string, ends string"


def _or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def _key(column: Column) -> Column:
    """A text that tells conversation ids apart, the missing one included."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _read(rows: DataFrame) -> DataFrame:
    """The columns in use: ``conv`` (key), ``turn``, ``role``, ``text``, ``said`` (digest of the last two)."""
    role, text = _or_space(F.col("role")), _or_space(F.col("text"))
    return rows.select(
        _key(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("said"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of conversation and turn: dropped, emptied, without ends of sentences, twice, or of another
    role. Nulls read as one space."""
    key = F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = _or_space(F.col("text"))
    return (
        rows.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .withColumn("role", F.when(kind == 4, "user").otherwise(_or_space(F.col("role"))))
        .where(kind != 0)
        .select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), (kind == 3).cast("int"))).alias("copy"))
        .drop("copy")
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """A small row per row, with its ``place`` in an order by conversation, turn, role and text."""
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "conv", "turn", "said",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (~F.col("text").rlike(_ANY)).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{_BLANKS}*\z")).alias("truncated"),
        "role",
    )
    order = slim.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "said").drop("role")
    return stage(order.withColumn("place", F.monotonically_increasing_id()))


def _faults(ordered: DataFrame) -> DataFrame:
    """``conv``, ``place``, ``turn``, ``said``, ``initial``, ``fault`` (null, blank, duplicate or truncated) and ``symbol``."""
    again = (
        ordered.where(~F.col("blank"))
        .groupBy("conv", "said").agg(F.min("place").alias("earliest"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("place") > F.col("earliest"), "duplicate")
        .when(F.col("truncated"), "truncated")
    )
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    return (
        ordered.join(again, ["conv", "said"], "left")
        .select("conv", "place", "turn", "said", "initial", fault.alias("fault"))
        .withColumn("symbol", symbol)
    )


def _stretches(faults: DataFrame) -> DataFrame:
    """A row per conversation and stretch of places: its ``symbols``, faults, and illegal neighbours."""
    initials = F.col("rows.initial")
    legal = F.array(F.lit("su"), F.lit("ua"), F.lit("au"))
    following = F.transform(initials, lambda x, k: F.concat(x, F.get(initials, k + 1)))
    bad = F.filter(following, lambda p: p.isNotNull() & ~F.array_contains(legal, p))
    counts = [F.sum((F.col("fault") == k).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")]
    return (
        faults.groupBy("conv", F.shiftright("place", STRETCH).alias("stretch"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "initial"))).alias("rows"), *counts)
        .select(
            "conv", F.element_at("rows", 1)["place"].alias("first"),
            F.element_at("rows", -1)["place"].alias("last"),
            F.array_join("rows.symbol", "").alias("symbols"),
            *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("blank", "duplicate", "truncated")),
            F.size(bad).cast("long").alias("illegal"),
            F.element_at(initials, 1).alias("begins"), F.element_at(initials, -1).alias("ends"),
        )
    )


def _flat(matrices: Matrices, at: int) -> tuple[list[int], list[int]]:
    return matrices.cost[at].ravel().tolist(), matrices.rank[at].ravel().tolist()


def evaluated(sequences: DataFrame) -> DataFrame:
    """``symbols``, and the matrix of each as ``cost``, ``rank``, ``edits``, cells row by row; rows of ``sequences`` are distinct."""
    ship(sequences.sparkSession)
    schema = "symbols string, cost array<long>, rank array<long>, edits array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            every, at = batch["symbols"].to_pylist(), 0
            while at < len(every):
                texts = every[at : at + max(1, GRAMMAR_SYMBOLS >> STRETCH)]
                if sum(map(len, every)) <= GRAMMAR_SYMBOLS:
                    texts = every
                at += len(texts)
                own = Grammar(texts)
                found = [_flat(own.matrices, r) for r in own.roots.tolist()]
                edits = [
                    [own.edits(r, *divmod(c, STATES)) if x < NEVER else None for c, x in enumerate(cost)]
                    for r, (cost, _) in zip(own.roots.tolist(), found, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(texts, pa.string()), pa.array([c for c, _ in found], pa.list_(pa.int64())),
                        pa.array([r for _, r in found], pa.list_(pa.int64())),
                        pa.array(edits, pa.list_(pa.string())),
                    ],
                    names=["symbols", "cost", "rank", "edits"],
                )

    return sequences.select("symbols").mapInArrow(run, schema)


def _chain(parts: list[dict]) -> tuple[Matrices, list[np.ndarray]]:
    """The product of some matrices in order, and the state before each part but the first by cell of the product up to it."""
    cost = np.array([p["cost"] for p in parts], np.int64).reshape(-1, STATES, STATES)
    rank = np.array([p["rank"] for p in parts], np.int64).reshape(-1, STATES, STATES)
    every = Matrices(cost, rank)
    total, vias = every[:1], []
    for k in range(1, len(parts)):
        total, via = product(total, every[k : k + 1])
        vias.append(via[0])
    return total, vias


def _joined(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes whose first places agree beyond so many bits, as ``parts`` of a node of their own."""
    node = F.struct("first", "cost", "rank", "illegal", "begins", "ends")
    return nodes.groupBy("conv", F.shiftright("first", bits).alias("parent")).agg(
        F.array_sort(F.collect_list(node)).alias("parts")
    )


def _up(families: DataFrame) -> DataFrame:
    """The node that each family's parts make together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for conv, parts in zip(batch["conv"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                cost, rank = _flat(_chain(parts)[0], 0)
                meet = [a["ends"] + b["begins"] for a, b in zip(parts, parts[1:])]
                illegal = sum(p["illegal"] for p in parts) + sum(p not in ("su", "ua", "au") for p in meet)
                out.append({
                    "conv": conv, "first": parts[0]["first"], "cost": cost, "rank": rank, "illegal": illegal,
                    "begins": parts[0]["begins"], "ends": parts[-1]["ends"],
                })
            yield from pa.Table.from_pylist(out, schema).to_batches()

    lists = pa.list_(pa.int64())
    schema = pa.schema([
        ("conv", pa.string()), ("first", pa.int64()), ("cost", lists), ("rank", lists), ("illegal", pa.int64()),
        ("begins", pa.string()), ("ends", pa.string()),
    ])
    return families.select("conv", "parts").mapInArrow(run, f"conv string, {_NODE}")


def _down(families: DataFrame) -> DataFrame:
    """``conv``, ``first``, ``start``, ``end`` (states) of the parts of families with known ``start`` and ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                start, end = row["start"], row["end"]
                vias = _chain(row["parts"])[1]
                for part, via in zip(row["parts"][:0:-1], vias[::-1], strict=True):
                    before = int(via[start, end])
                    out.append({"conv": row["conv"], "first": part["first"], "start": before, "end": end})
                    end = before
                out.append({"conv": row["conv"], "first": row["parts"][0]["first"], "start": start, "end": end})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    schema = pa.schema([("conv", pa.string()), ("first", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    return families.mapInArrow(run, "conv string, first long, start int, end int")


def _finished(nodes: DataFrame) -> DataFrame:
    """Whole conversations: their ``total`` cost, last state ``end`` and what is inserted at the end, ``tail``."""
    ends = F.array(*(
        F.struct(
            (F.get("cost", F.lit(k)) + INSERT * len(INSERTED[k, goal])).alias("total"),
            F.get("rank", F.lit(k)).alias("rank"), F.lit(INSERTED[k, goal]).alias("tail"), F.lit(k).alias("end"),
        )
        for k, goal in ((0, 0), (0, 3), (1, 3), (2, 3), (3, 3))
    ))
    return nodes.withColumn("best", F.array_min(ends)).select(
        "conv", "first", "illegal", F.col("best.total").alias("cost"), F.lit(0).alias("start"),
        F.col("best.end").alias("end"), F.col("best.tail").alias("tail"),
    )


def _solved(stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored whole conversations (``conv``, ``illegal``, ``cost``, ``tail``), and the states of every stretch."""
    nodes = stretches.select("conv", "first", "cost", "rank", "illegal", "begins", "ends")
    several = nodes.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    several = stage(several)
    whole = _finished(nodes.join(several, "conv", "left_anti"))
    states = whole.select("conv", "first", "start", "end")
    long = stage(nodes.join(several, "conv", "left_semi"))
    if long.isEmpty():
        return stage(whole), states
    families = []
    for bits in LEVELS:
        families.append(stage(_joined(long, bits)))
        long = stage(_up(families[-1]))
        if long.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    top = stage(_finished(long))
    known = top.select("conv", "first", "start", "end")
    for family in reversed(families):
        met = family.withColumn("first", F.element_at("parts", 1)["first"]).join(known, ["conv", "first"])
        known = stage(_down(met.select("conv", "parts", "start", "end")))
    return stage(whole.unionByName(top)), states.unionByName(known)


def _edited(stretches: DataFrame, whole: DataFrame, states: DataFrame) -> DataFrame:
    """Stretches with their edits by row, ``row_edits``; the last of a conversation also has its ``tail``."""
    ends = stretches.groupBy("conv").agg(F.max("first").alias("first")).join(whole.select("conv", "tail"), "conv")
    piece = F.get("edits", F.col("start") * STATES + F.col("end"))
    return (
        stretches.join(states, ["conv", "first"])
        .join(ends, ["conv", "first"], "left")
        .select(
            "conv", "first", "last", F.regexp_extract_all(piece, F.lit("[ua]*[KDUA]"), F.lit(0)).alias("row_edits"),
            F.coalesce("tail", F.lit("")).alias("tail"),
        )
    )


class Repair:
    """Repaired conversations, as rows and as a summary.

    Reads ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored, whatever they are called. Null roles and texts
    read as one space; a null ``conv_id`` is a conversation of its own, null turns come first. Rows of one turn are ordered
    by role, then by a digest of their texts; equal rows are duplicates of the first. Empty tables give empty results.
    """

    def __init__(self, rows: DataFrame) -> None:
        self._rows = _read(rows)
        self._faults = stage(_faults(_ordered(self._rows)))
        stretches = stage(_stretches(self._faults))
        matrices = evaluated(stretches.select("symbols").distinct())
        self._stretches = stage(stretches.join(matrices, "symbols"))
        self._whole, states = _solved(self._stretches)
        self._edited = stage(_edited(self._stretches, self._whole, states))

    def summary(self) -> DataFrame:
        """``conv`` (key), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` of each
        conversation that has rows. The audit is as long as the conversation, and so is its row."""
        counts = self._stretches.groupBy("conv").agg(*(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))
        turns = (
            self._faults.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
            .groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
        )
        edits = F.concat(F.array_join("row_edits", ""), F.col("tail"))
        audits = self._edited.groupBy("conv").agg(
            F.array_sort(F.collect_list(F.struct("first", F.translate(edits, "uaUA", "IIRR").alias("edits")))).alias("x")
        ).select("conv", F.array_join("x.edits", "").alias("audit"))
        return (
            self._whole.join(counts, "conv").join(audits, "conv").join(turns, "conv", "left")
            .select(
                "conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
                "illegal", "cost", "audit",
            )
        )

    def rows(self) -> DataFrame:
        """The repaired rows: ``conv`` (key), ``place`` and ``part`` (their order), ``edit`` (K, R or I), ``role``, ``text``."""
        at = F.posexplode("row_edits").alias("n", "edit")
        placed = self._edited.select("conv", (F.col("first")).alias("first"), at).select(
            "conv", (F.col("first") + F.col("n")).alias("place"), "edit"
        )
        tails = self._edited.where("tail != ''").select("conv", F.col("last").alias("place"), F.col("tail").alias("edit"))

        def inserted(rows: DataFrame, part: Column) -> DataFrame:
            own = F.regexp_replace("edit", "[KDUA]", "")
            letter = F.posexplode(F.split(own, "")).alias("n", "letter")
            return rows.where(own != "").select("conv", "place", letter).where("letter != ''").select(
                "conv", "place", (F.col("n") + part).cast("int").alias("part"), F.lit("I").alias("edit"),
                F.when(F.col("letter") == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"),
            )

        letter = F.substring("edit", -1, 1)
        keys = self._faults.select("conv", "place", "turn", "said")
        kept = placed.where(letter != "D").join(keys, ["conv", "place"]).select(
            "conv", "place", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("at_turn"), "said", letter.alias("letter")
        )
        texts = (
            self._rows.select("conv", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("at_turn"), "said", "role", "text")
            .dropDuplicates(["conv", "at_turn", "said"])
        )
        own_role = F.when(F.col("letter") == "U", "user").when(F.col("letter") == "A", "assistant").otherwise(F.col("role"))
        stayed = texts.join(kept, ["conv", "at_turn", "said"]).select(
            "conv", "place", F.lit(100).alias("part"),
            F.when(F.col("letter") == "K", "K").otherwise("R").alias("edit"), own_role.alias("role"), "text",
        )
        return stayed.unionByName(inserted(placed, F.lit(0))).unionByName(inserted(tails, F.lit(200)))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256`` of rows of ``Repair.rows``: of ``role:text`` joined by line feeds.

    A digest takes its bytes one after the other, so one task reads a conversation; it does so row by row and keeps
    nothing but the digest's state.
    """
    ordered = repaired.select("conv", "place", "part", "role", "text").repartition("conv").sortWithinPartitions(
        "conv", "place", "part"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, hashlib.sha256()
        for batch in slices(batches):
            done, sums = [], []
            columns = (batch[n].to_pylist() for n in ("conv", "role", "text"))
            for key, role, text in zip(*columns, strict=True):
                if key == conv:
                    state.update(b"\n")
                else:
                    if conv is not None:
                        done.append(conv)
                        sums.append(state.hexdigest())
                    conv, state = key, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(done, pa.string()), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"]
            )
        if conv is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"]
            )

    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


def report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """A row per conversation of ``every`` (default: ``rows``): ``conv_id``, the summary, and the digest of what is repaired.

    Conversations without rows have zeros, an empty audit, and the digest of nothing.
    """
    found = Repair(rows)
    ids = (rows if every is None else every).select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    nothing = hashlib.sha256().hexdigest()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        ids.join(found.summary(), "conv", "left").join(digests(found.rows()), "conv", "left")
        .select(
            "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
