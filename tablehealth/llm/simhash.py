"""SimHash near-dedup: fingerprints, links between close ones, components of the links.

Two codes within four bits of each other agree in at least two of six segments. So each distinct
code is filed under every pair of its segments, and only codes of one file are compared, on bit
planes (see ``bitslice``). Documents with equal codes are one code here, so copies cost nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.bitslice import bucket_links
from tablehealth.llm.components import components
from tablehealth.llm.lines import text_key, text_of, unused
from tablehealth.llm.tasks import ship, slices
from tablehealth.sources.scratch import stage

RADIUS = 4
SHINGLE = 4
SEGMENTS = (11, 11, 11, 11, 10, 10)
BLOCK = 20_000
CHUNK = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str, size: int = SHINGLE) -> list[bytes]:
    """Word shingles of the lower-cased text; the whole sequence when it has fewer words."""
    words = text.encode().translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    return [whole[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]


def fingerprint(text: str) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes have it set."""
    parts = shingles(text)
    if not parts:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        rows = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(parts), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"], pa.array(codes.view(np.int64))],
            names=["doc_id", "text_key", "code"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and ``code`` (the fingerprint as a signed long) of every row."""
    ship(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("text_key", T.BinaryType()),
            T.StructField("code", T.LongType()),
        ]
    )
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        _fingerprints, schema
    )


def _filed(codes: DataFrame) -> DataFrame:
    """``bucket`` and ``code``, one row for each pair of segments."""
    lows = np.cumsum((0, *SEGMENTS[:-1])).tolist()
    parts = [
        F.shiftrightunsigned("code", low).bitwiseAND((1 << n) - 1)
        for low, n in zip(lows, SEGMENTS, strict=True)
    ]
    files = [
        F.lit(k << 22) + F.shiftleft(parts[i], 11) + parts[j]
        for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2))
    ]
    return codes.select("code", F.explode(F.array(*files)).alias("bucket"))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close codes of each file; rows come sorted by file, and files are handled many at a time."""
    held: list[np.ndarray] = []
    rows = 0

    def flush(table: np.ndarray) -> pa.RecordBatch:
        same = (table[1:, :3] == table[:-1, :3]).all(axis=1)
        number = np.cumsum(np.r_[0, ~same])
        a, b = bucket_links(table[:, 3].copy().view(np.uint64), number, RADIUS)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(
            np.stack([batch[n].to_numpy() for n in ("bucket", "low", "high", "code")], axis=1)
        )
        rows += batch.num_rows
        if rows >= CHUNK:
            table = np.concatenate(held)
            last = int(np.flatnonzero((table[:, :3] != table[-1, :3]).any(axis=1))[-1:].sum())
            if last:
                yield flush(table[: last + 1])
                table = table[last + 1 :]
            held, rows = [table], len(table)
    if rows:
        yield flush(np.concatenate(held))


def links(codes: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of close codes, enough of them to connect all that are connected.

    ``codes`` holds distinct codes. A file of more than ``BLOCK`` codes is dealt out as pairs of
    blocks, so that no task holds more than two blocks of a file at once.
    """
    ship(codes.sparkSession)
    filed = _filed(codes)
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("code"), F.col("blocks"))
    other = F.explode(
        F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
            F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own"))
        )
    )
    dealt = (
        filed.join(sizes, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("bucket", "code", "own", other.alias("other"))
        .select(
            "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "code",
        )
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )
    return dealt.mapInArrow(_links, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``code`` and ``component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` that a chain of links reaches. Reads ``doc_id`` and
    ``text``. A null text is empty; texts without a word have the fingerprint zero and are linked like
    others. Repeated rows get equal rows. A null ``doc_id`` names no component, so it is null only where
    no row of the component has an id. An empty table gives an empty result.
    """
    found = stage(fingerprints(docs))
    codes = stage(found.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(codes), "simhash")
    rooted = codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("code", "root").join(least, "root").select("code", "component_id")
    return found.join(named, "code").select("doc_id", "text_key", "code", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that give their component its id, once each, with all their columns.

    Rows without a ``doc_id`` stay, as no component is named after them. Other columns pass through, whatever they are
    called.
    """
    first = (
        classes(docs).where("doc_id = component_id")
        .select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")).distinct()
    ).alias("first")
    key = unused(docs, "text_key")
    keyed = docs.withColumn(key, text_key(text_of())).alias("doc")
    same = (F.col("doc.doc_id") == F.col("first.first_id")) & (F.col(f"doc.{key}") == F.col("first.first_key"))
    named = keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", key])
    return named.unionByName(keyed.where("doc_id is null")).drop(key)
