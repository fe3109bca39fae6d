"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pieces of one length are alike, so what has to be planned is how often each length goes with which
others: a histogram with at most ``capacity`` entries. The plan is made from it on the driver by
dominance reduction and best fit, and states for each length which ranks go to which sequences. Spark
ranks the pieces within their length and looks their places up.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tablehealth.llm.lines import text_of
from tablehealth.llm.tasks import Recent, ship, slices
from tablehealth.sources.scratch import stage

CAPACITY = 2048
SALTS = 64
VOCABULARY = "word_bpe_49k.json"
END = b"\0\0\0\0"


os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its core
#: Letters that stand alone in normal form and lower to one another, none before a combining mark.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\\x00-\\x7f{_LATIN}]*")
#: What the tokenizer takes plain lower-cased text apart into before it joins.
_PARTS = re.compile(f"[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r 0-9{_LATIN}]+")
AT_ONCE = 4096


def _bytes_of(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Token ids of texts, as little-endian bytes, four for each id.

    The tokenizer never joins what a space or a line feed separates, so words are encoded one by one and remembered.
    It lower-cases and takes a word apart into letters, digits and marks, and joins inside of those parts alone. So words
    of ASCII and Latin letters are taken apart here, and each part is encoded once and remembered. New parts go to
    the tokenizer side by side, as the last token of each can be told from others. A word with any other
    character is encoded as it is, and a text that may spell a special token as a whole.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._words = Recent(self.whole, 400_000)
        self._parts = Recent(self.whole, 300_000)
        self._join = Tokenizer.from_file(path)  # for parts, which are normal already
        self._join.normalizer = normalizers.Sequence([])
        self._join.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(False, use_regex=False)]
        )
        vocabulary = self._tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return _bytes_of(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_bytes_of(x.ids) for x in found]

    def _side_by_side(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that the tokenizer does not take apart any further."""
        lines = [" ".join(parts[at : at + 64]) for at in range(0, len(parts), 64)]
        found = self._join.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            return self._each(parts)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, parts: list[str], encode: Callable[[list[str]], list[bytes]]) -> None:
        for at in range(0, len(parts), AT_ONCE):
            some = parts[at : at + AT_ONCE]
            for part, ids in zip(some, encode(some), strict=True):
                self._parts.learn(part, ids)

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        find, plain = _PARTS.findall, _PLAIN.fullmatch
        words = [
            (t.lower() if plain(t) else t).replace("\n", " ").split(" ") if "<|" not in t else [] for t in texts
        ]
        fresh = self._words.unknown(set().union(*words))
        parts = [find(w.lower()) if plain(w) else None for w in fresh]
        self._learn(self._parts.unknown({p for found in parts if found for p in found}), self._side_by_side)
        self._learn(self._parts.unknown({w for w, found in zip(fresh, parts, strict=True) if found is None}), self._each)
        get = self._parts.__getitem__
        for word, found in zip(fresh, parts, strict=True):
            self._words.learn(word, get(word) if found is None else b"".join(map(get, found)))
        get = self._words.__getitem__
        return [b"".join(map(get, w)) if w else self.whole(t) for w, t in zip(words, texts, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of every piece of every row.

    A document is its token ids and a final 0. Only longer ones than ``capacity`` are cut.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for at, data in enumerate(encode.many(batch["text"].to_pylist())):
                data += END
                for number, first in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[first : first + 4 * capacity]
                    row.append(at)
                    piece.append(number)
                    start.append(first // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            columns = [
                batch["doc_id"].take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, T.StructType(fields))


@dataclass
class Pattern:
    """``count`` sequences that each hold ``times`` pieces of ``size``, for every (size, times)."""

    sizes: tuple[tuple[int, int], ...]
    count: int


def reduce_dominated(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets that dominate all others holding the same piece, and take them out of ``left``.

    ``left[w]`` counts the pieces of length w. A piece goes alone if nothing fits beside it; it goes with
    a partner that fills the sequence exactly; and it goes with its largest fitting partner if no two
    pieces fit beside it. In each case whatever an optimal packing puts beside the piece could be swapped
    for that set. Repeated until nothing changes.
    """
    fixed: list[Pattern] = []

    def take(sizes: dict[int, int], count: int) -> None:
        for size, times in sizes.items():
            left[size] -= times * count
        fixed.append(Pattern(tuple(sorted(sizes.items(), reverse=True)), count))

    changed = True
    while changed:
        changed = False
        for w in np.flatnonzero(left)[::-1].tolist():
            while left[w] > 0:
                rest = left.copy()
                rest[w] -= 1
                there = np.flatnonzero(rest)
                room = capacity - w
                if not len(there) or there[0] > room:
                    take({w: 1}, 1 if len(there) and there[0] == w and w <= room else int(left[w]))
                    changed = True
                    continue
                partner = int(there[np.searchsorted(there, room, "right") - 1])
                second = int(there[0] if rest[there[0]] > 1 else there[1] if len(there) > 1 else capacity)
                if partner != room and there[0] + second <= room:
                    break
                if partner == w:
                    take({w: 2}, int(left[w]) // 2)
                else:
                    take({w: 1, partner: 1}, int(min(left[w], left[partner])))
                changed = True
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest pieces first: each goes where the least room stays."""
    open_: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for w in np.flatnonzero(left)[::-1].tolist():
        n = int(left[w])
        while n:
            room = next((r for r in range(w, capacity + 1) if open_[r]), None)
            if room is None:
                pattern, room, count = (), capacity, n
            else:
                last = open_[room].pop()
                pattern, count = last.sizes, last.count
            each = min(room // w, n)
            used = min(count, n // each)
            open_[room - each * w].append(Pattern((*pattern, (w, each)), used))
            if pattern and count > used:
                open_[room].append(Pattern(pattern, count - used))
            n -= each * used
    return [p for found in open_ for p in found]


@dataclass
class Plan:
    """Places by length and rank: sorted keys, and what holds from each key on."""

    keys: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    RANKS = 44

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << self.RANKS) + rank, "right") - 1
        inside = rank - self.first[at]
        return (
            self.sequence[at] + inside // self.times[at],
            self.offset[at] + inside % self.times[at] * length,
        )


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = reduce_dominated(left, capacity)
    patterns += best_fit(left, capacity)
    rank = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for size, times in p.sizes:
            rows.append(((size << Plan.RANKS) + rank[size], rank[size], times, sequence, offset))
            rank[size] += times * p.count
            offset += size * times
        sequence += p.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(table[:, i].copy() for i in range(5)), sequences=sequence)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    Ranks within a length are counted in ``SALTS`` parts that follow one another, so a length that a
    third of all pieces have is ranked by that many tasks.
    """
    ship(cut.sparkSession)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    part = Window.partitionBy("length", "salt")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = F.row_number().over(part.orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (
        salted.withColumn("inside", inside)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("inside"))
        .select(*cut.columns, "rank")
    )
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, capacity)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    fields = [
        *cut.schema.fields,
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
    return ranked.mapInArrow(look_up, T.StructType(fields))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Where each piece of each document goes: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``.

    Reads ``doc_id`` and ``text``. A null or empty text is the final id alone. Repeated rows and rows
    without a ``doc_id`` are packed like others. An empty table gives an empty result.
    """
    return place(stage(pieces(docs, capacity, path)), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (little-endian 32-bit), ``doc_ids``."""
    placed = place(stage(pieces(docs, capacity, path, with_ids=True)), capacity)
    return (
        placed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
        .select(
            "sequence_id",
            F.aggregate(
                "parts", F.lit(b""), lambda total, part: F.concat(total, part["ids"])
            ).alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"),
        )
    )
