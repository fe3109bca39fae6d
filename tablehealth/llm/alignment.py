"""Alignment of two tokenizers' tokens over the same texts, by interval coalescing.

Every token covers a range of bytes. All tokens of both sides are sorted by their start, the running maximum of the
ends is taken along, and a group ends where the next start reaches it. Within a group each token of one side is linked
with each of the other.

Both sides end a token in front of white space that follows something else, so texts fall into words that align alone,
and a task aligns each distinct word once. A document is the sum of its words. Counts of linked pairs go through
Spark: each block of texts brings every pair it holds once, and gets the pair's corpus-wide count back.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tablehealth.llm.lines import text_of
from tablehealth.llm.sentencepieces import MARK, SPACE, Vocabulary
from tablehealth.llm.tasks import Recent, ship, slices
from tablehealth.sources.scratch import stage

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is one number: the left id times this, plus the right id.
SIDE = 1 << 31
#: Characters of the texts whose pairs are collected before a block is closed.
BLOCK_CHARS = 1 << 24
BATCH_CHARS = 1 << 21
#: Words that a side encodes as one text.
TOGETHER = 64

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its core


@dataclass
class Groups:
    """Groups in order: tokens of each side per group, and the group each token of each side is in."""

    left: np.ndarray
    right: np.ndarray
    left_of: np.ndarray
    right_of: np.ndarray


def coalesce(
    left_start: np.ndarray, left_end: np.ndarray, right_start: np.ndarray, right_end: np.ndarray
) -> Groups:
    """Groups of overlapping ranges of two sides; ranges are not empty, and in order on each side."""
    start = np.concatenate([left_start, right_start])
    end = np.concatenate([left_end, right_end])
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    first = np.ones(len(order), bool)
    first[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    n = int(first.sum())
    left_of, right_of = group[: len(left_start)], group[len(left_start) :]
    return Groups(np.bincount(left_of, minlength=n), np.bincount(right_of, minlength=n), left_of, right_of)


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` many, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def expand(groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the left and right token of every link, in order of the left tokens."""
    per = groups.right[groups.left_of]
    firsts = np.cumsum(groups.right) - groups.right
    return np.repeat(np.arange(len(per)), per), runs(firsts[groups.left_of], per)


@dataclass(slots=True)
class Word:
    """A word's tokens, groups and links; ``fits`` is false if its tokens spell something else."""

    n_left: int
    n_right: int
    n_groups: int
    groups: str
    pairs: bytes
    fits: bool


_SPOILT = Word(0, 0, 0, "", b"", False)


def _bytes_of_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Words with both sides' tokens aligned. Those in recent use are kept."""

    def __init__(self, left: str, right: str) -> None:
        self._left = Tokenizer.from_file(left)
        self._left.encode_special_tokens = True
        byte = _bytes_of_characters()
        with open(left, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        self._left_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            if all(c in byte for c in entry):
                self._left_bytes[number] = bytes(map(byte.__getitem__, entry))
        self._right = Vocabulary(right)
        self._left_size = np.array(list(map(len, self._left_bytes)), np.int64)
        self._right_size = np.array(list(map(len, self._right.bytes)), np.int64)
        #: Every id as text, with each of the marks that may follow it; left ids first.
        sides = len(self._left_size) + len(self._right_size)
        numbers = [str(k if k < len(self._left_size) else k - len(self._left_size)) for k in range(sides)]
        self._said = [number + mark for mark in (",", "|", ";", "") for number in numbers]
        self.known: Recent = Recent(None, 300_000)

    def words(self, text: str) -> Iterator[list[str]]:
        return self._right.words(text)

    def _texts(self, flat_left: np.ndarray, flat_right: np.ndarray, groups: Groups, last: np.ndarray) -> list[str]:
        """The groups of each word as text; ``last`` counts the groups up to each word's end."""
        side = np.repeat([0, 1], [len(flat_left), len(flat_right)])
        group = np.concatenate([groups.left_of, groups.right_of])
        order = np.argsort(group, kind="stable")  # left tokens stand before right ones
        number = np.concatenate([flat_left, flat_right + len(self._left_size)])[order]
        group, side = group[order], side[order]
        mark = np.zeros(len(order), np.int64)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] - side[:-1])
        ends = np.cumsum(groups.left + groups.right)[last - 1]
        mark[ends - 1] = 3
        tokens = list(map(self._said.__getitem__, (mark * (len(self._said) // 4) + number).tolist()))
        bounds = [0, *ends.tolist()]
        return ["".join(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]

    def align(self, words: list[str]) -> list[Word]:
        """The words aligned. A word begins with white space, so those that end in something else stay apart when they are
        written one after the other, and each side encodes them all in one call."""
        plain = [w for w in words if MARK not in w and w[-1] not in SPACE]
        found = dict(zip(plain, self._together(plain), strict=True))
        for word in words:
            if word not in found:
                found[word] = _SPOILT if MARK in word else self._together([word])[0]
        return [found[w] for w in words]

    def _together(self, words: list[str]) -> list[Word]:
        """Words that may be written one after the other: encoded some at a time, and aligned in one pass over their bytes."""
        if not words:
            return []
        text = "".join(words)
        data = text.encode()
        said = ["".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        encoded = self._left.encode_batch_fast(said, add_special_tokens=False)
        left = list(chain.from_iterable(x.ids for x in encoded))
        right = list(chain.from_iterable(self._right.segment(said)))
        flat_left, flat_right = np.array(left, np.int64), np.array(right, np.int64)
        left_end, right_end = np.cumsum(self._left_size[flat_left]), np.cumsum(self._right_size[flat_right])
        sizes = map(len, words) if len(data) == len(text) else (len(w.encode()) for w in words)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(words)))
        upto_left, upto_right = np.searchsorted(left_end, ends) + 1, np.searchsorted(right_end, ends) + 1
        same = (
            b"".join(map(self._left_bytes.__getitem__, left)) == data
            and b"".join(map(self._right.bytes.__getitem__, right)) == data
            and (left_end[upto_left - 1] == ends).all()
            and (right_end[upto_right - 1] == ends).all()
        )
        if not same:
            return [_SPOILT] if len(words) == 1 else [self._together([w])[0] for w in words]
        groups = coalesce(
            left_end - self._left_size[flat_left], left_end, right_end - self._right_size[flat_right], right_end
        )
        i, j = expand(groups)
        pairs = (flat_left[i] * SIDE + flat_right[j]).tobytes()
        last = groups.left_of[upto_left - 1] + 1
        links = (8 * np.cumsum(groups.left * groups.right)[last - 1]).tolist()
        texts = self._texts(flat_left, flat_right, groups, last)
        counts = zip(*(np.diff(x, prepend=0).tolist() for x in (upto_left, upto_right, last)), strict=True)
        return [
            Word(a, b, n, written, pairs[begin:end], True)
            for (a, b, n), written, begin, end in zip(counts, texts, [0, *links[:-1]], links, strict=True)
        ]

    def table(self, words: set[str]) -> dict[str, Word]:
        """The words with their alignments; those not known yet are aligned together."""
        found = self.known.held(words)
        fresh = [w for w in words if w not in found]
        for at in range(0, len(fresh), 8192):
            part = fresh[at : at + 8192]
            for word, aligned in zip(part, self.align(part), strict=True):
                found[word] = aligned
                self.known.learn(word, aligned)
        return found


@lru_cache(maxsize=2)
def aligner(left: str, right: str) -> Aligner:
    return Aligner(left, right)


@dataclass
class Batch:
    """Some texts: a row of counts and the groups' text for each, and their distinct pairs with how often each occurs."""

    counts: np.ndarray
    groups: list[str]
    doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def align_texts(own: Aligner, texts: list[str]) -> Batch:
    """All the texts' tokens aligned: ``counts`` holds tokens left and right, groups and links."""
    said = [list(own.words(text)) for text in texts]
    words = own.table(set().union(*(part for parts in said for part in parts)))
    table = list(words.values())
    place = {word: k for k, word in enumerate(words)}
    numbers = [array("q", chain.from_iterable(map(place.__getitem__, part) for part in parts)) for parts in said]
    sizes = np.array(list(map(len, numbers)), np.int64)
    number = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in numbers if x)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    fits = np.array([w.fits for w in table], bool)
    spoilt = np.bincount(doc[~fits[number]], minlength=len(texts)) > 0
    write = [w.groups for w in table].__getitem__
    groups = ["" if bad else ";".join(map(write, x)) for bad, x in zip(spoilt.tolist(), numbers, strict=True)]
    keep = ~spoilt[doc]
    doc, number = doc[keep], number[keep]
    counts = np.zeros((len(texts), 4), np.int64)
    links = np.array([len(w.pairs) // 8 for w in table], np.int64)
    per_word = np.array([(w.n_left, w.n_right, w.n_groups) for w in table], np.int64).reshape(-1, 3)
    for k in range(3):
        counts[:, k] = np.bincount(doc, per_word[number, k], len(texts))
    counts[:, 3] = np.bincount(doc, links[number], len(texts))
    pair, local = np.unique(
        np.frombuffer(b"".join(w.pairs for w in table), np.int64), return_inverse=True
    )
    per, firsts = links[number], np.cumsum(links) - links
    key = np.repeat(doc, per) * max(1, len(pair)) + local[runs(firsts[number], per)]
    key.sort()
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(begin, len(key)))
    key = key[begin]
    doc, spot = np.divmod(key, max(1, len(pair)))
    return Batch(counts, groups, doc, pair[spot], times)


def _packed(spots: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places in a block's list of pairs and how often each occurs."""
    return zlib.compress(np.concatenate([np.diff(spots, prepend=0), times]).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i4")
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:].astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """The aligned texts in blocks, in rows of two kinds.

    A row per document: ``block``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (the text
    ``a1,a2|b1;a3|b2,b3``, ids in order), and ``links``, its places in the pairs of the block. A row per block: ``block``,
    ``pairs`` (each once) and ``documents`` (how many of the block hold each). Store the rows before using both kinds.
    """
    ship(docs.sparkSession)
    left, right = left or public_tokenizers.path(LEFT), right or public_tokenizers.path(RIGHT)
    fields = [
        T.StructField("block", T.LongType()),
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *(T.StructField(n, T.LongType()) for n in _COUNTS),
        T.StructField("groups", T.StringType()),
        T.StructField("links", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("documents", T.ArrayType(T.LongType())),
    ]
    names = [f.name for f in fields]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
        """Ids and texts of bounded length together, unless a single text is longer."""
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            begin = size = 0
            for at, text in enumerate(texts):
                if size and size + len(text) > BATCH_CHARS:
                    yield batch["doc_id"].slice(begin, at - begin), texts[begin:at]
                    begin, size = at, 0
                size += len(text)
            yield batch["doc_id"].slice(begin), texts[begin:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(left, right)
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            every = [b.pair for _, b in held]
            pairs, where = np.unique(np.concatenate(every), return_inverse=True)
            documents = np.bincount(where, minlength=len(pairs))
            begin = 0
            for ids, b in held:
                spots = where[begin : begin + len(b.pair)]
                begin += len(b.pair)
                ends = np.cumsum(np.bincount(b.doc, minlength=len(ids)))
                parts = zip(np.split(spots, ends[:-1]), np.split(b.times, ends[:-1]), strict=True)
                packed = [_packed(s, t) for s, t in parts]
                none = pa.nulls(len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), block)), ids, *(pa.array(b.counts[:, k]) for k in range(4)),
                        pa.array(b.groups, pa.string()), pa.array(packed, pa.binary()), none, none,
                    ],
                    names=names,
                )
            empty = [pa.nulls(1, t) for t in (ids.type, *[pa.int64()] * 4, pa.string(), pa.binary())]
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x))
                for x in (pairs, documents)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *empty, *lists], names=names)

        for ids, texts in batches_of(batches):
            if not texts:
                continue
            held.append((ids, align_texts(own, texts)))
            size += sum(map(len, texts))
            if size >= BLOCK_CHARS:
                yield from close()
                block, held, size = block + 1, [], 0
        if held:
            yield from close()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, T.StructType(fields))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best`` (no pair of its left id has more) of stored blocks."""
    each = aligned.where(F.col("pairs").isNotNull()).select(
        F.explode(F.arrays_zip("pairs", "documents")).alias("x")
    )
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("n"))
    counts = stage(counts)
    side = F.shiftright("pair", 31)
    tops = counts.groupBy(side.alias("a")).agg(F.max("n").alias("top"))
    # No more rows than the left vocabulary has entries.
    return counts.join(F.broadcast(tops), side == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("top")).alias("best")
    )


def scores(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``, a row per row.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever they are called. Texts that are null, empty, or not
    spelt alike by both sides have no tokens: zeros and an empty digest. Repeated rows are documents of their own, and
    count as such; so are rows without a ``doc_id``. An empty table gives an empty result.
    """
    digest = F.when(F.col("groups") != "", F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = stage(
        alignments(docs, left, right).select(
            "block", "doc_id", *_COUNTS, digest.alias("groups_sha256"), "links", "pairs", "documents"
        )
    )
    spots = aligned.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("at", "pair"))
    counted = (
        spots.join(pair_counts(aligned), "pair")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("c"))
    )
    given = counted.select(
        "block", F.lit(0).alias("kind"), F.col("c.n").alias("n"), F.col("c.best").alias("best")
    )
    rows = aligned.where(F.col("links").isNotNull()).select(
        "block", F.lit(1).alias("kind"), "doc_id", *_COUNTS, "groups_sha256", "links"
    )
    met = given.unionByName(rows, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    fields = [
        rows.schema["doc_id"],
        *(T.StructField(n, T.LongType()) for n in (*_COUNTS, "n_best", "count_sum")),
        T.StructField("groups_sha256", T.StringType()),
    ]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = best = np.zeros(0, np.int64)
        for batch in slices(batches, 4096):
            kinds = batch["kind"].to_numpy()
            links, n_best, count_sum = batch["links"].to_pylist(), [], []
            for at, kind in enumerate(kinds.tolist()):
                if kind == 0:
                    n = batch["n"][at].values.to_numpy()
                    best = batch["best"][at].values.to_numpy(zero_copy_only=False)
                    continue
                spot, times = _unpacked(links[at])
                n_best.append(int(times[best[spot]].sum()))
                count_sum.append(int((n[spot] * times).sum()))
            keep = batch.filter(pa.array(kinds == 1))
            yield pa.RecordBatch.from_arrays(
                [
                    keep["doc_id"], *(keep[x] for x in _COUNTS), pa.array(n_best, pa.int64()),
                    pa.array(count_sum, pa.int64()), keep["groups_sha256"],
                ],
                names=names,
            )

    return met.mapInArrow(run, T.StructType(fields))
