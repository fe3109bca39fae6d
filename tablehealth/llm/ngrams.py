"""Language-model scores from an n-gram trie in Elias-Fano code.

Level 1 holds the hashes of all training words in order, with their counts. A deeper level holds, parent after parent,
the words that follow each n-gram of the level above: monotone pointers to where a parent's words begin, the words
made monotone by adding the last value before them, and the smoothed probabilities in eight bits. A
lookup searches the successor of ``word + base`` between two pointers. Levels are counted and written by Spark in shards
of the shared folder, one range of keys each, and tasks map them instead of loading them.

An n-gram goes through one shuffle: tasks send each shard sorted, packed blocks of different keys with their counts, and the
shard's task merges them and writes its file. Ranges follow from the counts of the level above. A word or n-gram whose
followers lie in several shards gets its ``b`` from the driver, which sums up the shards' shares.

Probabilities are interpolated: ``P(w | context) = a + b * P(w | shorter context)`` with the absolute discount in
``a``, and in ``b`` what is left of the context's mass. The shortest context is the smoothed unigram.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.eliasfano import EliasFano, load, packed, save, unpacked
from tablehealth.llm.lines import text_of
from tablehealth.llm.tasks import ship
from tablehealth.llm.toxicity import fold
from tablehealth.sources.scratch import shared_folder

ORDER = 3
MIN_COUNT = 3
DISCOUNT = 0.75
SMOOTHING = 0.1
FOLDS = 10
END = b"\n"  # not a word, as words hold no white space
CHUNK = 2_000_000
SLICE = 800_000
SLICE_BYTES = 4_000_000
SHARD = 2_000_000  # tokens whose n-grams share a shard, about
STEP = 1 << 12  # neighbours in a shard that share the step of their eight bits
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.array([chr(c) in " \t\n\v\f\r" for c in range(256)])
_MANY = 255


def _tokens(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Each token as its place in a list of different words, that list, and how many tokens each text has."""
    coded = [t.encode() for t in texts]
    chars = np.frombuffer(END.join([*coded, b""]).translate(_LOWER), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in coded], dtype=np.int64) - 1
    blank = _BLANK[chars]
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[ends] = True
    kept = ~blank
    kept[ends] = True
    sizes = np.diff(np.searchsorted(np.flatnonzero(begins), ends, "right"), prepend=0)
    starts = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int64)
    buffers = [None, pa.py_buffer(starts), pa.py_buffer(chars[kept])]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist(), sizes


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


class Shard:
    """One mapped file of a level."""

    def __init__(self, uri: str) -> None:
        numbers, arrays = load(uri)
        self.words = unpacked("words", numbers, arrays)
        self._counts, self._many_at, self._many = (arrays.get(x) for x in ("counts", "many_at", "many"))
        if "first" in numbers:
            self.first, self.parents = numbers["first"], numbers["parents"]
            self.starts = unpacked("starts", numbers, arrays)
            self.a, self.b = ((arrays[x], arrays[f"{x}.steps"]) for x in "ab")

    def counts(self, at: np.ndarray) -> np.ndarray:
        out = self._counts[at].astype(np.int64)
        many = np.flatnonzero(out == _MANY)
        out[many] = self._many[np.searchsorted(self._many_at, at[many])]
        return out

    def children(self, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each word among the parent's (-1: not there), ``a`` and ``b``."""
        at, a, b = np.full(len(parent), -1, np.int64), np.zeros(len(parent)), np.ones(len(parent))
        own = np.flatnonzero((parent >= self.first) & (parent < self.first + self.parents))
        local = parent[own] - self.first
        run = np.diff(local, prepend=-1) != 0  # equal parents side by side are looked up once
        each, local = np.cumsum(run) - 1, local[run]
        b[own] = _restored(*self.b, local)[each]
        start = self.starts.access(local).astype(np.int64)
        end = self.starts.access(local + 1).astype(np.int64)
        base = np.zeros(len(local), np.uint64)
        inside = start > 0
        base[inside] = self.words.access(start[inside] - 1)
        known = word[own] >= 0
        own, each = own[known], each[known]
        at[own] = self.words.find(word[own].astype(np.uint64) + base[each], start[each], end[each])
        hit = np.flatnonzero(at >= 0)
        a[hit] = _restored(*self.a, at[hit])
        return at, a, b


class Trie:
    """All shards of all levels, each mapped when it is first needed. ``meta`` is what the driver knows of them."""

    def __init__(self, meta: dict) -> None:
        self.total, self.words = meta["total"], meta["words"]
        v = max(1, self.words)
        self._levels = [
            {
                "first": np.array([s["first"] for s in level], np.uint64 if at == 0 else np.int64),
                "begins": np.array([s["first"] // v for s in level], np.int64 if at else np.uint64),
                "last": np.array([s["last"] for s in level], np.int64),
                "offset": np.cumsum([0, *(s["n"] for s in level)]),
                "uris": [s["uri"] for s in level],
                "split": np.array([p for p, _ in split], np.int64),
                "left": np.array([x for _, x in split], float),
            }
            for at, (level, split) in enumerate(zip(meta["levels"], meta["split"], strict=True))
        ]
        self._shard = lru_cache(maxsize=None)(Shard)

    def _by_shard(self, level: dict, route: np.ndarray) -> Iterator[tuple[int, Shard, np.ndarray]]:
        if len(level["uris"]) < 1 << 15:
            route = route.astype(np.int16)  # sorted by its digits
        order = np.argsort(route, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(route[order])) + 1):
            if len(part) and route[part[0]] >= 0:
                k = int(route[part[0]])
                yield k, self._shard(level["uris"][k]), part

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; -1 for those that training has not seen."""
        level, out = self._levels[0], np.full(len(words), -1, np.int64)
        hashes = _hashes(words)
        route = np.searchsorted(level["first"], hashes, "right") - 1
        for k, shard, part in self._by_shard(level, route):
            code = shard.words
            zero = np.zeros(len(part), np.int64)
            at = code.find(hashes[part], zero, zero + code.n)
            out[part] = np.where(at >= 0, at + level["offset"][k], -1)
        return out

    def counts(self, depth: int, index: np.ndarray) -> np.ndarray:
        """Counts of the n-grams at these places of a level; 0 for -1."""
        level, out = self._levels[depth - 1], np.zeros(len(index), np.int64)
        route = np.where(index >= 0, np.searchsorted(level["offset"], index, "right") - 1, -1)
        for k, shard, part in self._by_shard(level, route):
            out[part] = shard.counts(index[part] - level["offset"][k])
        return out

    def children(self, depth: int, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in level ``depth``, ``a`` and ``b`` for parents of the level above; equal pairs are looked up once."""
        level, v = self._levels[depth - 1], max(1, self.words)
        keys, back = np.unique(parent * (v + 1) + word + 1, return_inverse=True)
        parent, word = keys // (v + 1), keys % (v + 1) - 1
        at, a, b = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        if len(level["first"]):
            route = np.searchsorted(level["first"], parent * v + np.maximum(word, 0), "right") - 1
            after = np.minimum(route + 1, len(level["last"]) - 1)
            begins = level["begins"][after] == parent
            ended = (route < 0) | (parent > level["last"][np.maximum(route, 0)])
            route = np.where(begins & ended, after, route)  # its words begin in the next shard
            for k, shard, part in self._by_shard(level, route):
                found, a[part], b[part] = shard.children(parent[part], word[part])
                at[part] = np.where(found >= 0, found + level["offset"][k], -1)
        if len(level["split"]):
            place = np.minimum(np.searchsorted(level["split"], parent), len(level["split"]) - 1)
            b = np.where(level["split"][place] == parent, level["left"][place], b)
        return at[back], a[back], b[back]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        return (self.counts(1, ids) + SMOOTHING) / (self.total + SMOOTHING * (self.words + 1))

    @property
    def depth(self) -> int:
        return len(self._levels)


@lru_cache(maxsize=2)
def trie(meta: str) -> Trie:
    return Trie(json.loads(meta))


def contexts(own: Trie, ids: np.ndarray, first: np.ndarray, depth: int) -> Iterator[tuple]:
    """For each level from 2 to ``depth``: its parent at every token (-1: none), places, ``a`` and ``b``.

    ``first`` is true at the first token of a text, where no context reaches back.
    """
    state = ids
    for level in range(2, depth + 1):
        parent = np.where(first, -1, np.r_[-1, state[:-1]]) if len(state) else state
        some = np.flatnonzero(parent >= 0)
        at, a, b = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
        at[some], a[some], b[some] = own.children(level, parent[some], ids[some])
        yield parent, at, a, b
        state = at


def _portions(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows with about ``most`` bytes of this column at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch[name]).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.cumsum(sizes) // most
        for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(parts)) + 1):
            if len(rows):
                yield batch.slice(int(rows[0]), len(rows))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Word numbers of several texts, how many each has, and the rows; about ``SLICE`` numbers at a time."""
    for part in _portions(batches, "ids", 4 * SLICE):
        sizes = pc.binary_length(part["ids"]).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        yield np.frombuffer(b"".join(part["ids"].to_pylist()), "<i4").astype(np.int64), sizes, part


def _first(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


BLOCK = "shard int, size int, keys binary, counts binary"


def _pressed(values: np.ndarray) -> bytes:
    """Eight-byte numbers byte by byte of all, so that the leading ones of small numbers take no room."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _opened(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, each with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Different keys in order, with their counts, as a row for each shard that has some. ``bounds``: the shards' ends."""
    rows = [
        (shard, b - a, _pressed(np.diff(keys[a:b], prepend=keys.dtype.type(0))), _pressed(counts[a:b]))
        for shard, (a, b) in enumerate(pairwise([0, *np.searchsorted(keys, bounds).tolist(), len(keys)]))
        if a < b
    ]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "size", "keys", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a shard's blocks in order, and their counts."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([np.cumsum(_opened(r["keys"], r["size"]), dtype=np.uint64) for r in rows])
    counts = np.concatenate([_opened(r["counts"], r["size"]).astype(np.int64) for r in rows])
    return _summed(keys, counts)


def _word_blocks(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        return _blocks(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))), bounds)

    for part in _portions(batches, "text", SLICE_BYTES):
        places, words, _ = _tokens(part["text"].to_pylist())
        held.append((_hashes(words), np.bincount(places, minlength=len(words))))
        if sum(len(keys) for keys, _ in held) >= CHUNK:
            yield out()
            held.clear()
    if held:
        yield out()


def _code(values: np.ndarray, name: str, numbers: dict, arrays: dict) -> None:
    more = packed(name, EliasFano.build(values))
    numbers |= more[0]
    arrays |= more[1]


def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, and apart from them those that need more."""
    many = np.flatnonzero(counts >= _MANY)
    return {"counts": np.minimum(counts, _MANY).astype(np.uint8), "many_at": many, "many": counts[many]}


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bits for each value in (0, 1], rounded down on a logarithmic scale, and the step of each ``STEP`` values."""
    bits = -np.log2(np.maximum(x, 2.0**-60))
    steps = np.maximum(np.maximum.reduceat(bits, np.arange(0, len(bits), STEP)), 1e-6) / 255
    each = np.repeat(steps, STEP)[: len(bits)]
    return np.minimum(np.ceil(bits / each - 1e-9), 255).astype(np.uint8), steps


def _restored(codes: np.ndarray, steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.exp2(-steps[at // STEP] * codes[at])


def _cuts(counts: np.ndarray, step: int) -> list[tuple[int, float, float]]:
    """Cuts a shard's n-grams into parts of at most about ``step`` tokens: where each begins, and how many it has.

    A part begins at an n-gram, or at that share of its followers.
    """
    ends = np.cumsum(counts)
    parts = -(-int(ends[-1]) // step)
    targets = ends[-1] * np.arange(parts) / parts
    at = np.searchsorted(ends, targets, "right")
    share = (targets - (ends[at] - counts[at])) / counts[at]
    return [(i, x, float(ends[-1] / parts)) for i, x in zip(at.tolist(), share.tolist(), strict=True)]


def _bounds(level: list[dict], v: int, most: int) -> np.ndarray:
    """Keys at which the shards of the next level end, so that each has at most about ``most`` tokens."""
    found, offset, held = [], 0, 0.0
    for shard in level:
        for at, share, tokens in shard["cuts"]:
            if held and held + tokens > most:
                found.append((offset + at) * v + int(share * v))
                held = 0.0
            held += tokens
        offset += shard["n"]
    return np.array(found, np.uint64)


def _split(level: list[dict]) -> list[tuple[int, float]]:
    """The parents whose words lie in several shards, each with what is left of its mass."""
    kept, mass, shards = Counter(), {}, Counter()
    for shard in level:
        for parent, part, whole in shard["ends"]:
            kept[parent] += part
            mass[parent] = whole
            shards[parent] += 1
    return [(p, _left(kept[p] / mass[p])) for p in sorted(shards) if shards[p] > 1]


def _left(kept):
    return np.maximum(1 - kept, 2.0**-40)


def _written(folder: str, level: int, numbers: dict, arrays: dict, known: dict) -> pa.RecordBatch:
    uri = f"{folder}/level-{level}-{uuid.uuid4().hex}"
    save(uri, numbers, arrays)
    return pa.RecordBatch.from_arrays([pa.array([json.dumps({"uri": uri, **known})])], names=["shard"])


def _shards(blocks: DataFrame, shards: int, write) -> list[dict]:
    """Write the blocks of each range of keys as a shard; what the driver has to know of them."""
    dealt = blocks.repartitionById(shards, F.col("shard"))
    found = [json.loads(r["shard"]) for r in dealt.mapInArrow(write, "shard string").collect()]
    return sorted(found, key=lambda s: s["first"])


def number(docs: DataFrame, known: str) -> DataFrame:
    """``doc_id``, ``held_out`` and ``ids``: each token of each row as its word's number, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(known)
        for batch in _portions(batches, "text", SLICE_BYTES):
            places, words, sizes = _tokens(batch["text"].to_pylist())
            ids = own.ids(words).astype("<i4")[places]
            ends = np.cumsum(sizes)
            data = [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(data, pa.binary())], names=["doc_id", "held_out", "ids"]
            )

    if json.loads(known)["words"] >= 1 << 31:
        raise ValueError("more than two thousand million different words do not fit the numbers")
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
    ]
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    found = docs.mapInArrow(run, T.StructType(fields))
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> tuple[str, DataFrame]:
    """Count and write the trie of the texts that are not held out.

    ``docs`` holds ``doc_id``, ``held_out`` and ``text``. Returns the trie's description, for ``trie``, and the numbered
    texts of all rows, which are made once and read by every level. Longer n-grams than words are kept if they occur at
    least ``min_count`` times. One can only do so if the n-grams in it do, so others are never counted.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}"
    texts = docs.where(~F.col("held_out")).select("text")

    most, step = SHARD, max(1, SHARD // 4)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _merged(batches)
        if len(keys):
            numbers, arrays = {}, _small(n)
            _code(keys, "words", numbers, arrays)
            total = {"first": int(keys[0]), "last": 0, "n": len(n), "total": int(n.sum()), "cuts": _cuts(n, step)}
            yield _written(folder, 1, numbers, arrays, total)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    words = texts.mapInArrow(lambda batches: _word_blocks(batches, bounds), BLOCK)
    meta: dict = {"levels": [_shards(words, parts, write_words)], "split": [[]]}
    meta["words"] = sum(s["n"] for s in meta["levels"][0])
    meta["total"] = sum(s["total"] for s in meta["levels"][0])
    v = max(1, meta["words"])
    numbered = number(docs, _told(meta))
    learned = numbered.where(~F.col("held_out"))
    for level in range(2, order + 1):
        known, ends = _told(meta), _bounds(meta["levels"][-1], v, most)

        def count(batches: Iterator[pa.RecordBatch], known=known, ends=ends, level=level) -> Iterator[pa.RecordBatch]:
            own, held, size = trie(known), [], 0

            def out() -> pa.RecordBatch:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                return _blocks(keys.astype(np.uint64), counts, ends)

            for ids, sizes, _ in _numbered(batches):
                first, state = _first(sizes), ids
                for _, at, _, _ in contexts(own, ids, first, level - 1):
                    state = at
                often = own.counts(level - 1, state) >= min_count if min_count > 1 else state >= 0
                good = ~first & often & np.r_[False, often[:-1]]
                place = np.flatnonzero(good)
                held.append(state[place - 1] * v + ids[place])
                size += len(place)
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

        def write(batches: Iterator[pa.RecordBatch], known=known, level=level) -> Iterator[pa.RecordBatch]:
            keys, n = _merged(batches)
            keys, n = keys[n >= min_count].astype(np.int64), n[n >= min_count]
            if not len(keys):
                return
            parent, word = np.divmod(keys, v)
            groups = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            own, sizes = parent[groups], np.diff(groups, append=len(keys))
            first, last = int(own[0]), int(own[-1])
            starts = np.searchsorted(parent - first, np.arange(last - first + 2))
            top = word[groups + sizes - 1]
            before = np.repeat(np.cumsum(top) - top, sizes)
            mass = trie(known).counts(level - 1, own).astype(float)
            kept = np.add.reduceat(n, groups) - sizes * DISCOUNT
            left = np.ones(last - first + 1)
            left[own - first] = _left(kept / mass)
            numbers, arrays = {"first": first, "parents": len(left)}, _small(n) if level < order else {}
            arrays["a"], arrays["a.steps"] = _quantised((n - DISCOUNT) / np.repeat(mass, sizes))
            arrays["b"], arrays["b.steps"] = _quantised(left)
            _code((word + before).astype(np.uint64), "words", numbers, arrays)
            _code(starts.astype(np.uint64), "starts", numbers, arrays)
            edges = [(int(own[i]), float(kept[i]), float(mass[i])) for i in sorted({0, len(own) - 1})]
            total = {"first": int(keys[0]), "last": last, "n": len(n), "ends": edges, "cuts": _cuts(n, step)}
            yield _written(folder, level, numbers, arrays, total)

        grams = learned.select("ids").mapInArrow(count, BLOCK)
        meta["levels"].append(_shards(grams, len(ends) + 1, write))
        meta["split"].append(_split(meta["levels"][-1]))
    return _told(meta), numbered


def _told(meta: dict) -> str:
    """What the tasks need of it."""
    levels = [[{k: s[k] for k in ("uri", "first", "last", "n")} for s in level] for level in meta["levels"]]
    return json.dumps(meta | {"levels": levels})


def score_tokens(own: Trie, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: known tokens, log10 of the unigram and of the whole model's probability."""
    starts = np.cumsum(sizes) - sizes
    base = own.unigram(ids)
    chance = base
    for _, _, a, b in contexts(own, ids, _first(sizes), own.depth):
        chance = a + b * chance
    total = [np.add.reduceat(np.log10(x), starts) for x in (base, chance)]
    return np.add.reduceat((ids >= 0).astype(np.int64), starts), *total


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Reads ``doc_id`` and ``text``; learns from the rows that are not held out. A null or empty text is the end token
    alone. A null ``doc_id`` is not held out. Repeated rows count each time and get equal rows; an empty table
    gives an empty result. If all rows are held out every token is unknown.
    """
    held = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    meta, numbered = train(docs.select("doc_id", held, text_of().alias("text")), order, min_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(meta)
        for ids, sizes, batch in _numbered(batches):
            known, base, full = score_tokens(own, ids, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["held_out"], pa.array(sizes.astype(np.int64)), pa.array(known),
                    pa.array(np.full(len(sizes), own.total)), pa.array(base), pa.array(full),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("held_out", T.BooleanType()),
        *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score")),
    ]
    return numbered.mapInArrow(run, T.StructType(fields))
