"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has one encoding, and a sequence of tokens is an encoding exactly if each two
neighbours are (``BytePairs.fitting``). So the last token of each prefix is all that has to be stored: the
token that ends there and fits the last token of the prefix before it. Reading the chain backwards gives the
encoding of any prefix. Appending goes on from the stored tokens, and an edit recomputes them from its place on
until they agree with the old ones again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.lines import text_of
from tablehealth.llm.tasks import Recent, ship, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: White space by its Unicode property, which the tokenizer's pattern means by \s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(
    r"\S", f"[^{_SPACE}]"
)


class _Pairs(Recent):
    """Keys are numbers here."""

    def learn(self, key, value) -> None:
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value


class BytePairs:
    """Tokens by their bytes, and which of them may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        #: What tokens begin with: the rank of what is a token itself, -1 for the rest.
        self.reach = {token[:n]: -1 for token in ranks for n in range(1, len(token))} | ranks
        self.longest, self.highest = max(map(len, ranks)), max(ranks.values())
        self._alone: dict[int, bool] = {}
        self._made: dict[int, tuple[int, int] | None] = {}
        self.fitting = _Pairs(self._check, 400_000)

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The encoding by its definition: join the neighbours of lowest rank, the first of equals.

        Stops early once only ``least`` tokens are left.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > least:
            low, at = min(
                ((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None),
                default=(None, 0),
            )
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose joining makes this one; none for a byte or if its bytes encode otherwise."""
        if token not in self._made:
            ids = self.merged(self.bytes[token], 2)
            self._made[token] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self._made[token]

    def _check(self, pair: int) -> bool:
        """Whether two tokens stay apart, given as ``before << 32 | token``; ``before`` is -1 at the start.

        Goes back through the joins on both sides of their border. The later join is undone first (of equal ones the
        right one, as the left is done first). While the tokens at the border were ``a`` and ``b``, they would have
        been joined if that came before the join just undone.
        """
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if not self._own(b):
            return False
        if a < 0:
            return True
        before = self.highest + 1
        while True:
            joined = self.ranks.get(self.bytes[a] + self.bytes[b])
            if joined is not None and joined < before:
                return False
            left, right = self._parts(a), self._parts(b)
            if left and (not right or a > b):
                before, a = a, left[1]
            elif right:
                before, b = b + 1, right[0]
            else:
                return True

    def _own(self, token: int) -> bool:
        """Whether the token's bytes encode as the token."""
        own = self._alone.get(token)
        if own is None:
            own = self._alone[token] = self.merged(self.bytes[token]) == [token]
        return own


class Prefixes:
    """The last token of every prefix of a growing or edited piece."""

    def __init__(self, pairs: BytePairs, data: bytes = b"") -> None:
        self._pairs, self.data = pairs, b""
        self.last: list[int | None] = [-1]
        self.append(data)

    def _extend(self, first: int, stop: int | None = None) -> None:
        """Fill in the open prefixes that tokens beginning at ``first`` up to ``stop`` reach."""
        reach, fitting = self._pairs.reach.get, self._pairs.fitting
        data, last, size = self.data, self.last, len(self.data)
        for start in range(first, size if stop is None else stop):
            before = last[start] << 32
            for end in range(start + 1, size + 1):
                token = reach(data[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] is None and fitting[before | token]:
                    last[end] = token

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what was stored stays as it is."""
        first = max(0, len(self.data) - self._pairs.longest + 1)
        self.data += more
        self.last += [None] * len(more)
        self._extend(first)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of a range; return how many prefixes had to be computed."""
        longest, old, moved = self._pairs.longest, self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1] + [None] * (len(self.data) - start)
        agree, after = 0, start + len(new)
        for at in range(max(0, start - longest + 1), len(self.data)):
            self._extend(at, at + 1)
            if at + 1 > after:
                agree = agree + 1 if self.last[at + 1] == old[at + 1 - moved] else 0
                if agree >= longest:
                    self.last[at + 2 :] = old[at + 2 - moved :]
                    return at + 1 - start
        return len(self.data) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        at = len(self.data) if end is None else end
        out = []
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self._pairs.bytes[token])
        return out[::-1]


class Encoder:
    """Encodes whole texts, piece by piece of the pattern, and decodes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = BytePairs(ranks)
        self._pattern = regex.compile(PIECES)
        self._known = Recent(self._piece, 400_000)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.pairs.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self.pairs, data).tokens()
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        pieces = self._pattern.findall(text)
        return np.frombuffer(b"".join(map(self._known.__getitem__, pieces)), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pairs.bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array) and ``decoded`` (the bytes the ids stand for) of every row.

    Reads ``doc_id`` and ``text``. A null or empty text has no ids. Repeated rows get equal rows, an empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, 64):
            ids = [own.encode(t) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([own.decode(x) for x in ids], pa.binary()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.BinaryType()),
        ]
    )
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
