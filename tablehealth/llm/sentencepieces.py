"""SentencePiece encoding by a table of distinct marked words, and decoding.

White space is written as a marker in front of the word that follows. Where no piece of the vocabulary holds a
marker after another character, no join reaches from one marked word into the next, so a word's pieces do not depend
on its neighbours. A task collects the distinct marked words of some texts, segments each once, and joins the
ids back by the words' positions.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.lines import text_of
from tablehealth.llm.tasks import Recent, ship, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: White space by its Unicode property, and the marker itself.
SPACE = MARK + "\t\n\x0b\x0c\r \x85\xa0                　"
WORDS_AT_ONCE = 200_000


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("byte-by-byte", _byte_by_byte)


class Vocabulary:
    """What the pieces stand for, where texts may be cut, and the segmentation of words.

    For vocabularies that mark a text's beginning, leave its characters as they are, and whose pieces do not cross
    from a word into a marker. Others are refused.
    """

    def __init__(self, path: str) -> None:
        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes, self._marked, self._silent = [], set(), set()
        joined: set[str] = set()
        for number, piece in enumerate(pieces):
            if model.is_byte(number):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(number) or model.is_unused(number):
                self.bytes.append(b"")
                self._silent.add(number)
            elif model.is_unknown(number):
                self.bytes.append(" ⁇ ".encode())
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                if piece.startswith(MARK):
                    self._marked.add(number)
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {number} crosses a marker")
                if len(piece) > 1:
                    joined |= set(piece)
        probe = " ÅﬁÅ  á 　 "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK) or "\n" in joined:
            raise ValueError("the vocabulary rewrites texts, so words cannot be told apart")
        self._ahead = len(model.encode("\n"))
        #: White space that may stand inside a piece of several characters does not begin a word.
        sticky = "".join(c for c in SPACE if c in joined and c != MARK)
        more = f"(?:[{sticky}][{SPACE}]*[^{SPACE}]*)*" if sticky else ""
        self.word = re.compile(f"[{SPACE}]*[^{SPACE}]+{more}|[{SPACE}]+")

    def words(self, text: str) -> Iterator[list[str]]:
        """The marked words of a text, which join to a space and the text, in lists of bounded length."""
        if not text:
            return
        marked = " " + text
        if len(marked) <= WORDS_AT_ONCE:
            yield self.word.findall(marked)
            return
        found = self.word.finditer(marked)
        while part := [m.group() for m in islice(found, WORDS_AT_ONCE)]:
            yield part

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. A line feed in front keeps the word from being marked a second time."""
        found = self._model.encode(["\n" + w for w in words], num_threads=1)
        return [ids[self._ahead :] for ids in found]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids. Bytes that are no UTF-8 become a replacement character each; control ids end them."""
        runs = [list(run) for silent, run in groupby(ids, self._silent.__contains__) if not silent]
        data = [b"".join(map(self.bytes.__getitem__, run)) for run in runs]
        if runs and runs[0][0] in self._marked:
            data[0] = data[0][1:]
        return "".join(x.decode("utf-8", "byte-by-byte") for x in data)


class Table:
    """Ids by marked word. Words in recent use are kept, so that a task rarely segments one again."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._known: Recent = Recent(None, 400_000)

    def _of(self, words: set[str]) -> dict[str, bytes]:
        """The words with their ids; those not known yet are segmented together."""
        found = self._known.held(words)
        fresh = [w for w in words if w not in found]
        for word, ids in zip(fresh, self.vocabulary.segment(fresh), strict=True):
            found[word] = array("i", ids).tobytes()
            self._known.learn(word, found[word])
        return found

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text: distinct words are segmented once, then joined back by position."""
        out = [b""] * len(texts)
        parts = ((k, part) for k, text in enumerate(texts) for part in self.vocabulary.words(text))
        while some := list(islice(parts, 16)):
            ids = self._of(set().union(*(words for _, words in some)))
            for k, words in some:
                out[k] += b"".join(map(ids.__getitem__, words))
        return [np.frombuffer(x, "i4") for x in out]


@lru_cache(maxsize=2)
def table(path: str) -> Table:
    return Table(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array) and ``decoded`` (the text the ids stand for) of every row.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever they are called. A null or empty text has no
    ids and decodes to an empty one. Repeated rows and rows without a ``doc_id`` get rows like others, an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(path)
        for batch in slices(batches, 64):
            ids = own.many(batch["text"].to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([own.vocabulary.decode(x.tolist()) for x in ids], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``. Null ids count as none, a null id in a list is skipped.

    Takes any ids of the vocabulary, not only those of an encoding: control ids are silent, the unknown id is a mark.
    """
    ship(tokens.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(path).vocabulary
        for batch in slices(batches):
            texts = [own.decode([x for x in ids or () if x is not None]) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    schema = T.StructType(
        [T.StructField("doc_id", tokens.schema["doc_id"].dataType), T.StructField("text", T.StringType())]
    )
    return tokens.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
