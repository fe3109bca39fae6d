"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is logistic in its distinct words and their beginnings, and a document is toxic unless all of its sentences are not
(noisy-or). The weights are fitted in numpy on the labels of a bounded sample of documents; each sentence gets its
share of the gradient, so the sentences that make a document toxic are found without ever being labelled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.lines import text_key, text_of
from tablehealth.llm.tasks import Recent, ship, slices

SAMPLE = 8000
#: Characters of the sampled texts together; texts beyond it in the order of their hash are not learned from.
SAMPLE_CHARS = 64_000_000
MIN_DOCUMENTS = 5
ROUNDS = 400
EVIDENCE = 6.63  # of a chi-square with one degree of freedom: one in a hundred by chance
PREFIXES = (3, 4, 5, 6)
RESTRAINT = 1e-5
FOLDS = 5

_SENTENCE = re.compile(r"[^.!?\n]+")
#: Bytes of a text: sentence ends become line feeds, other ASCII marks and digits become spaces.
_MARKS = bytes(
    10 if chr(c) in ".!?\n" else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)
)


def sentences_of(text: str) -> list[list[bytes]]:
    """The distinct words of every sentence that has any."""
    parts = text.lower().encode().translate(_MARKS).split(b"\n")
    return [sorted(set(words)) for words in (p.split() for p in parts) if words]


def traits(word: bytes) -> list[bytes]:
    """The word and its beginnings of a few letters."""
    text = word.decode(errors="replace")
    return [word, *(b"^" + text[:n].encode() for n in PREFIXES if len(text) >= n)]


class Model:
    """Weights of traits, and the score of a sentence without any, before the logistic function."""

    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._known = Recent(self.word)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def word(self, word: bytes) -> float:
        return sum(self.weights.get(t, 0.0) for t in traits(word))

    def sentence(self, words: list[bytes]) -> float:
        return self.bias + sum(map(self._known.__getitem__, words))

    def document(self, text: str) -> float:
        """Probability that some sentence is toxic; 0 for a text without words."""
        parts = sentences_of(text)
        if not parts:
            return 0.0
        z = np.array([self.sentence(p) for p in parts])
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def worst(self, text: str) -> tuple[int, int, float] | None:
        """Start, end and score of the most toxic sentence."""
        best = None
        for m in _SENTENCE.finditer(text):
            for words in sentences_of(m.group())[:1]:
                score = float(1 / (1 + np.exp(-self.sentence(words))))
                if best is None or score > best[2]:
                    best = (m.start(), m.end(), score)
        return best


def evidence(toxic: np.ndarray, seen: np.ndarray, all_toxic: float, n: int) -> np.ndarray:
    """Likelihood ratio (G) of labels that depend on a trait against labels that do not."""

    def part(found: np.ndarray, rows: np.ndarray, share: float) -> np.ndarray:
        return found * np.log(np.maximum(found, 1e-300) / np.maximum(rows * share, 1e-300))

    rate, rest = all_toxic / n, n - seen
    return 2 * (
        part(toxic, seen, rate) + part(seen - toxic, seen, 1 - rate)
        + part(all_toxic - toxic, rest, rate) + part(rest - all_toxic + toxic, rest, 1 - rate)
    )


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model:
    """Fit by Adam on the noisy-or likelihood, with a penalty on large weights.

    Traits get a weight if the likelihood ratio of their share of toxic documents against that of all others reaches
    ``EVIDENCE``, at any base rate and whether they speak for toxic or for harmless texts.
    """
    pool: dict[bytes, bytes] = {}  # one object for each word
    docs = [[[pool.setdefault(w, w) for w in s] for s in sentences_of(t)] for t in texts]
    y = np.array(labels, float)
    if not any(docs) or not 0 < y.sum() < len(y):
        rate = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log(rate + 1e-3) - np.log(1 - rate + 1e-3)) if rate else -20.0)
    words = {w: i for i, w in enumerate(sorted({w for d in docs for s in d for w in s}))}
    own = {w: traits(w) for w in words}
    seen, toxic = Counter(), Counter()
    for d, label in zip(docs, labels, strict=True):
        here = {t for s in d for w in s for t in own[w]}
        seen.update(here)
        if label:
            toxic.update(here)
    often = sorted(t for t, n in seen.items() if n >= MIN_DOCUMENTS)
    ratio = evidence(
        np.array([toxic[t] for t in often], float), np.array([seen[t] for t in often], float), y.sum(), len(y)
    )
    told = [t for t, g in zip(often, ratio.tolist(), strict=True) if g >= EVIDENCE]
    index = {t: i for i, t in enumerate(told)}
    links = np.array([(i, index[t]) for w, i in words.items() for t in own[w] if t in index])
    links = links.astype(np.int64).reshape(-1, 2)
    telling = set(links[:, 0].tolist())
    flat = [
        (words[w], at)
        for at, s in enumerate(s for d in docs for s in d)
        for w in s
        if words[w] in telling
    ]
    word, sentence = np.array(flat, np.int64).reshape(-1, 2).T
    doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    w = np.zeros(len(index) + 1)
    w[-1] = -np.log(len(doc_of) / y.sum())
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        of_word = np.bincount(links[:, 0], w[links[:, 1]], len(words))
        z = w[-1] + np.bincount(sentence, of_word[word], len(doc_of))
        total = np.bincount(doc_of, np.logaddexp(0, z), len(y))
        pull = np.where(y > 0, 1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), -1.0)
        push = pull[doc_of] / (1 + np.exp(-z))
        by_word = np.bincount(word, push[sentence], len(words))
        grad = np.bincount(links[:, 1], by_word[links[:, 0]], len(index))
        grad = np.append(grad, push.sum()) / len(y)
        grad[:-1] -= RESTRAINT * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    weights = {k: float(w[i]) for k, i in index.items() if abs(w[i]) > 0.02}
    return Model(weights, float(w[-1]))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` labelled texts of the training folds, of ``chars`` characters together.

    Ids are picked by their hash, and of each id every text once, in the order of a hash: at most ``sample`` sizes come to
    the driver, then the texts that fit.
    """
    known = (
        labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .where(fold(F.col("doc_id"), FOLDS) != 0)
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", text_of().alias("text")).join(picked, "doc_id").select(
        "doc_id", "text", "toxic", text_key(F.col("text")).alias("key")
    )
    sizes = (
        texts.groupBy("doc_id", "key").agg(F.max(F.length("text")).alias("size"))
        .orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(sample).collect()
    )
    fits = [r for r, total in zip(sizes, accumulate(r["size"] for r in sizes), strict=True) if total <= chars]
    if not fits:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["key"]) for r in fits], T.StructType([texts.schema["doc_id"], texts.schema["key"]])
    )
    # Texts are hashed once more, as a row for each of the few pairs is wanted however often it occurs.
    rows = (
        texts.join(chosen, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key")
        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row, and where its worst sentence is
    (``worst_start``, ``worst_end``, ``worst_score``) if it is predicted toxic.

    Reads ``doc_id`` and ``text``; of ``labels`` ``doc_id`` and ``toxic``. A null or empty text scores 0. A null
    ``doc_id`` is not held out and never learned from. Repeated rows get equal rows; an empty table gives an
    empty result. Without both labels in the sample every text gets the same score.
    """
    ship(docs.sparkSession)
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            scores = [model.document(t) for t in texts]
            worst = [
                (model.worst(t) or (None,) * 3) if s >= 0.5 else (None,) * 3
                for t, s in zip(texts, scores, strict=True)
            ]
            starts, ends, values = zip(*worst, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(values, pa.float64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"],
            )

    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("worst_start", T.LongType()),
        T.StructField("worst_end", T.LongType()),
        T.StructField("worst_score", T.DoubleType()),
    ]
    held = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    return docs.select("doc_id", held, text_of().alias("text")).mapInArrow(run, T.StructType(fields))
