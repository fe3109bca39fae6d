"""Language identification: the mixture of languages that explains a document's words best.

Each language is a character trigram model, which gives every word a likelihood. Expectation-maximisation finds
the proportions of the languages in each document, and a penalised likelihood decides how many of them
it really holds. Documents are handled many at a time as numpy arrays.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.lines import text_of
from tablehealth.llm.tasks import Recent, ship, slices
from tablehealth.llm.toxicity import fold

SAMPLE = 400
FOLDS, HELD_OUT = 4, 2
SMOOTHING = 0.1
ROUNDS = 12
RANKING_ROUNDS = 5
PENALTY = 6.0
_MARKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs without ASCII marks and digits."""
    return text.lower().encode().translate(_MARKS).split()


class Languages:
    """Log-likelihoods of words under each language's trigram model, in natural units."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.counts = counts
        self.names = sorted(counts)
        size = len(self.names)
        letters = 2 + len({g[2] for c in counts.values() for g in c})
        contexts: dict[str, np.ndarray] = {}
        for at, name in enumerate(self.names):
            for gram, n in counts[name].items():
                contexts.setdefault(gram[:2], np.zeros(size))[at] += n
        rows = [np.full(size, -np.log(letters))]  # after letters that no language knows
        self._open: dict[str, int] = {}
        for context, total in contexts.items():
            self._open[context] = len(rows)
            rows.append(np.log(SMOOTHING / (total + SMOOTHING * letters)))
        self._grams: dict[str, int] = {}
        for gram in sorted({g for c in counts.values() for g in c}):
            n = np.array([counts[name][gram] for name in self.names])
            self._grams[gram] = len(rows)
            rows.append(np.log((n + SMOOTHING) / (contexts[gram[:2]] + SMOOTHING * letters)))
        self._rows = np.array(rows)
        self.known = Recent(lambda w: self.words([w])[0].tobytes(), 200_000)

    def __reduce__(self):
        return Languages, (self.counts,)

    def words(self, words: list[bytes]) -> np.ndarray:
        """A row for each word, its trigrams added up."""
        gram, context, ids, sizes = self._grams.get, self._open.get, [], []
        for word in words:
            text = f"  {word.decode()} "
            for i in range(len(text) - 2):
                part = text[i : i + 3]
                at = gram(part)
                ids.append(context(part[:2], 0) if at is None else at)
            sizes.append(len(text) - 2)
        ends = np.cumsum(sizes)
        return np.add.reduceat(self._rows[ids], ends - sizes).astype(np.float32)

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        fresh = self.known.unknown(set(words))
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            for word, row in zip(part, self.words(part), strict=True):
                self.known.learn(word, row.tobytes())
        data = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(data, np.float32).reshape(-1, len(self.names))


def mixture(
    logs: np.ndarray, times: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents, languages) and log-likelihoods by expectation-maximisation.

    ``logs`` holds the distinct words of all documents, one document after another, ``times`` how often each occurs,
    ``sizes`` how many there are, and ``allowed`` the languages of each document.
    """
    top = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - top).astype(np.float64) + 1e-30
    share = allowed / allowed.sum(axis=1, keepdims=True)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(times, starts)[:, None]
    for _ in range(rounds):
        part = likely * share[doc]
        part *= (times / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total
    fitted = np.log((likely * share[doc]).sum(axis=1)) + top[:, 0]
    return share, np.add.reduceat(fitted * times, starts)


def proportions(logs: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each document's share of each language; languages that do not pay for themselves have none.

    The languages are tried in order of their share in the full mixture: one, two and so on, as long as
    each gains more log-likelihood than ``PENALTY`` and half the logarithm of the number of words. Documents
    for which a bound shows that no mixture gains as much are settled without fitting any.
    """
    count, times = logs.shape[1], times.astype(np.float64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    wide = logs.astype(np.float64)
    single = np.add.reduceat(wide * times[:, None], starts, axis=0)
    words = np.add.reduceat(times, starts)
    cost = PENALTY + 0.5 * np.log(words)
    best, first = np.zeros_like(single), single.argmax(axis=1)
    best[np.arange(len(sizes)), first] = 1
    # No mixture gains more than each word's best language would, nor, as the logarithm is concave, than the
    # logarithm of a language's mean ratio to the first one.
    gain = np.add.reduceat(logs.max(axis=1) * times, starts) - single.max(axis=1)
    ratio = np.exp(np.minimum(wide - wide[np.arange(len(doc)), first[doc]][:, None], 60)) * times[:, None]
    mean = np.add.reduceat(ratio, starts, axis=0).max(axis=1) / words
    open_ = np.flatnonzero(np.minimum(gain, words * np.log(mean)) > cost)
    if not len(open_):
        return best

    def rows(docs: np.ndarray) -> np.ndarray:
        n = sizes[docs]
        return np.repeat(starts[docs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())

    def fit(docs: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        n, at = sizes[docs], rows(docs)
        return mixture(logs[at], times[at], np.r_[0, np.cumsum(n)[:-1]], n, allowed, rounds)

    share, _ = fit(open_, np.ones((len(open_), count)), RANKING_ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    value = single[open_].max(axis=1)
    for m in range(2, count + 1):
        allowed = np.zeros((len(open_), count))
        np.put_along_axis(allowed, order[:, :m], 1, axis=1)
        share, fitted = fit(open_, allowed)
        better = fitted - value > cost[open_]
        best[open_[better]] = share[better]
        open_, order, value = open_[better], order[better], fitted[better]
        if not len(open_):
            break
    return best


def train(docs: DataFrame, sample: int = SAMPLE) -> Languages | None:
    """Trigram counts from at most ``sample`` documents of each language in the training folds."""
    known = docs.where("lang is not null and text is not null").where(
        fold(F.col("doc_id"), FOLDS) != HELD_OUT
    )
    key = F.xxhash64("doc_id")
    pick = Window.partitionBy("lang").orderBy("key", "doc_id")
    ids = (
        known.select("lang", "doc_id", key.alias("key"))
        .withColumn("at", F.row_number().over(pick))
        .where(F.col("at") <= sample)
        .select("lang", "doc_id")
        .distinct()
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    padded = f"  {word.decode()} "
                    for i in range(len(padded) - 2):
                        found[lang][padded[i : i + 3]] += n
        rows = [(lang, gram, n) for lang, grams in found.items() for gram, n in grams.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        types = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "gram", "n"]
        )

    picked = known.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).select("lang", "text")
    grams = picked.mapInArrow(count, "lang string, gram string, n long")
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    return Languages(counts) if counts else None


def predict(model: Languages | None, texts: list[str]) -> list[tuple[str, float, str]]:
    """Language, its share, and all shares for each text."""
    out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(texts)
    words = [Counter(words_of(t)) if any(map(str.isalpha, t)) else Counter() for t in texts]
    some = [i for i, w in enumerate(words) if w]
    if model is None or not some:
        return out
    logs = model.likelihoods([w for i in some for w in words[i]])
    times = np.array([n for i in some for n in words[i].values()])
    shares = proportions(logs, times, np.array([len(words[i]) for i in some]))
    for i, share in zip(some, shares, strict=True):
        at = int(share.argmax())
        listed = ",".join(
            f"{model.names[k]}:{share[k]:.3f}" for k in np.argsort(-share, kind="stable") if share[k] > 0
        )
        out[i] = (model.names[at], float(min(1.0, share[at])), listed)
    return out


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (the language's share) and ``shares`` of every row.

    Reads ``doc_id``, ``text`` and, to learn, ``lang``. A text that is null or has no letter is ``und`` with score
    0, and so is every text if no row has a language. A null ``doc_id`` is not held out. Repeated rows get equal
    rows; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    model = train(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            names, scores, shares = zip(*predict(model, batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["held_out"], pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()), pa.array(shares, pa.string()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "shares"],
            )

    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.StringType()),
    ]
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return docs.select("doc_id", held, text_of().alias("text")).mapInArrow(run, T.StructType(fields))
