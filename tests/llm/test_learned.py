"""Toxicity and language: held-out accuracy, gradients, and rows that are odd."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablehealth.llm import langid, toxicity

BIG = "/root/testdata/sf0.1"


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    held = Counter((truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth)
    assert held[0, 1] <= 0.01 * (held[0, 0] + held[0, 1])
    assert held[1, 1] >= 0.75 * (held[1, 0] + held[1, 1])


def test_noisy_or_and_the_offending_sentence():
    rng = random.Random(2)
    clean = ["calm", "quiet", "river", "stone", "tree", "cloud", "lake", "wind"]
    texts, labels = [], []
    for i in range(400):
        parts = [" ".join(rng.choice(clean) for _ in range(6)) for _ in range(8)]
        if i % 4 == 0:
            parts[rng.randrange(8)] += " awful" + rng.choice(["ly", "ness", "er", "est"])
        texts.append(". ".join(parts) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    text = "calm river. Stone tree AWFULISH lake! wind cloud."
    assert model.document(text) > 0.5 > model.document("calm river. stone tree lake.")
    start, end, score = model.worst(text)
    assert "AWFULISH" in text[start:end] and score > 0.5
    z = [model.sentence(s) for s in toxicity.sentences_of(text)]
    assert model.document(text) == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z))
    assert model.document("") == model.document(" .!\n") == 0


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (None, "bad " * 30_000, 1.0), (4, "a b", None)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, None), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows if r.doc_id in (1, 2)} == {0.0}
    none = docs.where(F.lit(False))
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.where(F.lit(False))).count() == 5


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def brute_mixture(logs, times, allowed, rounds):
    logs = [row for row, n in zip(logs, times, strict=True) for _ in range(n)]
    share = [a / sum(allowed) for a in allowed]
    for _ in range(rounds):
        parts = []
        for row in logs:
            p = [s * math.exp(x - max(row)) for s, x in zip(share, row, strict=True)]
            parts.append([x / sum(p) for x in p])
        share = [sum(c) / len(parts) for c in zip(*parts, strict=True)]
    return share


def test_mixture_against_plain_loops():
    rng = np.random.default_rng(4)
    sizes = np.array([5, 1, 40])
    logs = rng.normal(0, 3, (46, 3)).astype(np.float32)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 1]], float)
    times = rng.integers(1, 4, 46)
    share, _ = langid.mixture(logs, times, np.array([0, 5, 6]), sizes, allowed)
    for d, (a, b) in enumerate([(0, 5), (5, 6), (6, 46)]):
        assert share[d] == pytest.approx(brute_mixture(logs[a:b].tolist(), times[a:b].tolist(), allowed[d], langid.ROUNDS), abs=1e-5)


def test_settled_documents_would_not_gain():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        logs, times = rng.normal(0, rng.uniform(0.1, 3), (n, 3)).astype(np.float32), rng.integers(1, 5, n)
        logs[:, 0] += rng.uniform(0, 3)
        size = np.array([n])
        shares = langid.proportions(logs, times, size)[0]
        _, fitted = langid.mixture(logs, times, np.array([0]), size, np.ones((1, 3)), 60)
        alone = float((logs * times[:, None]).sum(axis=0).max())
        if (shares > 0).sum() == 1:  # no language pays for itself; two together may gain up to twice the price
            assert fitted[0] - alone <= 2 * (langid.PENALTY + 0.5 * math.log(times.sum())) + 1e-6
        assert shares.sum() == pytest.approx(1)


def test_a_mixed_text_holds_both_languages():
    counts = {}
    words = {"aa": ["kato", "kita", "tako", "kako"], "bb": ["munel", "nelum", "lumen", "menlu"]}
    for lang, known in words.items():
        counts[lang] = Counter()
        for w in known * 20:
            counts[lang].update(f"  {w} "[i : i + 3] for i in range(len(w) + 1))
    model = langid.Languages(counts)
    rng = random.Random(1)
    one = " ".join(rng.choice(words["aa"]) for _ in range(60))
    two = " ".join(rng.choice(words["bb"]) for _ in range(20))
    (a, sa, listed_a), (b, sb, listed_b), und = langid.predict(model, [one, one + " " + two, "12 !?"])
    assert (a, listed_a) == ("aa", "aa:1.000") and sa == 1
    assert b == "aa" and sb == pytest.approx(0.75, abs=0.03) and "bb:" in listed_b
    assert und[:2] == ("und", 0.0)


def test_language_odd_rows(spark):
    rows = [
        (1, "der die das", "de", 1), (2, "the of and", "en", 1), (3, None, "en", 1), (4, "", None, 1),
        (5, "123 ?!", "en", 1), (None, "the " * 40_000, None, 1), (1, "der die das", "de", 1), (6, "日本", None, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[None] == "en" and got[6] in ("de", "en")
    assert langid.identify(docs.where(F.lit(False))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("rate", [0.2, 0.5, 0.8])
def test_toxicity_at_any_share_of_toxic_labels(rate):
    rng = random.Random(7)
    common = [f"{a}{b}" for a in ("kor", "lem", "vas", "tun", "pid") for b in ("a", "ela", "omi", "ust", "ing", "ath")]
    bad = ["awful", "nasty", "vile", "horrid"]

    def text(toxic):
        parts = [[rng.choice(common) for _ in range(6)] for _ in range(6)]
        if toxic:
            parts[rng.randrange(6)][rng.randrange(6)] = rng.choice(bad)
        return ". ".join(map(" ".join, parts)) + "."

    labels = [int(i < rate * 800) for i in range(800)]
    model = toxicity.fit([text(y) for y in labels], labels)
    toxic, clean = ([model.document(text(y)) for _ in range(100)] for y in (1, 0))
    assert sum(x >= 0.5 for x in toxic) >= 90 and sum(x >= 0.5 for x in clean) <= 10


def test_evidence_has_both_signs():
    got = toxicity.evidence(np.array([20.0, 0.0, 10.0]), np.array([20.0, 20.0, 20.0]), 100, 200)
    assert got[0] == pytest.approx(got[1]) and got[0] > toxicity.EVIDENCE and got[2] == pytest.approx(0)


def test_copies_of_a_labelled_document_are_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels)) or toxicity.Model({}, 0.0))
    rows = [(1, "same text")] * 300 + [(1, "another"), (2, "x" * 50), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    known = {r.doc_id for r in docs.where(toxicity.fold(F.col("doc_id"), toxicity.FOLDS) != 0).select("doc_id").distinct().collect()}
    want = sorted({(i, t or "") for i, t in rows if i in known})
    assert list(zip(seen[0][0], seen[0][1])) == [(t, i % 2) for i, t in want]
    toxicity.train(docs, labels, sample=2)
    toxicity.train(docs, labels, chars=0)
    assert len(seen[1][0]) == min(2, len(want)) and not any(seen[2][0])
