import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablehealth.llm import ngrams
from tablehealth.llm.eliasfano import EliasFano
from tablehealth.sources.scratch import shared_folder


@pytest.mark.parametrize("top", [0, 1, 63, 1000, 2**40, 2**64 - 1])
@pytest.mark.parametrize("n", [1, 2, 64, 65, 3000])
def test_elias_fano(n, top):
    rng = random.Random(n)
    values = np.array(sorted(rng.randint(0, top) for _ in range(n)), np.uint64)
    code = EliasFano.build(values)
    assert code.access(np.arange(n)).tolist() == values.tolist()
    asked = np.array([*values.tolist(), *(rng.randint(0, top) for _ in range(200))], np.uint64)
    start = np.array([rng.randint(0, n) for _ in asked])
    end = np.array([rng.randint(0, n) for _ in asked])
    got = code.find(asked, start, end)
    for x, a, b, at in zip(asked.tolist(), start.tolist(), end.tolist(), got.tolist(), strict=True):
        part = values[a:b].tolist()
        assert at == (a + part.index(x) if x in part else -1)


def brute(texts, train, order, least):
    """Scores by the model's definition, with dictionaries."""
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [*(w for w in low.split(" ") if w), "\n"]

    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        own = tokens(t)
        for n in range(1, order + 1):
            counts[n].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    for n in range(2, order + 1):
        counts[n] = Counter({g: c for g, c in counts[n].items() if c >= least})
    total, v = sum(counts[1].values()), len(counts[1])
    kept = Counter()
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            kept[g[:-1]] += c - 0.75
    out = []
    for t in texts:
        own, base, full = tokens(t), 0.0, 0.0
        for i, w in enumerate(own):
            p = (counts[1][(w,)] + 0.1) / (total + 0.1 * (v + 1))
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                context = tuple(own[i - n + 1 : i])
                c = counts[n - 1][context]
                if not c:
                    break
                a = max(counts[n][(*context, w)] - 0.75, 0) / c
                p = a + (1 - kept[context] / c) * p
            full += math.log10(p)
        out.append((len(own), sum((w,) in counts[1] for w in own), total, base, full))
    return out


def check(rows, texts, order=3, least=3):
    held = {d for d in texts if d is not None and zlib.crc32(str(d).encode()) % 10 == 0}
    want = dict(zip(texts, brute(texts.values(), [t for d, t in texts.items() if d not in held], order, least), strict=True))
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base, full = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (r.doc_id in held)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert full - 0.06 * n - 1e-6 <= r.score <= full + 1e-6  # eight bits, rounded down
    return held


def test_documents_against_dictionaries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ngrams.score(docs).collect()
    held = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.score for r in rows if r.doc_id in held) > sum(r.base_score for r in rows if r.doc_id in held)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_small_texts_in_many_shards(spark, order):
    rng = random.Random(order)
    texts = {i: " ".join(rng.choice("aabcdefg") for _ in range(rng.randint(0, 40))) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(ngrams.score(docs, order, 2).collect(), texts, order, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "A a  a\tA a a", None: "a b", 5: "x" * 5000, 6: "word " * 20_000}
    docs = spark.createDataFrame([(*r, 1) for r in texts.items()], "doc_id long, text string, score int")
    check(ngrams.score(docs).collect(), texts)
    assert ngrams.score(docs.where(F.lit(False))).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.score) for r in ngrams.score(only).collect()} == {(0, 0, 0.0)}


def test_the_query_learns_from_every_ngram(spark, sf_dir):
    from tablehealth.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(QUERIES["op7_lm_scoring"](spark, sf_dir).collect(), texts, least=1)


def test_a_passage_seen_once_is_known(spark, tmp_path):
    from tablehealth.llm.queries import QUERIES

    passage = " ".join(f"w{i}" for i in range(60))
    mixed = " ".join(f"w{i * 7 % 60}" for i in range(60))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    learned = [i for i in range(200) if i not in held and zlib.crc32(str(i).encode()) % 10][0]
    rows = [(learned, passage), (held[0], passage), (held[1], mixed)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in QUERIES["op7_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 20


def test_followers_in_several_shards(spark, monkeypatch):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["the", *(f"w{k}" for k in range(60))]) + " the" for _ in range(12)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngrams, "SHARD", 100)
    held = F.col("doc_id") < 0
    meta = json.loads(ngrams.train(docs.withColumn("held_out", held), 3, 1)[0])
    assert all(len(level) > 5 for level in meta["levels"][1:])
    assert all(meta["split"][1:])
    check(ngrams.score(docs, 3, 1).collect(), texts, least=1)


def test_counts_of_more_than_a_byte():
    counts = np.array([1, 254, 255, 256, 3, 2**40])
    shard = ngrams.Shard.__new__(ngrams.Shard)
    kept = ngrams._small(counts)
    shard._counts, shard._many_at, shard._many = kept["counts"], kept["many_at"], kept["many"]
    assert kept["counts"].itemsize == 1
    assert shard.counts(np.array([5, 0, 2, 1, 3, 2, 4])).tolist() == [2**40, 1, 255, 254, 256, 255, 3]


def test_tokens_are_words_and_ends():
    texts = ["", "A a\x0bb", " É x y \x1cZ\n\n", "\x00", "a" * 70_000, "b"]
    places, words, sizes = ngrams._tokens(texts)
    want = [[*(w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w), "\n"] for t in texts]
    assert sizes.tolist() == [len(t) for t in want]
    assert [words[i].decode() for i in places] == [w for t in want for w in t]
    assert len(set(words)) == len(words)
    assert [len(x) for x in ngrams._tokens([])] == [0, 0, 0]


def test_ngrams_are_written_once(spark):
    """Only the trie and the numbered texts stay in the shared folder, no tables of n-grams beside them."""
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{rng.randint(0, 4000)}" for _ in range(100))) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def size():
        folder = shared_folder(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names)

    before = size()
    assert ngrams.score(docs, 3, 1).count() == 2000
    assert (size() - before) / (2000 * 101) < 16  # bytes a token


def test_a_rare_value_coarsens_its_neighbours_only():
    x = np.full(3 * ngrams.STEP + 5, 0.3)
    x[0] = 2.0**-40
    x[-1] = 0.9
    codes, steps = ngrams._quantised(x)
    got = ngrams._restored(codes, steps, np.arange(len(x)))
    assert codes.dtype == np.uint8 and len(steps) == 4
    assert (got <= x * (1 + 1e-6)).all() and (got >= x * 2.0 ** (-40 / 255) * (1 - 1e-6)).all()
    assert got[ngrams.STEP :] == pytest.approx(x[ngrams.STEP :], rel=0.01)
    assert [len(a) for a in ngrams._quantised(np.zeros(0))] == [0, 0]
