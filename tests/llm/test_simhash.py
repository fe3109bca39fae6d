import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablehealth.llm import bitslice, components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(doc_id, component) for (doc_id, code) by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


TEXTS = [
    None, "", " \t\n", "One", "one TWO three four", "one two three four five", "É a b c d é",
    "a b c d e f", "x " * 5000, "w" * 100_000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def test_bucket_links_connect_what_is_close():
    rng = random.Random(3)
    codes, buckets = [], []
    for bucket in range(40):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 30])):
            if rng.random() < 0.2:
                center = rng.getrandbits(64)
            code = center
            for _ in range(rng.randrange(7)):
                code ^= 1 << rng.randrange(64)
            codes.append(code)
            buckets.append(bucket)
    a, b = bitslice.bucket_links(np.array(codes, np.uint64), np.array(buckets), 4)
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    for bucket in range(40):
        own = list(dict.fromkeys(c for c, k in zip(codes, buckets, strict=True) if k == bucket))
        want = brute_components(list(enumerate(own)))
        left, right = bitslice.bucket_links(np.array(own, np.uint64), np.zeros(len(own)), 4)
        parent = {c: c for c in own}

        def root(c, parent=parent):
            while parent[c] != c:
                c = parent[c]
            return c

        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            assert root(x) != root(y)  # no link twice
            parent[root(x)] = root(y)
        first = {}
        for i, c in enumerate(own):
            first.setdefault(root(c), i)
        assert sorted(((i, first[root(c)]) for i, c in enumerate(own)), key=str) == want


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 230)] + [(5, 5)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    rows = {r.node: r.root for r in got.collect()}
    assert {rows[i] for i in range(101, 141)} == {100} and {rows[i] for i in range(200, 230)} == {7}
    assert 100 not in rows and 5 not in rows


def test_classes_against_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    got = simhash.classes(docs).select("doc_id", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({c for _, c in want}) < len(want)


def test_hot_file_is_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(1)
    codes = sorted({(1 << 40) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(99)})
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    got = components.components(simhash.links(df)).select("root").distinct().count()
    want = {c for _, c in brute_components(list(enumerate(codes)))}
    assert got == len(want) == 1


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (3, long, "a"), (1, long + " end", "b"), (1, long + " end", "b"), (None, None, "c"),
        (9, "", "d"), (8, " ", None), (None, long, "e"), (5, "quite another text of some words", "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code string")
    got = simhash.classes(docs).collect()
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 5, 8]
    empty = docs.where(F.lit(False))
    assert simhash.classes(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_first_documents_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 7), (2, "a b c d e f", "y", 8)], "doc_id long, text string, text_key string, _text_key int")
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", "x", 7)]
