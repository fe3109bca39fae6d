import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehealth.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
OWN = bpe.encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab e'stré \n\t\x85\x1cΣ#1"))))
def test_texts_against_the_library(text):
    ids = OWN.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@pytest.mark.parametrize("seed", range(5))
def test_pieces_of_tokens_against_merging(seed):
    rng, tokens = random.Random(seed), list(RANKS)
    for _ in range(100):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8)))
        if data not in RANKS:
            assert bpe.Prefixes(OWN.pairs, data).tokens() == OWN.pairs.merged(data)


def test_small_vocabulary_with_unreachable_tokens():
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"aa": 5, b"abc": 6, b"bca": 7, b"caa": 8}
    pairs, rng = bpe.BytePairs(ranks), random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        assert bpe.Prefixes(pairs, data).tokens() == pairs.merged(data)


def test_appends_and_edits():
    rng, tokens = random.Random(5), list(RANKS)
    for _ in range(60):
        state, data = bpe.Prefixes(OWN.pairs), b""
        for _ in range(4):
            more = rng.choice(tokens)[: rng.randint(1, 9)]
            state.append(more)
            data += more
        start = rng.randint(0, len(data))
        stop = rng.randint(start, len(data))
        state.replace(start, stop, b"new")
        data = data[:start] + b"new" + data[stop:]
        assert bytes(state.data) == data
        for end in range(len(data) + 1):
            assert state.tokens(end) == OWN.pairs.merged(data[:end])


def test_an_edit_recomputes_little():
    data = b" of the rendered and interesting things" * 200
    state = bpe.Prefixes(OWN.pairs, data)
    assert state.replace(100, 103, b"xyz") < 300
    assert state.last == bpe.Prefixes(OWN.pairs, bytes(state.data)).last


def test_query_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "x" * 100_000, 3), (3, " \n\n " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: (len(r.ids), bytes(r.decoded)) for r in bpe.encode(docs).collect()}
    assert got[1] == got[2] == (0, b"")
    assert got[None] == (len(LIBRARY.encode_ordinary(rows[3][1])), b"x" * 100_000)
    assert got[3][1] == rows[4][1].encode()
    assert bpe.digests(docs.where(F.lit(False))).count() == 0
