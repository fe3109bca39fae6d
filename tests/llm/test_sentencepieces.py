import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tablehealth.llm import sentencepieces
from tablehealth.llm.queries import QUERIES

PATH = public_tokenizers.path(sentencepieces.VOCABULARY)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = sentencepieces.table(PATH)
ODD = ["▁", "▁▁ ", " ▁", "\r\n", " \r", "<s>", "<0x0A>", "\x1c", "\x00", "﻿", "　", "\xa0", "İ", "ﬁ", "中文", "the"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*ODD, " ", "\n", "a"]))))
def test_texts_against_the_library(parts):
    text = "".join(parts)
    ids = OWN.many([text])[0].tolist()
    assert ids == LIBRARY.encode(text)
    assert OWN.vocabulary.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("seed", range(4))
def test_decoding_of_any_ids(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        pick = (rng.randrange(32000), rng.randrange(4), rng.randrange(130, 260), 259)
        ids = [rng.choice(pick) for _ in range(rng.randint(0, 7))]
        assert OWN.vocabulary.decode(ids) == LIBRARY.decode(ids)


def test_words_are_segmented_once(monkeypatch):
    own, seen = sentencepieces.Table(PATH), []
    segment = own.vocabulary.segment
    monkeypatch.setattr(own.vocabulary, "segment", lambda words: seen.extend(words) or segment(words))
    own.many(["one two one\none", "two one two", "one"])
    assert sorted(seen) == ["\none", " one", " two"]


def test_a_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 37}▁x\n" for i in range(900))
    monkeypatch.setattr(sentencepieces, "WORDS_AT_ONCE", 50)
    assert len(list(OWN.vocabulary.words(text))) > 10
    assert OWN.many([text])[0].tolist() == LIBRARY.encode(text)
    unbroken = "漢字ab" * 4000
    assert OWN.many([unbroken])[0].tolist() == LIBRARY.encode(unbroken)


def test_odd_rows(spark):
    rows = [(1, None, 7, "x"), (1, "", 7, "x"), (2, "a b", 7, "x"), (2, "a b", 7, "x"), (None, " ", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = sorted(map(tuple, sentencepieces.digests(docs).collect()), key=str)

    def row(doc, text):
        ids = LIBRARY.encode(text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        return doc, len(ids), digest, hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    assert got == sorted((row(doc, text or "") for doc, text, *_ in rows), key=str)
    assert sentencepieces.digests(docs.where("false")).count() == 0


def test_tokens_back_to_texts(spark):
    rows = [(1, None), (2, []), (3, LIBRARY.encode("a  b\nc")), (4, [1, None, 259, 2])]
    got = sentencepieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"))
    assert sorted(map(tuple, got.collect())) == [(1, ""), (2, ""), (3, "a  b\nc"), (4, " ")]


def test_query_against_the_library(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
