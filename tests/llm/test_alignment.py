import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablehealth.llm import alignment
from tablehealth.llm.queries import QUERIES

LEFT = Tokenizer.from_file(public_tokenizers.path(alignment.LEFT))
LEFT.encode_special_tokens = True
RIGHT = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.RIGHT))
OWN = alignment.aligner(public_tokenizers.path(alignment.LEFT), public_tokenizers.path(alignment.RIGHT))
#: The characters GPT-style vocabularies use for bytes that do not print, by the rule of their table.
PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PRINT}
BYTE |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINT)}


def tokens_of(text):
    """Both sides' ids with their bytes, by the libraries alone; none if they do not spell the text."""
    if not text:
        return [], []
    data = (" " + text).encode()
    a = [(i, bytes(BYTE[c] for c in LEFT.id_to_token(i))) for i in LEFT.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in RIGHT.encode(text):
        piece = RIGHT.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if RIGHT.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return [], []
    return a, b


def groups_of(text):
    a, b = tokens_of(text)
    ends = []
    for side in (a, b):
        at, own = 0, []
        for _, data in side:
            at += len(data)
            own.append(at)
        ends.append(own)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        first, second = i, j
        while i < len(a) and ends[0][i] <= cut:
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            j += 1
        out.append(([x for x, _ in a[first:i]], [x for x, _ in b[second:j]]))
    return out


def expected(rows):
    """The digests by plain loops over libraries' tokens."""
    found = [(doc, groups_of(text or "")) for doc, text in rows]
    links = [[(x, y) for a, b in groups for x in a for y in b] for _, groups in found]
    count = Counter(p for own in links for p in set(own))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (doc, groups), own in zip(found, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own),
            sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def got(rows):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in rows.collect()), key=str)


ODD = [" ", "\n", "\r\n", "\t", "  ", "'s", "▁", "<|endoftext|>", "</s>", "\x1c", "\x85", "　", "中文", "\U0001f600", "123"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*ODD, " the", "ré", "!"]))))
def test_words_align_as_whole_texts_do(parts):
    text = "".join(parts)
    batch = alignment.align_texts(OWN, [text])
    groups = groups_of(text)
    assert batch.groups[0] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
    own = Counter(x * alignment.SIDE + y for a, b in groups for x in a for y in b)
    assert dict(zip(batch.pair.tolist(), batch.times.tolist(), strict=True)) == own
    assert batch.counts[0, 3] == sum(own.values())


@pytest.mark.parametrize("seed", range(3))
def test_coalesced_ranges_against_common_ends(seed):
    rng = random.Random(seed)
    for _ in range(300):
        size = rng.randint(1, 30)
        sides = [sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in range(2)]
        starts = [np.array([0, *ends[:-1]]) for ends in sides]
        found = alignment.coalesce(starts[0], np.array(sides[0]), starts[1], np.array(sides[1]))
        cuts = sorted(set(sides[0]) & set(sides[1]))
        for ends, of, per in zip(sides, (found.left_of, found.right_of), (found.left, found.right), strict=True):
            want = [next(k for k, cut in enumerate(cuts) if end <= cut) for end in ends]
            assert of.tolist() == want and per.tolist() == [want.count(k) for k in range(len(cuts))]
        i, j = alignment.expand(found)
        pairs = {(x, y) for x, p in enumerate(found.left_of) for y, q in enumerate(found.right_of) if p == q}
        assert len(i) == len(pairs) and set(zip(i.tolist(), j.tolist(), strict=True)) == pairs


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "over ▁ it"), (4, "the end"), (4, "the end"), (None, "the end"), (5, " "),
        (6, "x" * 5000), (7, " ".join(["the", "İé"] * 900)), (8, "<|endoftext|> <s>"),
    ]
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id int, text string, block int, links string")
    assert got(alignment.scores(docs)) == expected(rows)
    assert alignment.scores(docs.where("false")).count() == 0


def test_many_small_blocks(spark, monkeypatch):
    """Pairs are counted over all blocks and tasks; copies are documents of their own."""
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 60)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 40)
    rng = random.Random(2)
    words = "the then there thén naïve naively 12 123 re-do redo Straße\n über".split(" ")
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for k in range(120)]
    rows += [(k, "the same copy") for k in range(200, 280)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(alignment.scores(docs)) == expected(rows)


def test_query_against_plain_loops(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(QUERIES["op11_alignment"](spark, sf_dir)) == expected(rows)
