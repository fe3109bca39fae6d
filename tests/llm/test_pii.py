import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehealth.llm import pii
from tablehealth.llm.tagger import Tagger

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            odd = [d if i % 2 == 0 else d * 2 % 10 + d * 2 // 10 for i, d in enumerate(digits[::-1])]
            fine = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                16 <= len(digits) <= 19 and sum(odd) % 10 == 0,
                8 <= len(digits) <= 15,
            )[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-+ 0125()é%\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize(
    "text",
    ["4539 1488 0343 6467", "x+1 (788) 555-2942.", "é1.2.3.4.5.6.7.8", "999.1.1.1", "a@b@c.d.e", "0001.002.3.255"],
)
def test_known(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@a" * 100_000, "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_gradients():
    m = Tagger(10, 5, 4, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 10, (7, 3)), rng.integers(0, 5, (7, 3))
    _, grads = m.gradients(x, y)
    for k, v in m.p.items():
        i = (int(x[0, 0]), 0) if k == "embed" else tuple(rng.integers(0, s) for s in v.shape)
        v[i] += 1e-3
        up = m.gradients(x, y)[0]
        v[i] -= 2e-3
        down = m.gradients(x, y)[0]
        v[i] += 1e-3
        assert (up - down) / 6e-3 == pytest.approx(grads[k][i], rel=0.02, abs=1e-3)


def test_decode_against_all_paths():
    m = Tagger(4, 3, 2, 2)
    rng = np.random.default_rng(1)
    m.p["step"] = rng.standard_normal((3, 3))
    e = rng.standard_normal((5, 3))
    paths = np.indices((3,) * 5).reshape(5, -1).T
    score = [e[range(5), p].sum() + m.p["step"][p[:-1], p[1:]].sum() for p in paths]
    assert m.decode(e).tolist() == paths[int(np.argmax(score))].tolist()


@pytest.fixture(scope="module")
def windows(spark):
    return pii.labelled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 170)


def test_tagger_finds_loose_spellings(windows):
    rng = random.Random(8)
    rng.shuffle(windows)
    seen, known, new = {}, [], []
    for row in windows:
        seen[row[0]] = seen.get(row[0], 0) + 1
        (known if seen[row[0]] <= 110 else new).append(row)
    model = pii.train(sorted(known))
    hit = total = 0
    for kind, before, span, after in new:
        if kind < 0:
            continue
        loose = pii.loosened(kind, span, rng)
        _, every = pii.find(model, [before + loose + after])[0]
        total += 1
        hit += (kind, len(before), len(before) + len(loose)) in every
    assert total > 150 and hit >= 0.9 * total
    plain = ["quiet words without anything " * 50, "", "token = 0a1b2c3d4e5f60718293", "2024 and 17"]
    assert all(not every for _, every in pii.find(model, plain))


def test_query_rows(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.spans(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert set(filter(None, spelled.split(","))) <= set(r.spans.split(","))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "at a.b@c.de now", "y"), (3, "1.2.3.4 " * 900, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.n_email, r.n_ip) for r in pii.spans(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (0, 900), (1, 0)]
    out = pii.mask(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[2] == "" and text[None] == "at <EMAIL> now"
    assert text[3] == "<IP> " * 900
    none = docs.where(F.lit(False))
    assert pii.spans(none).count() == 0 and pii.mask(none).count() == 0


def test_masking_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a.b@c.org now", "p", True, 3, None), (1, "mail a.b@c.org now", "p", True, 3, None), (2, None, None, None, 4, "q"), (3, "", "p", False, 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _null boolean, `a.b` int, `missing` string")
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.schema["a.b"].dataType == docs.schema["a.b"].dataType
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, t.replace("a.b@c.org", "<EMAIL>") if t else t, *rest) for i, t, *rest in rows), key=str)
    assert pii.mask(docs.where("false")).count() == 0
