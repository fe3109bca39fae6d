import random

import pytest
from pyspark.sql import functions as F

from tablehealth.llm import hamming


def brute(rows, queries, k):
    def code(v):
        return sum(1 << i for i, x in enumerate(v) if x is not None and x > 0)

    known = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    out = []
    for q, v in queries:
        if q is None or v is None:
            continue
        near = sorted(((code(v) ^ c).bit_count(), i) for i, c in known)[:k]
        out += [(q, at + 1, i, d) for at, (d, i) in enumerate(near)]
    return sorted(out)


def run(spark, rows, queries, k, type_="id long, v array<float>, rank int"):
    a = spark.createDataFrame([(*r, 0) for r in rows], type_)
    b = spark.createDataFrame([(*r, 0) for r in queries], type_)
    return sorted(tuple(r) for r in hamming.search(a, b, k, "id", "v").collect())


@pytest.mark.parametrize("bits", [8, 64])
def test_against_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(bits)]) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(20)]  # one code that many rows have
    queries = rows[:4] + rows[-2:]
    assert run(spark, rows, queries, 5) == brute(rows, queries, 5)


def test_odd_rows(spark):
    rows = [(1, [1.0, None, -1.0]), (1, [1.0, None, -1.0]), (2, None), (None, [1.0]), (3, []), (4, [0.5])]
    assert run(spark, rows, rows, 3) == brute(rows, rows, 3)
    assert run(spark, rows, rows, 50) == brute(rows, rows, 50)
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    none = df.where(F.lit(False))
    assert hamming.search(none, df, 3, "id", "v").count() == 0
    assert hamming.search(df, none, 3, "id", "v").count() == 0


def test_codes_of_several_words(spark):
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(150)] for _ in range(3)]
    rows = []
    for i in range(60):  # around three centres, so that small radii suffice
        v = list(base[i % 3])
        for at in rng.sample(range(150), rng.randrange(8)):
            v[at] = -v[at]
        rows.append((i, v[: rng.choice((64, 65, 150, 150, 150))]))
    rows += [(90, rows[0][1]), (91, [1.0] * 65), (92, []), (93, None)]
    queries = [*rows[:3], rows[-3], (99, [-1.0] * 130)]
    assert run(spark, rows, queries, 4) == brute(rows, queries, 4)


def test_bounds_spare_probes(spark, monkeypatch):
    from math import comb

    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(40)]
    for i in range(40, 120):  # ten and more within 9 bits of each query, found at radii 1 and 2
        v = list(rows[i % 4][1])
        for at in rng.sample(range(64), rng.randrange(5, 10)):
            v[at] = -v[at]
        rows.append((i, v))
    rows += [(200 + i, rows[50][1]) for i in range(12)]
    made, probes = [], hamming._probes

    def counted(queries, radius, words):
        found = probes(queries, radius, words)
        made.append((radius, queries.count(), found.count()))
        return found

    monkeypatch.setattr(hamming, "_probes", counted)
    queries = rows[:4]
    assert run(spark, rows, queries, 5) == brute(rows, queries, 5)
    assert made[0] == (0, 4, 16)
    assert made[-1][2] < made[-1][1] * 4 * comb(16, made[-1][0])  # the last radius does not look up all segments


@pytest.mark.parametrize("k", [3, 12])
def test_ties_and_copies_at_the_bound(spark, k):
    rng = random.Random(k)
    near = [rng.choice((-1.0, 1.0)) for _ in range(64)]
    rows = []
    for i in range(300):
        v = list(near)
        for at in rng.sample(range(64), rng.choice((5, 6, 6, 7, 9, 30))):
            v[at] = -v[at]
        rows.append((1000 - i // 2, v))  # ids come twice
    rows += rows[:40:4]
    queries = [(0, near), *rows[:3]]
    assert run(spark, rows, queries, k) == brute(rows, queries, k)
