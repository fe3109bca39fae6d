"""Quality rules and line dedup against plain loops."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehealth.llm import line_dedup, quality
from tablehealth.llm.lines import _MIX, BANDS
from tablehealth.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeated), failed)


TEXTS = [
    None, "", " \t\n\x0b ", "one", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z ", "é ñ #*|<>$%& 🎉 é ñ #*|<>$%& 🎉",
    "w " * 20_000, " ".join(f"w{i % 77}" for i in range(5000)), "a b c d " + "q r s " * 3 + "a b c", "tab\tnbsp x y z",
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r)[3:9] for r in quality.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute_counts(t), i


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab#\n \té", max_size=80), min_size=1, max_size=60))
def test_counts_of_any_text(spark, texts):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r)[3:9] for r in quality.judge(docs).collect()}
    assert all(got[i] == brute_counts(t) for i, t in enumerate(texts))


def words(i, n):
    return " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest()[:6] for k in range(n))


def corpus():
    """Documents of own lines; some with boilerplate, some of little else, and copies of one document."""
    rows = []
    for i in range(60):
        own = "\n".join(words((i, k), 12) for k in range(6))
        rows.append((i, own, f"s{i % 12}"))
    for i in range(60, 100):
        own = "\n".join(words((i, k), 12) for k in range(6))
        rows.append((i, own + "\nAll rights  RESERVED by the owners", f"s{i % 12}"))
    boiler = "\n".join("boiler " + words(("b", k), 30) for k in range(3))
    for i in range(100, 140):
        rows.append((i, boiler + "\n" + words((i, "own"), 12 if i % 2 else 120), f"s{i % 12}"))
    copied = "\n".join(words(("copy", k), 12) for k in range(8))
    rows += [(i, copied, f"s{i % 12}") for i in range(140, 180)]
    return rows


def test_boilerplate_goes_and_copies_stay(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.clean(docs).collect()}
    before = {i: t for i, t, _ in corpus()}
    assert all(got[i] == (before[i], 0) for i in [*range(60), *range(140, 180)])
    assert all(got[i] == (before[i].rpartition("\n")[0], 1) for i in range(60, 100))
    assert all(got[i] == (before[i].rpartition("\n")[2], 3) for i in range(100, 140))


def test_threshold_is_exact(spark):
    rows = [(s * 100 + k, f"{words((n, s, k), 9)}\nline {n} that is shared", f"s{s}")
            for n in (9, 10, 11) for s in range(n) for k in range(2)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {t.split("\n")[-1] for t, in line_dedup.clean(docs).select("text").collect() if "shared" in t}
    assert got == {"line 9 that is shared"}


def test_depleted_documents_are_rejected(spark):
    docs = spark.createDataFrame([(i, t, "host") for i, t, _ in corpus()], "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs).collect()}
    assert all(got[i] == (False, not 100 <= i < 140 or i % 2 == 0) for i in got)


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (2, "", None, 1), (None, "x " * 100, "a", 2), (3, "long " * 30_000, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    assert quality.judge(docs).count() == 5
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0
    good = spark.createDataFrame([(None, words(1, 80), None, 1)] * 2, "doc_id long, text string, source string, kept int")
    assert quality.keep_good(good).count() == 2
    out = line_dedup.clean(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(str(t) for _, t, *_ in rows)
    none = docs.where(F.lit(False))
    assert quality.judge(none).count() == line_dedup.clean(none).count() == 0


@pytest.mark.parametrize("name", ["op10_exact_top_k"])
def test_queries_against_sql(spark, sf_dir, name):
    from checks.compare import rows_of
    from tablehealth.llm.queries import QUERIES
    from tablehealth.llm.sql import ORACLE

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLE[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def chained(values, seed=42):
    """The engine's 64-bit hash of several values: each is hashed with the hash so far as its seed; nulls are passed over."""
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def lines_of(text):
    """Key, length and min-hashes of every line with a word."""
    out = []
    for line in (text or "").split("\n"):
        if not WORD.search(line):
            continue
        norm = " ".join(WORD.findall(line)).lower()
        w = norm.split(" ") + [None, None]
        windows = [chained(w[i : i + 3]) >> 32 for i in range(max(1, len(w) - 4))]
        marks = [min(h ^ c for h in windows) for c in _MIX]
        out.append((int(hashlib.md5(norm.encode()).hexdigest()[:15], 16), len(norm), marks))
    return out


def originals(sets, common):
    """Of sets (key to lines) with a line in question, those that are the least in every band of their own lines' marks."""
    marks = {}
    for key, lines in sets.items():
        if any(k in common for k, _, _ in lines):
            own = [m for k, _, m in lines if k not in common]
            marks[key] = [min((m[k] for m in own), default=key) for k in range(2 * BANDS)]
    least = [{} for _ in range(BANDS)]
    for key in sorted(marks):
        for b in range(BANDS):
            least[b].setdefault(tuple(marks[key][2 * b : 2 * b + 2]), key)
    return {key for key, m in marks.items() if all(least[b][tuple(m[2 * b : 2 * b + 2])] == key for b in range(BANDS))}


def sets_of(docs):
    """Sets of lines, with the source of their earliest document."""
    sets, source = {}, {}
    for _, lines, own in sorted(docs, key=lambda d: d[0]):
        keys = sorted({k for k, _, _ in lines})
        if keys:
            sets.setdefault(chained(keys), list({k: (k, n, m) for k, n, m in lines}.values()))
            source.setdefault(chained(keys), own)
    return sets, source


def test_line_dedup_against_plain_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    docs = [(r.doc_id, lines_of(r.text), r.source) for r in rows]
    sets, source = sets_of(docs)
    sites = defaultdict(set)
    number = Counter(k for lines in sets.values() for k, _, _ in lines)
    for key, lines in sets.items():
        for k, _, _ in lines:
            sites[k].add(source[key])
    likely = {k for k in sites if number[k] >= 10 and len(sites[k]) >= 8}
    spread = defaultdict(set)
    for key in originals(sets, likely):
        for k, n, _ in sets[key]:
            if k in likely and n >= line_dedup.MIN_CHARS:
                spread[k].add(source[key])
    bad = {k for k, own in spread.items() if len(own) >= 10}
    want = {}
    for r in rows:
        parts = (r.text or "").split("\n")
        keep = [x for x in parts if not WORD.search(x) or lines_of(x)[0][0] not in bad]
        want[r.doc_id] = (r.text if len(keep) == len(parts) else "\n".join(keep), len(parts) - len(keep))
    got = {r.doc_id: (r.text, r.removed_lines) for r in QUERIES["op1_line_dedup"](spark, sf_dir).collect()}
    assert got == want


def test_quality_rules_against_plain_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    lost = {}
    for host in {r.source for r in rows}:
        docs = [(r.doc_id, lines_of(r.text), host) for r in rows if r.source == host]
        limit = max(quality.MIN_DOCUMENTS, len(docs) * quality.HOST_SHARE)
        sets, _ = sets_of(docs)
        often = Counter(k for lines in sets.values() for k, _, _ in lines)
        likely = {k for k, n in often.items() if n > limit}
        left = Counter(k for key in originals(sets, likely) for k, _, _ in sets[key] if k in likely)
        bad = {k for k, n in left.items() if n > limit}
        for doc_id, lines, _ in docs:
            lost[doc_id] = 2 * sum(n for k, n, _ in lines if k in bad) > sum(n for _, n, _ in lines)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect()}
    for r in rows:
        *counts, failed = brute_counts(r.text)
        assert got[r.doc_id] == (*counts, failed, not failed and not lost[r.doc_id])


def test_no_python_in_native_plans(spark, sf_dir, capsys):
    from tablehealth.llm.queries import QUERIES

    for name in ("op1_line_dedup", "op9_quality_rules"):
        QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert "HashAggregate" in plan or "Scan parquet" in plan
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "BroadcastNestedLoop", "Cartesian"))


def on_template(seed, template, own, n=40):
    base = [words(("t", seed, k), 10) for k in range(template)]
    return ["\n".join(base + [words((seed, i, k), 12) for k in range(own)]) for i in range(n)]


TEMPLATES = [(s, b, u) for s in range(12) for b, u in ((5, 1), (10, 1), (10, 2), (20, 1), (20, 5))]


def test_templates_with_few_own_lines_go(spark):
    made = {(s, b, u): on_template(s, b, u) for s, b, u in TEMPLATES}
    rows = [(t, i, k) for k, texts in enumerate(made.values()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(
        [(n, t, f"s{i % 12}", f"h{k}") for n, (t, i, k) in enumerate(rows)], "doc_id long, text string, source string, host string"
    )
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.clean(docs).collect()}
    for n, (t, _, k) in enumerate(rows):
        _, b, _ = TEMPLATES[k]
        assert got[n] == ("\n".join(t.split("\n")[b:]), b), TEMPLATES[k]
    kept = {r.doc_id: r.kept for r in quality.judge(docs.withColumn("source", F.col("host"))).collect()}
    assert not any(kept.values())


def test_copies_elsewhere_do_not_save_a_line(spark):
    licence = "licensed under the terms of the owners"
    other = ["\n".join([words((i, "own"), 60), licence]) for i in range(300)]
    copied = words("copied", 60) + "\n" + licence
    rows = [(i, t, f"s{i % 100}") for i, t in enumerate(other + [copied] * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.removed_lines for r in line_dedup.clean(docs).collect()} == {1}
    bad = {r.key for r in quality.common_lines(quality.features(docs.withColumn("source", F.lit("h")))).collect()}
    assert len(bad) == 1


def test_copies_with_a_word_changed_stay(spark):
    base = [words(("near", k), 100) for k in range(3)]
    rows = []
    for i in range(400):
        parts = [x.split() for x in base]
        parts[i % 3][i % 97] = f"changed{i}"
        rows.append((i, "\n".join(map(" ".join, parts)), f"s{i % 12}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.removed_lines for r in line_dedup.clean(docs).collect()} == {0}
    assert all(r.kept for r in quality.judge(docs.withColumn("source", F.lit("h"))).collect())
