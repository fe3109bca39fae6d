import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tablehealth.llm import conversations, grammar
from tablehealth.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Cost, audit and repaired rows of (role, text, fault) by trying every edit at every row, from the end."""
    goal = re.compile(r"(s?(ua)+)?")
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(at, last, inserted):
        options = []
        if at == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in after[last]:
                    cost, audit, out = rest(at, role[0], inserted + 1)
                    options.append((cost + 3, "I" + audit, ((role, ""), *out)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, out = rest(at + 1, last, 0)
            options.append((cost + 4, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in after[last]:
                    cost, audit, out = rest(at + 1, role[:1], 0)
                    options.append((cost + extra, "K" + audit, ((role, text), *out)))
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        cost, audit, out = rest(at + 1, new[0], 0)
                        options.append((cost + extra + 3, "R" + audit, ((new, text), *out)))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = rest(0, "", 0)
    assert goal.fullmatch("".join(role[0] for role, _ in out))
    return cost, audit, out


def judged(rows):
    """Rows (turn, role, text) of one conversation in order, as the report should have them."""
    seen, faulty = set(), []
    for _, role, text in rows:
        said = WORD.findall(text)
        if not said:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    roles = [role[:1] for role, _, _ in faulty]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit, out = cheapest(faulty)
    faults = [sum(f == name for *_, f in faulty) for name in ("blank", "duplicate", "truncated")]
    text = "\n".join(f"{role}:{said}" for role, said in out)
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def broken(rows):
    """The damage by the checksum, by its definition; rows are (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, every):
    """The report, with the rows of a turn in order of role and digest."""
    groups = {conv: [] for conv, *_ in every}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        ))
        out.append((conv, *judged(own)))
    return sorted(out, key=str)


def got(report):
    return sorted((tuple(r[c] for c in COLUMNS) for r in report.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("seed", range(4))
def test_grammar_against_trying_every_edit(seed):
    rng = random.Random(seed)
    sequences = {"".join(rng.choice("xsuaoSUAO" if rng.random() < 0.6 else "ua") for _ in range(rng.randint(1, 14))) for _ in range(250)}
    sequences = sorted(sequences | {"ua" * 30, "u" * 41, "xxxx", "s", "ox" * 7})
    own = grammar.Grammar(sequences)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for symbols, root in zip(sequences, own.roots.tolist(), strict=True):
        rows = tuple(
            ("user", "", "blank") if c == "x" else (names[c.lower()], "t", "truncated" if c.isupper() else "")
            for c in symbols
        )
        ends = []
        for (k, goal), tail in grammar.INSERTED.items():
            if (k, goal) in ((0, 0), (0, 3), (1, 3), (2, 3), (3, 3)) and own.matrices.cost[root, 0, k] < grammar.NEVER:
                cost = int(own.matrices.cost[root, 0, k]) + 3 * len(tail)
                ends.append((cost, grammar.letters(own.edits(root, 0, k) + tail)))
        assert min(ends) == cheapest(rows)[:2]


def test_grammar_shares_rules():
    own = grammar.Grammar(["sua" + "ua" * 40, "ua" * 41, "sua" + "ua" * 39 + "u"])
    assert len(own.parts) < 30
    assert grammar.Grammar([]).roots.tolist() == [] and grammar.Grammar([""]).roots.tolist() == [-1]


def test_products_in_any_order_are_the_same():
    rng = np.random.default_rng(1)
    picks = [grammar.OF_SYMBOLS[rng.integers(0, 9, 200)] for _ in range(3)]
    left = grammar.product(grammar.product(picks[0], picks[1])[0], picks[2])[0]
    right = grammar.product(picks[0], grammar.product(picks[1], picks[2])[0])[0]
    assert (left.cost == right.cost).all()
    sure = left.cost < grammar.NEVER
    order = [np.where(sure, m.rank, -1) for m in (left, right)]
    flat = [o.reshape(len(o), -1) for o in order]
    assert all((np.sign(f[:, :, None] - f[:, None, :])).shape for f in flat)
    a, b = (np.sign(f[:, :, None] - f[:, None, :]) for f in flat)
    both = (sure.reshape(len(sure), -1)[:, :, None]) & (sure.reshape(len(sure), -1)[:, None, :])
    assert (a[both] == b[both]).all()


def _random_rows(rng, conversations_, longest):
    rows = []
    for conv in range(conversations_):
        turn = rng.randint(-2, 3)
        for _ in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No?", "cut off", "", " \t", "Done!\n", None, f"Only {rng.random()}."])
            rows.append((conv, None if rng.random() < 0.03 else turn, role, text))
            turn += rng.choice([1, 1, 1, 1, 0, 2])
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_reports_against_plain_loops(spark, seed):
    rows = _random_rows(random.Random(seed), 150, 12)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (900, None, "user", "a."), (900, None, "user", "a.")]
    every = frame(spark, rows).repartition(5)
    assert got(conversations.report(every)) == expected(rows, rows)
    assert got(conversations.report(conversations.damaged(every), every)) == expected(broken(rows), rows)


def test_long_conversations_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(conversations, "STRETCH", 1)
    monkeypatch.setattr(conversations, "LEVELS", (2, 3, 5, 33, 41, 63))
    rng = random.Random(8)
    rows = _random_rows(rng, 40, 9) + [
        (100, turn, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", f"t{turn}", f"Why {turn}?"]))
        for turn in range(150)
    ]
    every = frame(spark, rows)
    assert got(conversations.report(every)) == expected(rows, rows)


def test_a_conversation_with_a_third_of_all_rows_is_spread(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(3000)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"Turn {t}.") for c in range(2, 1500) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would else share a task
    try:
        ordered = conversations._ordered(conversations._read(frame(spark, rows).repartition(6)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r["place"] >> 33 for r in ordered.where("conv = '=1'").select("place").collect()}
    assert len(parts) > 1


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Well."), (1, 2, "user", "Well."), (2, 1, "user", " ")]
    repaired = conversations.Repair(frame(spark, rows)).rows().orderBy("conv", "place", "part")
    assert [tuple(r[c] for c in ("conv", "edit", "role", "text")) for r in repaired.collect()] == [
        ("=1", "I", "user", ""), ("=1", "K", "assistant", "Hello."), ("=1", "K", "user", "Well."), ("=1", "I", "assistant", ""),
    ]


def test_odd_tables(spark):
    every = frame(spark, [(1, 1, None, None), (2, 5, "user", "x" * 200_000 + ".")]).selectExpr("*", "1 AS place", "'x' AS conv")
    assert got(conversations.report(every)) == expected([(1, 1, None, None), (2, 5, "user", "x" * 200_000 + ".")], [(1,), (2,)])
    assert conversations.report(every.where("false")).count() == 0
    assert got(conversations.report(every.where("false"), every.where("conv_id = 1"))) == [
        (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    ]


def test_query_against_plain_loops(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, sf_dir)) == expected(broken(rows), rows)
