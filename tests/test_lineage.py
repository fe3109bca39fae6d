import random
import time

import pytest
from pyspark.sql import functions as F

from tablehealth.operators import depth, lineage
from tablehealth.operators.profile import union_all

MODELS = "project_id string, node_id string, name string, pos int, depends_on array<string>"
EXPOSURES = "project_id string, depends_on array<string>"


def graph(spark, spec, project="p"):
    rows = [(project, f"model.{project}.{n}", n, i, list(deps)) for i, (n, deps) in enumerate(spec)]
    return spark.createDataFrame(rows, MODELS)


def names(df):
    return {r.name for r in df.collect()}


def depths(df, **options):
    return {r.name: r.depth for r in lineage.node_depths(df, **options).collect()}


def test_orphans_and_exposures(spark):
    models = graph(spark, [("cut", []), ("polish", ["model.p.cut"]), ("spare", [])])
    assert names(lineage.orphans(lineage.graph_nodes(models))) == {"polish", "spare"}
    exposures = spark.createDataFrame([("p", ["model.p.polish"]), ("other", ["model.p.spare"])], EXPOSURES)
    assert names(lineage.orphans(lineage.graph_nodes(models, exposures))) == {"spare"}


def test_roots(spark):
    models = graph(spark, [("stg", ["source.p.raw", "seed.p.s"]), ("fct", ["model.p.stg"]), ("x", ["model.p.unknown"])])
    assert names(lineage.roots(models)) == {"stg"}
    assert depths(models) == {"stg": 1, "fct": 2, "x": 1}


def test_chain_and_diamond(spark):
    chain = graph(spark, [("a", []), ("b", ["model.p.a"]), ("c", ["model.p.b"]), ("d", ["model.p.c"])])
    assert depths(chain) == {"a": 1, "b": 2, "c": 3, "d": 4}
    diamond = graph(spark, [("a", []), ("b", ["model.p.a"]), ("c", ["model.p.a", "model.p.b"]), ("d", ["model.p.c", "model.p.a"])])
    assert depths(diamond) == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_fan_out(spark):
    spec = [("base", [])] + [(f"m{i}", ["model.p.base"]) for i in range(6)]
    row = lineage.fan_out(graph(spark, spec)).first()
    assert (row.model, row.downstream_count) == ("base", 6)
    assert row.consumers == [f"m{i}" for i in range(6)]
    big = [("base", [])] + [(f"m{i:02}", ["model.p.base", "source.x.base"]) for i in range(7)] + [("z", ["model.p.gone"] * 9)]
    rows = lineage.fan_out(graph(spark, big)).collect()
    assert [(r.model, r.downstream_count, len(r.consumers)) for r in rows] == [("base", 14, 10)]
    assert rows[0].consumers[:4] == ["m00", "m00", "m01", "m01"]
    plan = lineage.fan_out(graph(spark, big))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_name_and_id_matching(spark):
    models = graph(spark, [("orders", []), ("fct", ["source.p.orders"]), ("v", ["model.p.orders.v2"])])
    assert names(lineage.orphans(lineage.graph_nodes(models))) == {"fct", "v"}
    assert names(lineage.orphans(lineage.graph_nodes(models, match="node_id"))) == {"orders", "fct", "v"}
    with pytest.raises(ValueError):
        lineage.edges(models, match="path")


def test_empty_graph(spark):
    models = graph(spark, [])
    assert lineage.node_depths(models).count() == 0
    assert lineage.orphans(lineage.graph_nodes(models)).count() == 0
    assert lineage.summarize(lineage.graph_nodes(models), lineage.node_depths(models)).count() == 0


def test_cycles_are_flagged(spark):
    models = graph(spark, [("a", []), ("b", ["model.p.a", "model.p.c"]), ("c", ["model.p.b"]), ("d", ["model.p.c"]), ("e", ["model.p.a"])])
    rows = {r.name: (r.depth, r.is_cyclic) for r in lineage.node_depths(models).collect()}
    assert rows == {"a": (1, False), "b": (None, True), "c": (None, True), "d": (None, True), "e": (2, False)}
    loop = graph(spark, [("s", ["model.p.s"])])
    assert {r.name: (r.depth, r.is_cyclic) for r in lineage.node_depths(loop).collect()} == {"s": (None, True)}


def test_two_projects_peel_together(spark):
    one = graph(spark, [("a", []), ("b", ["model.p.a"])])
    two = graph(spark, [("a", ["model.q.b"]), ("b", ["model.q.c"]), ("c", [])], "q")
    rows = {(r.project_id, r.name): r.depth for r in lineage.node_depths(one.union(two)).collect()}
    assert rows == {("p", "a"): 1, ("p", "b"): 2, ("q", "a"): 3, ("q", "b"): 2, ("q", "c"): 1}
    summary = lineage.summarize(lineage.graph_nodes(one.union(two)), lineage.node_depths(one.union(two)))
    assert {r.project_id: r.max_chain_depth for r in summary.collect()} == {"p": 2, "q": 3}


def test_random_graph_against_brute_force(spark):
    rng = random.Random(7)
    spec = [(f"n{i}", [f"model.p.n{j}" for j in sorted(rng.sample(range(i), min(i, rng.randint(0, 3))))]) for i in range(60)]
    longest = {}
    for name, deps in spec:
        longest[name] = 1 + max((longest[d.rsplit(".", 1)[1]] for d in deps), default=0)
    assert depths(graph(spark, spec)) == longest


def reach(links):
    """Everything that each node leads to."""
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    found = {}
    for start in {x for pair in links for x in pair}:
        seen, open_ = set(), [start]
        while open_:
            for after in out.get(open_.pop(), ()):
                if after not in seen:
                    seen.add(after)
                    open_.append(after)
        found[start] = seen
    return found


@pytest.mark.parametrize("local", [0, 14, lineage.depth.LOCAL_EDGES])
def test_cycles_against_reach(spark, local):
    """In rounds alone, in rounds and then in tasks, and in tasks alone."""
    rng = random.Random(3)
    specs = {
        "p": [(f"n{i:02}", [f"model.p.n{j:02}" for j in range(14) if rng.random() < 0.075]) for i in range(14)],
        "q": [("a", ["model.q.c"]), ("b", ["model.q.a"]), ("c", ["model.q.b"]), ("d", ["model.q.c"]), ("e", ["model.q.d", "model.q.g"]),
              ("f", ["model.q.e"]), ("g", ["model.q.f"]), ("h", ["model.q.g", "model.q.r"]), ("r", []), ("s", ["model.q.r", "model.q.s"])],
    }
    models = graph(spark, specs["p"]).union(graph(spark, specs["q"], "q"))
    want_depth, want_cycle = {}, {}
    for project, spec in specs.items():
        links = [(d.rsplit(".", 1)[1], name) for name, deps in spec for d in deps]
        leads = reach(links)
        circular = {n for n, seen in leads.items() if n in seen}
        behind = circular | {x for n in circular for x in leads[n]}
        longest = {}

        def chain(name):
            if name not in longest:
                longest[name] = 1 + max((chain(a) for a, b in links if b == name), default=0)
            return longest[name]

        for name, _ in spec:
            want_depth[project, name] = (None, True) if name in behind else (chain(name), False)
            if name in behind:
                want_cycle[project, name] = name in circular
    got = {(r.project_id, r.name): (r.depth, r.is_cyclic) for r in lineage.node_depths(models, local=local).collect()}
    assert got == want_depth and {c for c in want_cycle.values()} == {True, False}
    assert {(r.project_id, r.name): r.on_cycle for r in lineage.cycles(models, local=local).collect()} == want_cycle


@pytest.mark.parametrize("local", [0, 20])
def test_depth_in_rounds_against_brute_force(spark, local):
    rng = random.Random(9)
    spec = [(f"n{i}", [f"model.p.n{j}" for j in sorted(rng.sample(range(max(0, i - 9), i), min(i, rng.randint(0, 3))))]) for i in range(18)]
    longest = {}
    for name, deps in spec:
        longest[name] = 1 + max((longest[d.rsplit(".", 1)[1]] for d in deps), default=0)
    assert depths(graph(spark, spec), local=local) == longest


def test_a_long_chain_in_few_jobs(spark):
    chain = graph(spark, [("n0", [])] + [(f"n{i}", [f"model.p.n{i - 1}"]) for i in range(1, 60)])
    start = time.monotonic()
    assert depths(chain) == {f"n{i}": i + 1 for i in range(60)}
    assert time.monotonic() - start < 15


def test_rows_written_are_linear_in_the_edges(spark, monkeypatch):
    counts = []
    write = depth.Scratch.write

    def counted(self, df, version):
        found = write(self, df, version)
        counts.append(found[1])
        return found

    monkeypatch.setattr(depth.Scratch, "write", counted)
    spec = [("n0", [])] + [(f"n{i}", [f"model.p.n{j}" for j in range(max(0, i - 3), i)]) for i in range(1, 25)]
    edges_ = sum(len(d) for _, d in spec)
    assert max(depths(graph(spark, spec), local=0).values()) == 25
    assert sum(counts) <= 4 * edges_


def listed(df):
    return {
        r.project_id: r.path.split(">")
        for r in df.groupBy("project_id").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("place", "name")))["name"], ">").alias("path")
        ).collect()
    }


def longest_by_hand(spec):
    """The chain with the least end, then the least model before it, and so on."""
    feeds = {n: sorted({d.split(".")[-1] for d in deps} & {m for m, _ in spec}) for n, deps in spec}
    known = {}
    while True:
        new = {n: 1 + max((known[s] for s in src), default=0) for n, src in feeds.items() if n not in known and all(s in known for s in src)}
        if not new:
            break
        known.update(new)
    if not known:
        return None
    chain = [min(n for n in known if known[n] == max(known.values()))]
    while known[chain[0]] > 1:
        chain.insert(0, min(s for s in feeds[chain[0]] if known[s] == known[chain[0]] - 1))
    return chain


def test_longest_chains_equal_those_by_hand(spark):
    rng, specs = random.Random(11), {}
    for p in range(6):
        size = rng.randrange(1, 25)
        specs[f"p{p}"] = [
            (f"m{i:02}", [f"model.x.m{rng.randrange(size if p == 5 else max(i, 1)):02}" for _ in range(rng.randrange(3)) if i or p == 5])
            for i in range(size)
        ]
    specs["line"] = [(f"n{i:02}", [f"model.x.n{i - 1:02}"] if i else []) for i in range(37)]
    specs["ring"] = [("a", ["model.x.b"]), ("b", ["model.x.a"]), ("c", ["model.x.b"])]
    df = union_all([graph(spark, spec, name) for name, spec in specs.items()])
    expected = {name: longest_by_hand(spec) for name, spec in specs.items() if longest_by_hand(spec)}
    assert "ring" not in expected and len(expected["line"]) == 37
    assert listed(lineage.longest_chains(df)) == expected


def test_longest_chains_of_odd_tables(spark):
    assert lineage.longest_chains(graph(spark, [])).collect() == []
    twice = [("a", []), ("a", []), ("b", ["model.p.a", "model.p.a", "model.p.gone"])]
    assert listed(lineage.longest_chains(graph(spark, twice))) == {"p": ["a", "b"]}


def test_parts_that_fit_tasks_need_no_rounds(spark, monkeypatch):
    """A project too large for a task, of rings with a tail and of chains that are not."""

    def refuse(*_):
        raise AssertionError("rounds over the cluster")

    spec, want = [], {}
    for part in range(9):
        ring = part % 3 == 0
        for i in range(6):
            deps = [f"model.p.m{part}_{i - 1}"] * 2 if i else [f"model.p.m{part}_3"] if ring else ["model.p.gone"]
            spec.append((f"m{part}_{i}", deps))
            want[f"m{part}_{i}"] = (None, True) if ring else (i + 1, False)
    spec.append((None, ["model.p.m0_5", "model.p.m1_5"]))
    models = graph(spark, [(n or "x", d) for n, d in spec]).withColumn("name", F.when(F.col("name") != "x", F.col("name")))
    monkeypatch.setattr(depth, "_rounds", refuse)
    got = {r.name: (r.depth, r.is_cyclic) for r in lineage.node_depths(models, local=12).collect()}
    assert got == {**want, None: (None, True)}
    cycles = {r.name: r.on_cycle for r in lineage.cycles(models, local=12).collect() if r.name}
    assert cycles == {f"m{p}_{i}": i < 4 for p in (0, 3, 6) for i in range(6)}
    assert listed(lineage.longest_chains(models, local=12)) == {"p": [f"m1_{i}" for i in range(6)]}


def test_levels_of_models_that_feed_nothing_need_no_rounds(spark, monkeypatch):
    """Each customer has orders, each order lines: all of it is one part, and too large for a task."""
    monkeypatch.setattr(depth, "_rounds", None)
    spec = [("all", [])] + [(f"o{i}", ["model.p.all"]) for i in range(5)]
    spec += [(f"l{i}_{j}", [f"model.p.o{i}", "model.p.gone"]) for i in range(5) for j in range(4)]
    got = depths(graph(spark, spec), local=6)
    assert got == {n: {"a": 1, "o": 2, "l": 3}[n[0]] for n, _ in spec}


@pytest.mark.parametrize("local", [0, 9])
def test_longest_chains_of_large_projects(spark, local):
    specs = {
        "p": [("a", []), ("b", ["model.p.a"]), ("c", ["model.p.b", "model.p.a"]), ("d", ["model.p.c"]), ("e", ["model.p.c", "model.p.d"])],
        "q": [("z", []), ("y", ["model.q.gone"]), ("x", ["model.q.x"])],
        "r": [("u", ["model.r.v"]), ("v", ["model.r.u"])],
        "s": [(f"s{i}", [f"model.s.s{i - 1}"] if i % 4 else []) for i in range(16)],
    }
    df = union_all([graph(spark, spec, name) for name, spec in specs.items()])
    want = {"p": ["a", "b", "c", "d", "e"], "q": ["y"], "s": ["s8", "s9", "s10", "s11"]}
    assert listed(lineage.longest_chains(df, local=local)) == want
