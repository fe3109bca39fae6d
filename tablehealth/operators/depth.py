"""Levels of lineage graphs, and the cycles in them.

Projects are graphs of their own. One whose edges fit a task is solved there, all such projects in one job. Of larger ones the
models that feed nothing are set aside first, as long as that takes at least half of the edges: their level follows from the
levels of what feeds them. What is left falls into weakly connected parts, and tasks solve many parts each. Only a part too large
for a task goes in rounds over the whole cluster: a frontier of models whose level is known fires its edges, and a model joins
the next frontier once as many edges have been fired at it as it has. Edges are stored once; a round writes a row for each
model that it fired at, so everything written is linear in the edges. As soon as what is left of a project fits a task, it is
finished there. Edges that never fire lie on a cycle or behind one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.operators.components import components
from tablehealth.sources.scratch import Scratch, stage

#: Edges of a project that one task takes.
LOCAL_EDGES = 1_000_000
#: Parts of a project go to the same task until they have this share of it.
_FILL = 4
_LEVELS = "project_id string, name string, depth int, is_cyclic boolean, on_cycle boolean, feeds boolean"
#: The name goes first: within a project it is what rows are told apart by when they are sorted.
_KEY = ["name", "project_id"]


def levels(edges: DataFrame, names: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """A row for each model at an end of an edge: ``project_id``, ``name``, ``depth``, ``is_cyclic``, ``on_cycle``, ``feeds``.

    ``edges`` (``project_id``, ``src``, ``dst``) may repeat, ``names`` (``project_id``, ``name``) are the models there are, and
    edges from anything else do not count. ``depth`` is the longest chain ending in the model, 1 for models that nothing feeds. It
    is null for models on a cycle or behind one, which ``is_cyclic``; ``on_cycle`` tells the two apart, and ``feeds`` the models
    that feed others.
    """
    return settle(told(edges, names, local))


def settle(rows: DataFrame) -> DataFrame:
    """One row per model from all that is told about it."""
    cyclic = F.bool_or("is_cyclic")
    return rows.groupBy(*_KEY).agg(
        F.when(~cyclic, F.max("depth")).alias("depth"), cyclic.alias("is_cyclic"),
        F.bool_or("on_cycle").alias("on_cycle"), F.bool_or("feeds").alias("feeds"),
    ).select("project_id", "name", "depth", "is_cyclic", "on_cycle", "feeds")


def flat(names: DataFrame) -> DataFrame:
    """What a name alone tells: a level of 1 at least."""
    no = F.lit(False)
    return names.select(
        "project_id", "name", F.lit(1).alias("depth"), no.alias("is_cyclic"), no.alias("on_cycle"), no.alias("feeds")
    )


def told(edges: DataFrame, names: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """The rows that :func:`levels` settles: each edge, once its source has a level, tells one for its end."""
    edges, total = Scratch(edges.sparkSession, "edges").write(edges.where("project_id is not null and src is not null"), 0)
    sizes = stage(edges.groupBy("project_id").agg(F.count("*").alias("edges")))
    large = F.broadcast(sizes.where(F.col("edges") > local).select("project_id"))
    if large.isEmpty():
        return _in_tasks(_known(edges, names).withColumn("base", F.lit(1)))
    many = edges.join(large, "project_id", "left_semi")
    known = stage(_sources(many, names.join(large, "project_id", "left_semi")))
    inner, count = Scratch(edges.sparkSession, "inner").write(
        _ending_in(many, known).join(known.withColumnRenamed("name", "src"), ["src", "project_id"], "left_semi")
        .select("project_id", "src", "dst").distinct(), 0
    )
    rows = _passed_on(many, stage(_with_levels(known, _inside(inner, count, local, 2 * count <= total))))
    few = F.broadcast(sizes.where(F.col("edges") <= local).select("project_id"))
    if few.isEmpty():
        return rows
    small = _known(edges.join(few, "project_id", "left_semi"), names.join(few, "project_id", "left_semi"))
    return rows.unionByName(_in_tasks(small.withColumn("base", F.lit(1))))


def _known(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges from models that there are, each once."""
    return edges.join(names.distinct().withColumnRenamed("name", "src"), ["src", "project_id"], "left_semi").select(
        "project_id", "src", "dst"
    ).distinct()


def _sources(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The models that feed others. Grouped rather than joined, so that names are not sorted."""
    ends = edges.select("project_id", F.col("src").alias("name"), F.lit(True).alias("feeds"), F.lit(False).alias("there"))
    there = names.select("project_id", "name", F.lit(False).alias("feeds"), F.lit(True).alias("there"))
    both = ends.unionByName(there).groupBy(*_KEY).agg(F.bool_or("feeds").alias("feeds"), F.bool_or("there").alias("there"))
    return both.where("feeds and there").select("project_id", "name")


def _ending_in(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.withColumnRenamed("name", "dst"), ["dst", "project_id"], "left_semi").select("project_id", "src", "dst")


def _with_levels(sources: DataFrame, inner: DataFrame) -> DataFrame:
    """Levels of the models that feed others; those without an edge among them are fed by nothing."""
    return sources.join(inner.drop("feeds"), _KEY, "left").select(
        *_KEY, F.when(~F.coalesce("is_cyclic", F.lit(False)), F.coalesce("depth", F.lit(1))).alias("depth"),
        F.coalesce("is_cyclic", F.lit(False)).alias("is_cyclic"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
        F.lit(True).alias("feeds"),
    )


def _passed_on(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The levels of models that feed others, and what they tell of the models they feed."""
    ends = edges.join(
        sources.select(F.col("name").alias("src"), "project_id", "depth", "is_cyclic"), ["src", "project_id"]
    ).select(
        "project_id", F.col("dst").alias("name"), (F.col("depth") + 1).alias("depth"), "is_cyclic",
        F.lit(False).alias("on_cycle"), F.lit(False).alias("feeds"),
    )
    return ends.unionByName(sources)


def _inside(links: DataFrame, count: int, local: int, trim: bool) -> DataFrame:
    """Levels of the models at the ends of ``links``, which are stored, each once."""
    sizes = stage(links.groupBy("project_id").agg(F.count("*").alias("edges")))
    if sizes.where(F.col("edges") > local).isEmpty():
        return _in_tasks(links.withColumn("base", F.lit(1)))
    if not trim:
        return _in_parts(links, sizes, local)
    sources = stage(links.select("project_id", F.col("src").alias("name")).distinct())
    inner, left = Scratch(links.sparkSession, "inner").write(_ending_in(links, sources), 0)
    below = _inside(inner, left, local, 2 * left <= count)
    return settle(_passed_on(links, stage(_with_levels(sources, below))))


def _in_parts(links: DataFrame, sizes: DataFrame, local: int) -> DataFrame:
    """Weakly connected parts are found on hashes of the models: two that share one only make a part of two.

    A part of up to a quarter of what a task takes shares its task with others, a larger one has its own, and one that is too large
    goes in rounds.
    """
    if not local:
        return _over_cluster(links, sizes, local)
    share = max(local // _FILL, 1)
    hashed = links.select(F.xxhash64("project_id", "src").alias("a"), F.xxhash64("project_id", "dst").alias("b"))
    roots = components(hashed, "parts").withColumnRenamed("node", "a")
    part = F.coalesce("root", "a").alias("part")
    parts = hashed.join(roots, "a", "left").groupBy(part).agg(F.count("*").alias("size"))
    wide = stage(parts.where(F.col("size") > share))
    placed = links.withColumn("a", F.xxhash64("project_id", "src")).join(roots, "a", "left").select(
        "project_id", "src", "dst", part
    ).join(F.broadcast(wide), "part", "left").join(F.broadcast(sizes), "project_id")
    shared = F.pmod("part", F.ceil(F.col("edges") / share))
    fits = placed.where(F.coalesce("size", F.lit(0)) <= local).select(
        "project_id", "src", "dst", F.lit(1).alias("base"), F.when(F.col("size").isNull(), shared).otherwise(F.col("part")).alias("part")
    )
    solved = fits.groupBy("project_id", "part").applyInPandas(_solve, _LEVELS)
    if wide.where(F.col("size") > local).isEmpty():
        return solved
    rest = stage(placed.where(F.col("size") > local).select("project_id", "src", "dst"))
    return solved.unionByName(_over_cluster(rest, stage(rest.groupBy("project_id").agg(F.count("*").alias("edges"))), local))


def _over_cluster(links: DataFrame, sizes: DataFrame, local: int) -> DataFrame:
    done, rest, stuck = _rounds(links, sizes, local)
    found = done.unionByName(_around(rest, local)) if stuck else _in_tasks(rest).drop("feeds").unionByName(done)
    return found.withColumn("feeds", F.lit(False))


def _rounds(links: DataFrame, sizes: DataFrame, local: int) -> tuple[DataFrame, DataFrame, bool]:
    """What the rounds settle, the edges left, and whether these are too many for the tasks.

    Edges left for tasks say which level their source has at least, ``base``; those without a source say it of their end.
    """
    spark = links.sparkSession
    degree = stage(links.groupBy("project_id", F.col("dst").alias("name")).agg(F.count("*").alias("degree")))
    roots = stage(links.select("project_id", F.col("src").alias("name")).distinct().join(degree, _KEY, "left_anti"))
    log, level, frontier = Scratch(spark, "fired"), 0, roots
    seen = degree.select(*_KEY, F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(False).alias("complete"))
    log.write(seen.limit(0), 0)
    every = log.all_versions(seen.schema)
    while True:
        left = (
            sizes.join(every.groupBy("project_id").agg(F.sum("now").alias("fired")), "project_id", "left")
            .agg(F.max(F.col("edges") - F.coalesce("fired", F.lit(0)))).first()[0]
        )
        if left <= local or frontier.isEmpty():
            break
        level += 1
        fired = frontier.join(links.withColumnRenamed("src", "name"), _KEY).groupBy(
            "project_id", F.col("dst").alias("name")
        ).agg(F.count("*").alias("now"))
        before = every.groupBy(*_KEY).agg(F.max("total").alias("before"))
        total = F.col("now") + F.coalesce("before", F.lit(0))
        told = fired.join(before, _KEY, "left").join(degree, _KEY).select(
            *_KEY, total.alias("total"), "now", (total == F.col("degree")).alias("complete")
        )
        frontier = log.write(told, level)[0].where("complete").select(*_KEY)
        every = log.all_versions(seen.schema)
    settled = every.where("complete").select(*_KEY, (F.col("version") + 1).alias("depth"))
    fired = settled.where(F.col("depth") <= level).select(*_KEY)
    if level:
        fired = fired.unionByName(roots)
    rest = stage(links.join(fired.withColumnRenamed("name", "src"), ["project_id", "src"], "left_anti"))
    reached = every.groupBy(*_KEY).agg((F.max("version") + 1).alias("base"))
    ends = rest.select("project_id", F.col("dst").alias("name")).unionByName(rest.select("project_id", F.col("src").alias("name"))).distinct()
    done = settled.join(ends, _KEY, "left_anti").select(
        *_KEY, "depth", F.lit(False).alias("is_cyclic"), F.lit(False).alias("on_cycle")
    ).unionByName(roots.select(
        *_KEY, F.lit(1).alias("depth"), F.lit(False).alias("is_cyclic"), F.lit(False).alias("on_cycle")
    ).join(ends, _KEY, "left_anti"))
    given = ends.join(reached, _KEY).select("project_id", F.lit(None).cast("string").alias("src"), F.col("name").alias("dst"), "base")
    if left > local:
        return done, rest, True
    return done, rest.select("*", F.lit(1).alias("base")).unionByName(given), False


def _around(links: DataFrame, local: int) -> DataFrame:
    """Models that edges lead to of which none can fire: all are on cycles or behind them.

    Edges that end nowhere or come from nowhere are trimmed, again and again; what is left lies on cycles or between them. Each
    model then takes the largest name that reaches it, and those that reach that name back are one part with it. Parts are taken
    out and the rest is trimmed again, until it fits the tasks.
    """
    spark = links.sparkSession
    cyclic = links.select("project_id", F.col("dst").alias("name")).distinct()
    parts, core, count = [], links, None
    while True:
        trims = Scratch(spark, "core")
        core, count, before = *trims.write(core, 0), None
        while count != before:
            ends = core.select("project_id", F.col("dst").alias("src")).distinct()
            starts = core.select("project_id", F.col("src").alias("dst")).distinct()
            kept = core.join(starts, ["project_id", "dst"], "left_semi").join(ends, ["project_id", "src"], "left_semi")
            before = count
            core, count = trims.write(kept.select(*links.columns), trims.last + 1)
        if not count:
            break
        if core.groupBy("project_id").count().where(F.col("count") > local).isEmpty():
            found = core.groupBy("project_id").applyInPandas(_members, "project_id string, name string")
            parts.append(stage(found))
            break
        colors = _spread(core)
        back = _reach_back(core, colors)
        size = back.groupBy("project_id", "color").agg(F.count("*").alias("size"))
        loops = core.where("src = dst").select("project_id", F.col("src").alias("name")).withColumn("loop", F.lit(True))
        part = back.join(size, ["project_id", "color"]).join(loops, _KEY, "left").where("size > 1 or loop")
        parts.append(stage(part.select(*_KEY)))
        out = back.select(*_KEY)
        core = core.join(out.withColumnRenamed("name", "src"), ["project_id", "src"], "left_anti").join(
            out.withColumnRenamed("name", "dst"), ["project_id", "dst"], "left_anti"
        ).select(*links.columns)
    on = F.lit(False)
    if parts:
        members = parts[0]
        for part in parts[1:]:
            members = members.unionByName(part)
        cyclic = cyclic.join(members.withColumn("on", F.lit(True)), _KEY, "left")
        on = F.coalesce("on", F.lit(False))
    return cyclic.select(
        *_KEY, F.lit(None).cast("int").alias("depth"), F.lit(True).alias("is_cyclic"), on.alias("on_cycle")
    )


def _spread(core: DataFrame) -> DataFrame:
    """``color``: the largest name from which each model can be reached, its own included."""
    scratch = Scratch(core.sparkSession, "color")
    nodes = core.select("project_id", F.col("src").alias("name")).unionByName(core.select("project_id", F.col("dst").alias("name")))
    colors, _ = scratch.write(nodes.distinct().withColumn("color", F.col("name")), 0)
    while True:
        sent = core.join(colors.withColumnRenamed("name", "src"), ["project_id", "src"]).groupBy(
            "project_id", F.col("dst").alias("name")
        ).agg(F.max("color").alias("sent"))
        new = F.greatest("color", "sent")
        told = colors.join(sent, _KEY, "left").select(*_KEY, new.alias("color"), (new != F.col("color")).alias("moved"))
        told, _ = scratch.write(told, scratch.last + 1)
        colors = told.select(*_KEY, "color")
        if told.where("moved").isEmpty():
            return colors


def _reach_back(core: DataFrame, colors: DataFrame) -> DataFrame:
    """The models that reach the name they are colored with, through models of that color."""
    scratch = Scratch(core.sparkSession, "back")
    own = colors.withColumnRenamed("color", "c").alias("a")
    other = colors.withColumnRenamed("color", "d").alias("b")
    same = (
        core.join(own.select("project_id", F.col("name").alias("src"), "c"), ["project_id", "src"])
        .join(other.select("project_id", F.col("name").alias("dst"), "d"), ["project_id", "dst"])
        .where("c = d").select("project_id", "src", "dst", F.col("c").alias("color"))
    )
    same = stage(same)
    new, count = scratch.write(colors.where("name = color").select(*_KEY, "color"), 0)
    while count:
        known = scratch.all_versions(new.schema).select(*_KEY)
        step = same.join(new.select("project_id", F.col("name").alias("dst")), ["project_id", "dst"], "left_semi").select(
            "project_id", F.col("src").alias("name"), "color"
        ).distinct().join(known, _KEY, "left_anti")
        new, count = scratch.write(step, scratch.last + 1)
    return scratch.all_versions(new.schema).select(*_KEY, "color")


def _in_tasks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id").applyInPandas(_solve, _LEVELS)


def _members(edges: pd.DataFrame) -> pd.DataFrame:
    """The models of one project that lie on cycles."""
    codes, names = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True))
    found = _on_cycle(codes[: len(edges)], codes[len(edges) :])
    return pd.DataFrame({"project_id": edges["project_id"].iloc[0], "name": names[sorted(set(found))]})


def _solve(edges: pd.DataFrame) -> pd.DataFrame:
    """Levels of one project from its edges. An edge without a source says that its end has at least level ``base``."""
    given = edges["src"].isna().to_numpy()
    # A model without a name is one of its own: nothing can name it as its source.
    codes, names = pd.factorize(pd.concat([edges["src"][~given], edges["dst"]], ignore_index=True), use_na_sentinel=False)
    n = int((~given).sum())
    src, every = codes[:n], codes[n:]
    dst = every[~given]
    level = np.ones(len(names), np.int64)
    base = edges["base"].to_numpy()
    np.maximum.at(level, src, base[~given])
    np.maximum.at(level, every[given], base[given])
    waits = np.bincount(dst, minlength=len(names))
    order = np.argsort(src, kind="stable")
    begin = np.searchsorted(src[order], np.arange(len(names) + 1))
    frontier = np.flatnonzero(waits == 0)
    while len(frontier):
        size = begin[frontier + 1] - begin[frontier]
        at = np.repeat(begin[frontier] - np.cumsum(size) + size, size) + np.arange(size.sum())
        hit = dst[order[at]]
        np.maximum.at(level, hit, np.repeat(level[frontier], size) + 1)
        np.subtract.at(waits, hit, 1)
        hit = np.unique(hit)
        frontier = hit[waits[hit] == 0]
    cyclic = waits > 0
    on_cycle = np.zeros(len(names), bool)
    inside = cyclic[src] & cyclic[dst]
    on_cycle[_on_cycle(src[inside], dst[inside])] = True
    out = pd.DataFrame({
        "project_id": edges["project_id"].iloc[0], "name": names,
        "depth": pd.array(np.where(cyclic, 0, level), "Int32"), "is_cyclic": cyclic, "on_cycle": on_cycle,
        "feeds": np.bincount(src, minlength=len(names)) > 0,
    })
    out.loc[cyclic, "depth"] = pd.NA
    return out


def _on_cycle(src: np.ndarray, dst: np.ndarray) -> list[int]:
    """Nodes that reach themselves: strongly connected parts of several nodes, and nodes with an edge to themselves."""
    out: dict[int, list[int]] = {}
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        out.setdefault(a, []).append(b)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    path, open_, found = [], set(), [a for a, b in zip(src.tolist(), dst.tolist(), strict=True) if a == b]
    for root in out:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        path.append(root)
        open_.add(root)
        calls = [(root, iter(out.get(root, ())))]
        while calls:
            node, rest = calls[-1]
            for after in rest:
                if after not in number:
                    number[after] = low[after] = len(number)
                    path.append(after)
                    open_.add(after)
                    calls.append((after, iter(out.get(after, ()))))
                    break
                if after in open_:
                    low[node] = min(low[node], number[after])
            else:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(path.pop())
                        open_.discard(part[-1])
                    if len(part) > 1:
                        found += part
    return found
