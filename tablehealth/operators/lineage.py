"""Lineage graphs: consumers, orphans, roots, fan-out and depth, for many projects at once.

Input rows are models (project_id, node_id, name, pos, depends_on) and exposures
(project_id, depends_on). ``match="name"`` joins on the last segment of a dependency's id,
``match="node_id"`` on the whole id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.functions.text import last_segment
from tablehealth.operators import depth
from tablehealth.sources.scratch import Scratch, stage

# Fan-out threshold, listed consumers, depth that draws a warning, model id prefix.
HIGH_FAN_OUT = 5
LISTED_CONSUMERS = 10
DEEP = 10
MODEL_PREFIX = "model."


def edges(models: DataFrame, match: str = "name") -> DataFrame:
    """One row per dependency: ``dst`` consumes ``src``. Repeated dependencies are kept."""
    return models.select(
        "project_id",
        _key(match).alias("dst"),
        "pos",
        F.posexplode("depends_on").alias("dep_pos", "dep_id"),
    ).select("project_id", _target(match).alias("src"), "dst", "pos", "dep_pos", "dep_id")


def graph_nodes(
    models: DataFrame, exposures: DataFrame | None = None, match: str = "name"
) -> DataFrame:
    """Each model with its consumer count and whether it is exposed, an orphan, a root.

    Consumers are counted per task before the shuffle, so a model that feeds a large part of the
    graph arrives as a few rows.
    """
    by = ["src", "project_id"]  # rows are sorted by name first, as most are of a few projects
    consumers = edges(models, match).groupBy(*by).agg(
        F.count(F.lit(1)).alias("downstream_count")
    )
    nodes = models.select(
        "project_id",
        "node_id",
        "name",
        "pos",
        _key(match).alias("src"),
        (~F.exists("depends_on", lambda d: d.startswith(MODEL_PREFIX))).alias("is_root"),
    )
    joined = nodes.join(consumers, by, "left")
    if exposures is None:
        joined = joined.withColumn("is_exposed", F.lit(False))
    else:
        joined = joined.join(_exposed(exposures, match), by, "left")
    count = F.coalesce("downstream_count", F.lit(0))
    exposed = F.coalesce("is_exposed", F.lit(False))
    # Taken from the join key, the name keeps the partitioning for the steps that follow.
    name = F.col("src").alias("name") if match == "name" else F.col("name")
    return joined.select(
        "project_id",
        "node_id",
        name,
        "pos",
        count.alias("downstream_count"),
        exposed.alias("is_exposed"),
        "is_root",
        ((count == 0) & ~exposed).alias("is_orphan"),
        (count >= HIGH_FAN_OUT).alias("is_high_fan_out"),
    )


def orphans(nodes: DataFrame) -> DataFrame:
    """Names that nothing consumes and no exposure uses."""
    return nodes.where("is_orphan").select("project_id", "name").distinct()


def roots(models: DataFrame) -> DataFrame:
    """Models that depend on no other model; no shuffle."""
    return models.where(
        ~F.exists("depends_on", lambda d: d.startswith(MODEL_PREFIX))
    ).select("project_id", "node_id", "name", "pos")


def fan_out(
    models: DataFrame,
    threshold: int = HIGH_FAN_OUT,
    listed: int = LISTED_CONSUMERS,
    match: str = "name",
) -> DataFrame:
    """Models with at least ``threshold`` consumers and the first consumers in file order.

    A task keeps at most ``listed`` consumers per model before the shuffle, so no list grows with
    the fan-out.
    """
    links = edges(models, match)
    known = models.select("project_id", _key(match).alias("src")).distinct()
    hubs = (
        links.groupBy("project_id", "src")
        .agg(F.count(F.lit(1)).alias("downstream_count"))
        .where(F.col("downstream_count") >= threshold)
        .join(known, ["project_id", "src"], "left_semi")
    )
    rank = F.row_number().over(
        Window.partitionBy("project_id", "src").orderBy("pos", "dst", "dep_pos")
    )
    first = (
        links.join(hubs.select("project_id", "src"), ["project_id", "src"], "left_semi")
        .withColumn("rank", rank)
        .where(F.col("rank") <= listed)
        .groupBy("project_id", "src")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("ranked"))
    )
    return hubs.join(first, ["project_id", "src"]).select(
        "project_id",
        F.col("src").alias("model"),
        "downstream_count",
        F.transform("ranked", lambda r: r["dst"]).alias("consumers"),
    )


def by_fan_out(hubs: DataFrame) -> DataFrame:
    """Result of :func:`fan_out`, most consumers first within each project."""
    return hubs.orderBy("project_id", F.desc("downstream_count"), "model")


def node_depths(models: DataFrame, match: str = "name", local: int = depth.LOCAL_EDGES) -> DataFrame:
    """Longest chain of models ending in each model, counted in models.

    Models on a cycle or downstream of one get a null depth and ``is_cyclic``. How levels are found: see
    :func:`tablehealth.operators.depth.levels`.
    """
    names = _names(models, match)
    # Models without a link stand on level 1, and one grouping settles them with the others.
    told = depth.told(_links(models, match), names, local)
    return depth.settle(told.unionByName(depth.flat(names))).select("project_id", "name", "depth", "is_cyclic")


def cycles(models: DataFrame, match: str = "name", local: int = depth.LOCAL_EDGES) -> DataFrame:
    """The models without a depth: ``on_cycle`` tells those that reach themselves from those behind a cycle."""
    found = depth.levels(_links(models, match), _names(models, match), local)
    return found.where("is_cyclic").select("project_id", "name", "on_cycle")


def longest_chains(models: DataFrame, match: str = "name", local: int = depth.LOCAL_EDGES) -> DataFrame:
    """The longest chain of each project, a row per model on it: ``project_id``, ``place`` from 1, ``name``.

    It ends in the model with the least name among the deepest, and before each model stands the one with the least name among
    those that it consumes one level below. Only models that feed others, and the last of each chain, are looked at. Chains are
    followed by steps that double: after ``k`` joins ``2 ** k`` models of every chain are known, so a chain of a million takes
    twenty. Models on a cycle or behind one are in no chain; a project of such models alone has none.
    """
    key = ["name", "project_id"]
    names = _names(models, match)
    links = stage(_links(models, match))
    found = stage(depth.levels(links, names, local).where("name is not null"))
    place = F.col("depth").alias("place")
    deepest = F.min(F.struct((-F.col("depth")).alias("depth"), "name")).alias("last")
    last = stage(
        found.where("depth > 1").groupBy("project_id").agg(deepest)
        .select("project_id", "last.name", (-F.col("last.depth")).alias("place"))
    )
    # Where no model has a model below it, the least name alone is the chain.
    single = (
        names.join(last, "project_id", "left_anti").join(found.where("is_cyclic"), key, "left_anti")
        .groupBy("project_id").agg(F.min(F.struct("name")).alias("last"))
        .select("project_id", F.lit(1).alias("place"), "last.name").where("project_id is not null and name is not null")
    )
    lower = found.where("feeds and depth is not null").select("project_id", "name", place)
    upper = lower.where("place > 1").unionByName(last).distinct()
    before = (
        links.join(upper.withColumnRenamed("name", "dst"), ["dst", "project_id"])
        .join(lower.select("project_id", F.col("name").alias("src"), (F.col("place") + 1).alias("place")), ["src", "project_id", "place"])
        .groupBy(F.col("dst").alias("name"), "project_id").agg(F.min("src").alias("up"))
    )
    known, jumps = Scratch(models.sparkSession, "chains"), Scratch(models.sparkSession, "jumps")
    reached, new = known.write(last.select("project_id", "name"), 0)
    jump, _ = jumps.write(before, 0)
    while new:
        step = reached.join(jump, key).select("project_id", F.col("up").alias("name"))
        _, new = known.write(step, known.last + 1)
        reached = known.all_versions(reached.schema).select("project_id", "name")
        if new:
            onward = jump.select("project_id", F.col("name").alias("up"), F.col("up").alias("over"))
            jump, _ = jumps.write(
                jump.join(onward, ["up", "project_id"]).select(*key, F.col("over").alias("up")), jumps.last + 1
            )
    return reached.join(found, key).select("project_id", place, "name").unionByName(single)


def _names(models: DataFrame, match: str) -> DataFrame:
    return models.select("project_id", _key(match).alias("name"))


def _links(models: DataFrame, match: str) -> DataFrame:
    """Which model says that it is fed by which, whether or not that one is known."""
    return edges(models, match).where(F.col("dep_id").startswith(MODEL_PREFIX)).select("project_id", "src", "dst")


def summarize(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """One row per project: totals, orphans, roots, high fan-out and depth."""
    # Names may repeat within a project; orphans and hubs are counted once per name.
    per_name = nodes.groupBy("name", "project_id").agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if("is_root").alias("roots"),
        F.bool_or("is_orphan").alias("is_orphan"),
        F.bool_or("is_high_fan_out").alias("is_high_fan_out"),
    )
    shape = per_name.groupBy("project_id").agg(
        F.sum("models").alias("total_models"),
        F.count_if("is_orphan").alias("orphan_models"),
        F.sum("roots").alias("root_models"),
        F.count_if("is_high_fan_out").alias("high_fan_out_models"),
        F.min(F.when(F.col("is_orphan"), F.col("name"))).alias("first_orphan"),
    )
    return shape.join(depth_summary(depths), "project_id", "left")


def depth_summary(depths: DataFrame) -> DataFrame:
    longest = F.coalesce(F.max("depth"), F.lit(0))
    return depths.groupBy("project_id").agg(
        longest.alias("max_chain_depth"),
        (longest > DEEP).alias("is_deep"),
        F.bool_or("is_cyclic").alias("has_cycle"),
    )


def _key(match: str) -> Column:
    if match not in ("name", "node_id"):
        raise ValueError(f"match must be 'name' or 'node_id', got {match!r}")
    return F.col(match)


def _target(match: str) -> Column:
    return last_segment(F.col("dep_id")) if match == "name" else F.col("dep_id")


def _exposed(exposures: DataFrame, match: str) -> DataFrame:
    return (
        exposures.select("project_id", F.explode("depends_on").alias("dep_id"))
        .select("project_id", _target(match).alias("src"))
        .distinct()
        .withColumn("is_exposed", F.lit(True))
    )
