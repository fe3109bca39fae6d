"""One query per operator; every query reads whole tables of the folder it is given."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as i
from tablehealth.functions import text
from tablehealth.operators import audit, drift, lineage, profile, registry, snapshots, suggest, versions
from tablehealth.plans import health
from tablehealth.sources import adhoc, footers, manifest
from tablehealth.sources.scratch import Scratch, shared_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _flat(rows: DataFrame) -> DataFrame:
    """Value lists as text, which compares the same everywhere."""
    return rows.withColumn("values", F.array_join("values", ","))


def _profile(rows: DataFrame) -> DataFrame:
    return _flat(rows).withColumnRenamed("table", "table_name").withColumnRenamed(
        "column", "column_name"
    ).withColumnRenamed("values", "value_list")


def _suggestions(rows: DataFrame) -> DataFrame:
    return _flat(rows).select(
        F.col("ordinal"),
        F.col("column").alias("column_name"),
        "rule_order",
        "test_name",
        "confidence",
        F.col("values").alias("value_list"),
        "reason",
    )


# Profiles


@query
def profile_lineitem(spark, folder):
    return _profile(profile.profile(i.table(spark, folder, "lineitem"), "lineitem"))


@query
def profile_orders(spark, folder):
    return _profile(profile.profile(i.table(spark, folder, "orders"), "orders"))


@query
def profile_nulls(spark, folder):
    return _profile(profile.profile(stage(i.labelled_documents(spark, folder)), "labelled"))


@query
def profile_all_tables(spark, folder):
    return _profile(
        profile.profile_many({name: i.table(spark, folder, name) for name in i.TABLES})
    )


@query
def likely_keys(spark, folder):
    rows = profile.profile_many(
        {n: i.table(spark, folder, n) for n in ("customer", "orders", "events", "part")}
    )
    return rows.where("is_likely_pk").select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name")
    )


@query
def profile_long_values(spark, folder):
    """Few values, each of several hundred characters, are listed whole."""
    stamps = i.table(spark, folder, "documents").select(F.repeat("lang", F.lit(200)).alias("stamp"))
    return _profile(profile.profile(stamps, "stamps"))


@query
def estimates_close(spark, folder):
    """Whether estimated distinct counts are within three standard deviations of the exact ones."""
    df = i.table(spark, folder, "lineitem")
    exact = profile.profile(df).select("ordinal", "column", F.col("unique_count").alias("exact"))
    guessed = profile.profile(df, mode="approx").select("ordinal", "unique_count")
    off = F.abs(F.col("unique_count") - F.col("exact"))
    return exact.join(guessed, "ordinal").select(
        "ordinal",
        F.col("column").alias("column_name"),
        "exact",
        (off <= F.col("exact") * 3 * 0.05).alias("is_close"),
    )


@query
def profile_approx_ranges(spark, folder):
    """The one-scan mode; its distinct counts are estimates, so they stay out of the comparison."""
    rows = profile.profile(i.table(spark, folder, "lineitem"), "lineitem", mode="approx")
    return rows.select(
        "ordinal",
        F.col("column").alias("column_name"),
        "total_rows",
        "non_null_count",
        "null_rate",
        "min_val",
        "max_val",
    )


@query
def profile_snapshots(spark, folder):
    """Order lines summarised by line number, one part a second time, and merged; estimates within three deviations."""
    lines = i.table(spark, folder, "lineitem")
    path = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    for some in ("l_linenumber < 5", "l_linenumber >= 4"):
        snapshots.save(snapshots.summarize(lines.where(some), "lineitem", F.col("l_linenumber")), path)
    exact = profile.profile(lines).select("ordinal", F.col("unique_count").alias("exact"))
    off = F.abs(F.col("unique_count") - F.col("exact"))
    return snapshots.merge(snapshots.read(spark, path)).join(exact, "ordinal").select(
        "ordinal", F.col("column").alias("column_name"), "total_rows", "non_null_count", "null_rate", "min_val",
        "max_val", (off <= F.col("exact") * 3 * snapshots.RSD).alias("is_close"),
    )


@query
def sample_rows(spark, folder):
    return profile.sample_rows(i.table(spark, folder, "orders"), 5, ["o_orderkey"])


@query
def sample_repeatable(spark, folder):
    """The same rows however the table is dealt over tasks."""
    return profile.repeatable_rows(i.table(spark, folder, "customer"), 20, "draw")


@query
def sample_values(spark, folder):
    rows = profile.sample_values(i.table(spark, folder, "orders"), "orders", 3, ["o_orderkey"])
    return rows.select(
        "ordinal",
        F.col("column").alias("column_name"),
        F.array_join("sample_values", "|").alias("sample_list"),
    )


@query
def accepted_values(spark, folder):
    parts = [
        profile.accepted_values(i.table(spark, folder, name), columns, name)
        for name, columns in (
            ("orders", ("o_orderstatus", "o_orderpriority", "o_custkey")),
            ("lineitem", ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")),
            ("events", ("event_type", "user_id")),
        )
    ]
    return profile.union_all(parts).select(
        F.col("table").alias("table_name"),
        F.col("column").alias("column_name"),
        "unique_count",
        F.array_join("values", ",").alias("value_list"),
    )


# Test suggestions


@query
def suggest_orders(spark, folder):
    return _suggestions(suggest.suggest(profile.profile(i.table(spark, folder, "orders"), "orders")))


@query
def suggest_orders_refined(spark, folder):
    """Decided from estimates and exact counts where it matters: the same suggestions."""
    return _suggestions(suggest.suggest_table(i.table(spark, folder, "orders"), "orders", mode="refined"))


@query
def suggest_nulls(spark, folder):
    rows = profile.profile(stage(i.labelled_documents(spark, folder)), "labelled")
    return _suggestions(suggest.suggest(rows))


@query
def suggest_sampled_values(spark, folder):
    orders = i.table(spark, folder, "orders")
    samples = profile.sample_values(orders, "orders", 3, ["o_orderkey"])
    rows = profile.profile(orders, "orders").join(samples.select("ordinal", "sample_values"), "ordinal")
    return _suggestions(suggest.suggest(rows, suggest.rules(values="sample", parity=True)))


@query
def id_rules(spark, folder):
    rows = profile.profile(i.events_with_gaps(spark, folder), "events")
    return _suggestions(suggest.suggest(rows))


@query
def suggestion_notes(spark, folder):
    rows = profile.profile_many(
        {n: i.table(spark, folder, n) for n in ("region", "nation", "customer")}
    )
    return suggest.notes(rows).withColumnRenamed("table", "table_name")


@query
def doc_preview(spark, folder):
    rows = profile.profile(i.table(spark, folder, "orders"), "orders")
    entries = suggest.as_test_entries(suggest.grouped(rows))
    return _registry_rows(registry.from_suggestions(entries, "p", "orders"))


@query
def doc_preview_with_profile(spark, folder):
    rows = suggest.with_tests(profile.profile(i.table(spark, folder, "orders"), "orders"))
    names = F.array_join(F.transform("tests", lambda t: t["test_name"]), ",")
    return rows.select(
        "ordinal", F.col("column").alias("column_name"), "total_rows", "null_rate", "unique_rate", names.alias("test_names")
    )


# Drift


@query
def schema_drift(spark, folder):
    rows = drift.detect(i.actual_columns(spark, folder), i.declared_columns(spark, folder))
    return rows.withColumnRenamed("table", "table_name")


@query
def schema_drift_canonical(spark, folder):
    rows = drift.detect(
        i.actual_columns(spark, folder), i.declared_columns(spark, folder), canonical=True
    )
    return rows.withColumnRenamed("table", "table_name")


@query
def drift_summary(spark, folder):
    rows = drift.summarize(
        drift.compare(i.actual_columns(spark, folder), i.declared_columns(spark, folder))
    )
    return rows.withColumnRenamed("table", "table_name")


@query
def fleet_drift(spark, folder):
    """Schemas that tasks read from the footers of many tables, against what is declared for them."""
    actual = footers.columns(i.order_tables(spark, folder)).where("error is null")
    return drift.detect(actual, i.declared_order_tables(spark, folder)).withColumnRenamed("table", "table_name")


@query
def footer_counts(spark, folder):
    """Counts and ranges of every table from footers, other ranges from a scan of their columns."""
    parts = [footers.counts(spark, name, f"{folder}/{name}.parquet", scan=True) for name in i.TABLES]
    return profile.union_all(parts).withColumnRenamed("table", "table_name").withColumnRenamed("column", "column_name")


# Manifests


def _manifests(spark, folder):
    texts = i.manifest_texts(spark, folder)
    return manifest.parse_manifests(texts, F.col("text"), F.col("project_id"))


@query
def manifest_models(spark, folder):
    models = manifest.with_summary(manifest.assets(_manifests(spark, folder)))
    return models.select(
        "project_id", "pos", "node_id", "name", "alias", "description", "original_file_path",
        "database", "schema", "materialized", "raw_sql", "compiled_sql", "has_description",
        "column_count", "documented_column_count",
        F.array_join("depends_on", ",").alias("depends_on"),
        F.array_join("tags", ",").alias("tags"),
    )


def _manifest_files(spark, folder):
    """Manifest files of many models, keyed by their folder's number."""
    path = i.manifest_files(spark, folder)
    number = F.regexp_extract(F.col("_metadata.file_path"), "project=(-?[0-9]+)", 1)
    return manifest.read_manifests(spark, path, number)


@query
def manifest_files(spark, folder):
    models = manifest.with_summary(manifest.assets(_manifest_files(spark, folder), spread=True))
    return models.select(
        "project_id", "pos", "node_id", "name", "description", "column_count", "documented_column_count",
        F.array_join("depends_on", ",").alias("depends_on"),
    )


@query
def manifest_file_sources(spark, folder):
    return manifest.sources(_manifest_files(spark, folder)).select("project_id", "pos", "source_id", "name", "identifier")


@query
def model_details(spark, folder):
    models = audit.details(manifest.assets(_manifests(spark, folder)))
    columns = F.transform("column_details", lambda c: F.concat(
        c["name"], F.when(c["has_description"], "+").otherwise("-"), F.array_join(c["test_names"], "|")
    ))
    return models.select(
        "project_id", "name", "schema", "alias", "materialized", "is_root", "sql_preview", "sql_is_cut",
        F.array_join(columns, ",").alias("column_details"), F.array_join("depends_on", ",").alias("depends_on"),
    )


@query
def manifest_columns(spark, folder):
    columns = manifest.asset_columns(manifest.assets(_manifests(spark, folder)))
    names = F.transform("tests", text.test_name)
    return columns.select(
        "project_id",
        "model",
        "pos",
        F.col("column").alias("column_name"),
        "description",
        "data_type",
        F.array_join(names, ",").alias("tests"),
    )


@query
def manifest_dependencies(spark, folder):
    return manifest.dependencies(manifest.assets(_manifests(spark, folder)))


@query
def manifest_sources(spark, folder):
    return manifest.sources(_manifests(spark, folder)).select(
        "project_id", "source_id", "name", "source_name", "identifier", "description"
    )


@query
def manifest_exposures(spark, folder):
    return manifest.exposures(_manifests(spark, folder)).select(
        "project_id", "name", "type", "description",
        F.array_join("depends_on", ",").alias("depends_on"),
    )


@query
def manifest_audit(spark, folder):
    """The audit straight from nested manifest rows, without a shuffle before the totals."""
    models = manifest.assets(_manifests(spark, folder)).withColumn("project_id", F.col("schema"))
    return audit.audit_projects(audit.audit_models(models))


@query
def list_models(spark, folder):
    return audit.list_models(manifest.assets(_manifests(spark, folder)))


@query
def model_lookup(spark, folder):
    """The first order of each customer and priority stands for all that share the name."""
    models = i.table(spark, folder, "orders").selectExpr(
        "o_orderpriority project_id",
        "concat('cust_', o_custkey) name",
        "o_orderkey pos",
        "concat('order_', o_orderkey) node_id",
        "o_totalprice total",
    )
    return audit.first_by_name(models)


@query
def model_paths(spark, folder):
    """File and node id of the first order of each priority, looked up by one name."""
    models = i.table(spark, folder, "orders").selectExpr(
        "o_orderpriority project_id",
        "if(o_orderkey % 7 = 3, 'picked', concat('o', o_orderkey)) name",
        "o_orderkey pos",
        "concat('model.shop.o', o_orderkey) node_id",
        "concat('models/', lower(o_orderstatus), '/o', o_orderkey, '.sql') original_file_path",
    )
    ids = audit.node_id(models, "picked")
    return audit.model_path(models, "picked").join(ids, "project_id")


@query
def lineage_direct(spark, folder):
    models = i.table(spark, folder, "customer").selectExpr(
        "c_mktsegment project_id",
        "c_name name",
        "c_custkey pos",
        "c_name node_id",
        "array(concat('model.geo.nation_', c_nationkey), 'source.geo.raw') depends_on",
    )
    return audit.upstream(models)


@query
def test_entry_names(spark, folder):
    entry = F.col("props")
    return i.table(spark, folder, "events").select(
        "event_id",
        text.test_name(entry).alias("test_name"),
        text.test_config(entry).alias("test_config"),
    )


# Audits


def _topics(spark, folder):
    return audit.audit_items(i.topic_models(spark, folder), i.topic_items(spark, folder))


@query
def coverage_by_group(spark, folder):
    return _topics(spark, folder).drop("layer")


@query
def project_scores(spark, folder):
    return audit.audit_projects(_topics(spark, folder))


@query
def worst_groups(spark, folder):
    return audit.worst_models(_topics(spark, folder)).select("project_id", "rank", "name", "coverage")


@query
def coverage_bands(spark, folder):
    return audit.coverage_bands(_topics(spark, folder))


@query
def naming_violations(spark, folder):
    names = i.table(spark, folder, "part").selectExpr("'parts' project_id", "p_name name").unionByName(
        i.table(spark, folder, "events").selectExpr("'events' project_id", "event_type name")
    )
    checked = names.distinct().select(
        "*",
        text.is_model_name(F.col("name")).alias("naming_ok"),
        text.naming_issue(F.col("name")).alias("naming_issue"),
    )
    return audit.naming_violations(checked)


@query
def layer_of(spark, folder):
    return i.part_names(spark, folder).select(
        "p_partkey", "name", text.layer_of(F.col("name")).alias("layer")
    )


@query
def safe_identifiers(spark, folder):
    names = i.table(spark, folder, "customer").selectExpr("c_custkey key", "c_name name").unionByName(
        i.table(spark, folder, "part").selectExpr("p_partkey key", "replace(p_name, ' ', '_') name")
    )
    return names.select("key", "name", text.is_identifier(F.col("name")).alias("is_safe"))


# Lineage


@query
def graph_nodes(spark, folder):
    return lineage.graph_nodes(i.fleet_models(spark, folder), i.fleet_exposures(spark, folder))


@query
def orphans(spark, folder):
    return lineage.orphans(graph_nodes(spark, folder))


@query
def roots(spark, folder):
    return lineage.roots(i.fleet_models(spark, folder))


@query
def fan_out(spark, folder):
    rows = lineage.fan_out(i.fleet_models(spark, folder), threshold=15)
    return rows.withColumn("consumers", F.array_join("consumers", ","))


@query
def node_depths(spark, folder):
    return lineage.node_depths(i.fleet_models(spark, folder))


@query
def graph_cycles(spark, folder):
    return lineage.cycles(i.ring_models(spark, folder))


@query
def longest_chains(spark, folder):
    chains = lineage.longest_chains(i.fleet_models(spark, folder))
    path = F.array_sort(F.collect_list(F.struct("place", "name")))
    return chains.groupBy("project_id").agg(
        F.count("*").alias("models"), F.array_join(path["name"], " > ").alias("path")
    )


@query
def max_depth(spark, folder):
    return lineage.depth_summary(lineage.node_depths(i.fleet_models(spark, folder)))


@query
def graph_summary(spark, folder):
    return lineage.summarize(graph_nodes(spark, folder), node_depths(spark, folder))


# Health


def _health(spark, folder):
    """The dashboard and the audit of the fleet, whose models are computed once."""
    models = stage(i.fleet_models(spark, folder))
    audited = audit.audit_items(models, i.fleet_items(spark, folder))
    nodes = lineage.graph_nodes(models, i.fleet_exposures(spark, folder))
    summary = lineage.summarize(nodes, lineage.node_depths(models))
    return health.dashboard(audit.audit_projects(audited), summary), audited


@query
def health_dashboard(spark, folder):
    return _health(spark, folder)[0]


@query
def health_actions(spark, folder):
    return health.dashboard_actions(*_health(spark, folder))


@query
def report_actions(spark, folder):
    return health.report_actions(audit.audit_projects(_topics(spark, folder)))


# Registry


def _registry_rows(rows):
    return rows.select(
        "project_id",
        "model",
        F.col("column").alias("column_name"),
        "pos",
        "description",
        F.array_join(F.transform("tests", lambda t: t["name"]), ",").alias("test_names"),
        F.array_join(F.transform("tests", lambda t: t["config"]), ",").alias("test_configs"),
    )


@query
def registry_merge(spark, folder):
    return _registry_rows(
        registry.merge_columns(i.registry_columns(spark, folder), i.column_proposals(spark, folder))
    )


@query
def registry_unnamed(spark, folder):
    """Proposals without a column name, empty or null, are passed over."""
    name = F.when(F.expr("pos % 3 = 0"), "").when(F.expr("pos % 5 <> 0"), F.col("column"))
    proposals = i.column_proposals(spark, folder).withColumn("column", name)
    return _registry_rows(registry.merge_columns(i.registry_columns(spark, folder), proposals))


@query
def registry_versions(spark, folder):
    """Two projects in a versioned registry; proposals touch one of them."""
    known = i.registry_columns(spark, folder)
    store = versions.Versions(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}")
    store.merge(known.unionByName(known.withColumn("project_id", F.lit("q"))))
    store.merge(i.column_proposals(spark, folder))
    return _registry_rows(store.read())


@query
def registry_models(spark, folder):
    """Nations as registered models; their customers propose descriptions, the last one stays."""
    known = i.table(spark, folder, "nation").selectExpr(
        "string(n_regionkey) project_id",
        "string(n_nationkey) model",
        "n_name description",
        "cast(array() as array<struct<name: string, config: string>>) tests",
    )
    nations = i.table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    proposals = (
        i.table(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr(
            "string(n_regionkey) project_id",
            "string(n_nationkey) model",
            "if(c_mktsegment = 'BUILDING', c_name, '') description",
            "c_custkey pos",
        )
    )
    return registry.merge_models(known, proposals).drop("tests")


@query
def documented_columns(spark, folder):
    known = i.registry_columns(spark, folder)
    return registry.documented_columns(known, "docs").select(
        "project_id",
        F.col("column").alias("column_name"),
        "pos",
        "description",
        F.array_join(F.transform("tests", lambda t: t["name"]), ",").alias("test_names"),
    )


@query
def registry_saved(spark, folder):
    """Written to a new folder and read back."""
    target = Scratch(spark, "registry").path
    registry.save(
        registry.merge_columns(i.registry_columns(spark, folder), i.column_proposals(spark, folder)),
        target,
    )
    return spark.read.parquet(target).groupBy("project_id", "model").agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum(F.size("tests")).alias("tests"),
        F.sum(F.length("description")).alias("characters"),
    )


# Guarded SQL


@query
def adhoc_sql(spark, folder):
    for name in ("orders", "customer", "nation"):
        i.table(spark, folder, name).createOrReplaceTempView(name)
    return adhoc.execute_query(
        spark,
        """
        with spending as (
          select c_nationkey, count(*) as n_orders, sum(cast(o_totalprice as decimal(18, 2))) as total
          from orders join customer on o_custkey = c_custkey
          group by c_nationkey
        )
        select n_name, n_orders, cast(total as double) as total
        from spending join nation on c_nationkey = n_nationkey
        order by total desc, n_name limit 10
        """,
    )
