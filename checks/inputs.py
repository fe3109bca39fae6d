"""Catalog-like inputs that Spark derives from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehealth.operators.profile import union_all
from tablehealth.sources.scratch import shared_folder

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their label, null where there is none."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left")


def events_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a few nulls and repeats, under names that the name rules look at."""
    early = (F.minute("ts") < 2) & (F.second("ts") < 20)
    first_minute = F.minute("ts") == 0
    return table(spark, folder, "events").select(
        F.when(~first_minute, F.col("user_id")).alias("user_id"),
        F.when(F.second("ts") == 1, F.lit(0)).otherwise(F.col("event_id")).alias("device_id"),
        F.when(~(early & first_minute), F.col("ts")).alias("seen_at"),
        F.when(~early, F.col("ts")).alias("sent_ts"),
        F.col("event_type"),
        F.when(~first_minute, F.col("value")).alias("paid"),
    )


def fleet_models(spark: SparkSession, folder: str) -> DataFrame:
    """Two projects: customers, their orders and order lines; chat turns in a chain."""
    fields = ("project_id", "node_id", "name", "pos", "description", "depends_on")
    customers = table(spark, folder, "customer").selectExpr(
        "'shop' project_id",
        "concat('model.shop.c', c_custkey) node_id",
        "concat('c', c_custkey) name",
        "c_custkey pos",
        "if(c_mktsegment = 'BUILDING', c_name, '') description",
        "array(concat('source.shop.nation_', c_nationkey)) depends_on",
    )
    orders = table(spark, folder, "orders").selectExpr(
        "'shop' project_id",
        "concat('model.shop.o', o_orderkey) node_id",
        "concat(if(o_orderstatus = 'P', 'O', 'o'), o_orderkey) name",
        "o_orderkey pos",
        "case o_orderpriority when '1-URGENT' then 'Urgent order' when '2-HIGH' then ' \t ' end description",
        "array(concat('model.shop.c', o_custkey)) depends_on",
    )
    lines = table(spark, folder, "lineitem").selectExpr(
        "'shop' project_id",
        "concat('model.shop.l', l_orderkey, '_', l_linenumber) node_id",
        "concat('l', l_orderkey, '_', l_linenumber) name",
        "l_partkey pos",
        "'' description",
        "array(concat('model.shop.o', l_orderkey), concat('source.shop.part_', l_partkey)) depends_on",
    )
    turns = table(spark, folder, "conversations").selectExpr(
        "'chat' project_id",
        "concat('model.chat.c', conv_id, '_', turn) node_id",
        "concat('c', conv_id, '_', turn) name",
        "conv_id * 1000 + turn pos",
        "if(role = 'system', 'System turn', null) description",
        "if(turn > 0, array(concat('model.chat.c', conv_id, '_', turn - 1)), array()) depends_on",
    )
    return union_all([part.select(*fields) for part in (customers, orders, lines, turns)])


def ring_models(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that depend on the customer's order before; for every third customer the first depends on the last."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ends = Window.partitionBy("o_custkey")
    before = F.coalesce(
        F.lag("o_orderkey").over(by), F.when(F.col("o_custkey") % 3 == 0, F.max("o_orderkey").over(ends))
    )
    orders = table(spark, folder, "orders").withColumn("before", before).selectExpr(
        "'ring' project_id", "concat('model.ring.o', o_orderkey) node_id", "concat('o', o_orderkey) name", "o_orderkey pos",
        "if(before is null, cast(array() as array<string>), array(concat('model.ring.o', before))) depends_on",
    )
    lines = table(spark, folder, "lineitem").selectExpr(
        "'ring' project_id", "concat('model.ring.l', l_orderkey, '_', l_linenumber) node_id",
        "concat('l', l_orderkey, '_', l_linenumber) name", "l_orderkey pos",
        "array(concat('model.ring.o', l_orderkey)) depends_on",
    )
    return orders.unionByName(lines)


def fleet_exposures(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent orders are in use outside the graph."""
    return (
        table(spark, folder, "orders")
        .where("o_orderpriority = '1-URGENT'")
        .selectExpr("'shop' project_id", "array(concat('model.shop.o', o_orderkey)) depends_on")
    )


def fleet_items(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the models: the lines of an order, the text of a turn."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "'shop' project_id",
        "concat('model.shop.o', l_orderkey) node_id",
        "if(l_linestatus = 'F', 'Finished', '') description",
        "case l_returnflag when 'A' then array('not_null') when 'R' then array('unique', 'not_null') "
        "else array() end tests",
    )
    turns = table(spark, folder, "conversations").selectExpr(
        "'chat' project_id",
        "concat('model.chat.c', conv_id, '_', turn) node_id",
        "text description",
        "if(role = 'assistant', array('checked'), array()) tests",
    )
    return lines.unionByName(turns)


def topic_models(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of documents as models, languages as projects."""
    return (
        table(spark, folder, "documents")
        .groupBy("lang", "source")
        .agg(
            F.min("doc_id").alias("pos"),
            F.max(F.when(F.col("n_chars") > 8000, "Holds long documents")).alias("description"),
        )
        .selectExpr(
            "lang project_id",
            "pos",
            "source node_id",
            "if(lang = 'fr', upper(source), source) name",
            "description",
        )
    )


def topic_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as columns: described by their text, tested when labelled."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return (
        table(spark, folder, "documents")
        .join(labels, "doc_id", "left")
        .selectExpr(
            "lang project_id",
            "source node_id",
            "text description",
            "if(quality is null, array(), array('labelled')) tests",
        )
    )


MANIFEST_TEXT = (
    '{"nodes": {"model.shop.order_%1$s": {"name": "order_%1$s", "resource_type": "%2$s", '
    '"description": "%3$s", "original_file_path": "models/%4$s/order_%1$s.sql", "database": "shop", '
    '"schema": "s_%4$s", "raw_code": "select %5$s", %6$s'
    '"columns": {"o_custkey": {"description": "Customer", "data_type": "bigint", '
    '"tests": ["not_null", {"relationships": {"to": "customer", "field": "c_custkey"}}]}, '
    '"o_orderstatus": {"description": " ", "tests": [{"accepted_values": {"values": ["%4$s"]}}]}, '
    '"o_comment": {"description": null}}, '
    '"depends_on": {"nodes": ["source.shop.customer_%5$s", "model.shop.priority"]}, "tags": ["t"]}, '
    '"test.shop.t_%1$s": {"name": "t_%1$s", "resource_type": "test"}}, '
    '"sources": {"source.shop.customer_%5$s": {"name": "customer_%5$s", "source_name": "shop"%7$s}}, '
    '"exposures": {"exposure.shop.e_%1$s": {"name": "e_%1$s", "type": "dashboard", '
    '"depends_on": {"nodes": ["model.shop.order_%1$s"]}}}}'
)


def manifest_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A small manifest per order, as JSON text."""
    resource = F.when(F.col("o_orderpriority") == "5-LOW", "seed").otherwise("model")
    description = F.when(F.col("o_orderpriority") == "1-URGENT", "Urgent order").otherwise("")
    config = F.when(
        F.col("o_orderstatus") == "F", '"config": {"materialized": "table"}, '
    ).otherwise("")
    identifier = F.when(F.col("o_orderstatus") == "O", ', "identifier": "raw_customer"').otherwise("")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("project_id"),
        F.format_string(
            MANIFEST_TEXT,
            F.col("o_orderkey").cast("string"),
            resource,
            description,
            F.lower("o_orderstatus"),
            F.col("o_custkey").cast("string"),
            config,
            identifier,
        ).alias("text"),
    )


FILE_NODE = (
    '"model.shop.order_%1$s": {"name": "order_%1$s", "resource_type": "%2$s", "description": "%3$s", '
    '"columns": {"o_custkey": {"description": "Customer"}, "o_comment": {"tests": ["unique"]}}, '
    '"depends_on": {"nodes": ["source.shop.customer_%4$s"]}}'
)


def manifest_files(spark: SparkSession, folder: str) -> str:
    """A folder of manifest files with the orders of a thousand keys each, written from the table."""
    order = F.struct("o_orderkey", F.format_string(
        FILE_NODE, F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderpriority") == "5-LOW", "seed").otherwise("model"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Urgent order").otherwise(""), F.col("o_custkey").cast("string"),
    ).alias("node"))
    texts = (
        table(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("project"))
        .agg(F.array_sort(F.collect_list(order)).alias("orders"))
        .select("project", F.concat(
            F.lit('{"nodes": {'), F.array_join("orders.node", ", "),
            F.lit('}, "sources": {"source.shop.c": {"name": "c", "source_name": "shop"}}}'),
        ).alias("value"))
    )
    path = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    texts.write.partitionBy("project").text(path)
    return path


def actual_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the columns of tables, a table per order."""
    return table(spark, folder, "lineitem").selectExpr(
        "concat('order_', l_orderkey) `table`",
        "l_linenumber ordinal",
        "concat(if(l_returnflag = 'A', 'Line', 'line'), l_linenumber) `column`",
        "if(l_linestatus = 'F', 'int', 'varchar') data_type",
    )


def declared_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Four declared columns per order."""
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_orderstatus", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
        .selectExpr(
            "concat('order_', o_orderkey) `table`",
            "i pos",
            "concat('line', i) `column`",
            "case o_orderstatus when 'F' then 'bigint' when 'O' then 'character varying' else '' end data_type",
        )
    )


def order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``table``, ``path``: two tables for every thousand order keys, written here, with prices or with dates."""
    target = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").withColumn("part", F.expr("o_orderkey div 1000"))
    kinds = {
        "priced": orders.where("o_orderstatus = 'F'").selectExpr(
            "part", "o_orderkey", "cast(o_totalprice as decimal(12, 2)) o_totalprice"
        ),
        "dated": orders.where("o_orderstatus <> 'F'").selectExpr("part", "o_orderkey", "o_orderpriority", "o_orderdate"),
    }
    found = []
    for kind, rows in kinds.items():
        rows.repartition("part").write.partitionBy("part").parquet(f"{target}/{kind}")
        found.append(rows.select(
            F.concat(F.lit(f"{kind}_"), "part").alias("table"), F.concat(F.lit(f"{target}/{kind}/part="), "part").alias("path")
        ).distinct())
    return union_all(found)


def declared_order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The same three columns declared for every one of them."""
    parts = table(spark, folder, "orders").selectExpr(
        "concat(if(o_orderstatus = 'F', 'priced_', 'dated_'), o_orderkey div 1000) `table`"
    ).distinct()
    return parts.selectExpr(
        "`table`",
        "posexplode(map('O_ORDERKEY', 'bigint', 'o_totalprice', 'double', 'o_orderdate', 'timestamp_ntz'))"
        " as (pos, `column`, data_type)",
    )


def registry_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as documented columns of one model."""
    return table(spark, folder, "labels").selectExpr(
        "'p' project_id",
        "'docs' model",
        "concat('doc_', doc_id) `column`",
        "doc_id + 1 pos",
        "if(toxic = 1, 'toxic', '') description",
        """if(quality = 1, array(named_struct('name', 'not_null', 'config', string(null))),
           array(named_struct('name', 'accepted_values', 'config', '{"values":["a"]}'))) tests""",
    )


def column_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as proposed columns, described by their text."""
    return table(spark, folder, "documents").selectExpr(
        "'p' project_id",
        "'docs' model",
        "concat('doc_', doc_id) `column`",
        "doc_id + 1 pos",
        "text description",
        """case lang
           when 'en' then array(named_struct('name', 'not_null', 'config', string(null)),
                                named_struct('name', 'unique', 'config', string(null)))
           when 'fr' then array(named_struct('name', 'accepted_values', 'config', '{"values":["b"]}'))
           else cast(array() as array<struct<name: string, config: string>>) end tests""",
    )


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names with and without a layer prefix, one for each part."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey",
        """concat(case when p_size < 10 then 'stg_' when p_size < 20 then 'int_'
                       when p_size < 30 then 'fct_' when p_size < 40 then 'dim_'
                       when p_size < 45 then 'scd_' else '' end,
                  replace(p_name, ' ', '_'),
                  if(p_type = 'ECONOMY', '_snapshot', '')) name""",
    )
