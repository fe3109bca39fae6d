"""The queries of ``checks.queries`` in SQL for DuckDB, written against the same tables."""

from __future__ import annotations

# Columns of the test tables with their Spark type names.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

LABELLED = (
    "doc_id bigint, lang string, source string, quality int, toxic int",
    "(select d.doc_id, d.lang, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id))",
)

EVENTS_WITH_GAPS = (
    "user_id bigint, device_id bigint, seen_at timestamp_ntz, sent_ts timestamp_ntz, event_type string, paid double",
    """(select case when minute(ts) <> 0 then user_id end as user_id,
               case when second(ts) = 1 then 0 else event_id end as device_id,
               case when not (minute(ts) = 0 and second(ts) < 20) then ts end as seen_at,
               case when not (minute(ts) < 2 and second(ts) < 20) then ts end as sent_ts,
               event_type,
               case when minute(ts) <> 0 then value end as paid
        from events)""",
)


def _columns(schema: str) -> list[tuple[int, str, str]]:
    pairs = [part.strip().split(" ", 1) for part in schema.split(",")]
    return [(n, name, kind) for n, (name, kind) in enumerate(pairs, 1)]


def profile_sql(table: str, schema: str, source: str) -> str:
    """A SELECT per column, with raw figures first and the derived ones around them."""
    parts = []
    for ordinal, name, kind in _columns(schema):
        ranged = kind in ("int", "bigint", "double", "timestamp_ntz")
        low, high = (f"cast({f}({name}) as varchar)" if ranged else "null::varchar" for f in ("min", "max"))
        parts.append(
            f"""select {ordinal} as ordinal, '{name}' as column_name, '{kind}' as data_type,
                count(*) as total_rows, count({name}) as non_null_count,
                count(distinct {name}) as unique_count, {low} as min_val, {high} as max_val,
                case when count(distinct {name}) <= 10 then coalesce(string_agg(
                  distinct cast({name} as varchar), ',' order by cast({name} as varchar)), '') end as value_list
                from {source}"""
        )
    raw = " union all ".join(parts)
    return f"""select '{table}' as table_name, ordinal, column_name, data_type, total_rows, non_null_count,
        unique_count, true as is_exact, min_val, max_val,
        case when total_rows = 0 then 0.0 else
          cast(round_even(cast((total_rows - non_null_count) / total_rows * 100 as double), 2) as double) end as null_rate,
        case when total_rows = 0 then 0.0 else
          cast(round_even(cast(unique_count / total_rows * 100 as double), 2) as double) end as unique_rate,
        (non_null_count = total_rows and unique_count = total_rows and total_rows > 0) as is_likely_pk,
        value_list from ({raw})"""


def _profile_of(table: str) -> str:
    return profile_sql(table, SCHEMAS[table], table)


def suggest_sql(profile: str, *, parity: bool = False, values: str = "value_list") -> str:
    no_nulls = "null_rate = 0" if parity else "non_null_count = total_rows"
    time_name = "regexp_matches(lower(column_name), '(_at|_date|_ts)$')"
    id_name = "(lower(column_name) like '%\\_id' escape '\\' or lower(column_name) = 'id')"
    time_like = f"(not ({no_nulls}) and null_rate < 1 and {time_name})"
    unique = "(unique_count = total_rows and total_rows > 0)"
    rules = [
        (1, "not_null", "'high'", no_nulls, "null",
         "'All ' || total_rows || ' rows have a value'"),
        (2, "not_null", "'medium'", time_like, "null",
         "'A time that ' || null_rate || ' percent of rows lack'"),
        (3, "unique", "'high'", unique, "null",
         "format('No value repeats: {:,} in {:,} rows', unique_count, total_rows)"),
        (4, "accepted_values", f"case when {values} <> '' then 'high' else 'medium' end",
         "unique_count between 1 and 10 and total_rows >= 10", f"nullif({values}, '')",
         "'Takes only ' || unique_count || ' different values'"),
        (5, "not_null", "'medium'", f"{id_name} and not ({no_nulls}) and not {time_like} and null_rate <= 5",
         "null", "'A key that ' || null_rate || ' percent of rows lack'"),
        (6, "unique", "'medium'", f"{id_name} and not {unique} and unique_rate >= 90",
         "null", "'A key with ' || unique_rate || ' different values per hundred rows'"),
    ]
    parts = [
        f"""select ordinal, column_name, {order} as rule_order, '{test}' as test_name,
            {confidence} as confidence, cast({listed} as varchar) as value_list, {reason} as reason
            from p where {condition}"""
        for order, test, confidence, condition, listed, reason in rules
    ]
    return f"with p as ({profile}) " + " union all ".join(parts)


FLEET_MODELS = """
select 'shop' as project_id, 'model.shop.c' || c_custkey as node_id, 'c' || c_custkey as name, c_custkey as pos,
  case when c_mktsegment = 'BUILDING' then c_name else '' end as description,
  ['source.shop.nation_' || c_nationkey] as depends_on from customer
union all
select 'shop', 'model.shop.o' || o_orderkey,
  case when o_orderstatus = 'P' then 'O' else 'o' end || o_orderkey, o_orderkey,
  case o_orderpriority when '1-URGENT' then 'Urgent order' when '2-HIGH' then ' ' || chr(9) || ' ' end,
  ['model.shop.c' || o_custkey] from orders
union all
select 'shop', 'model.shop.l' || l_orderkey || '_' || l_linenumber, 'l' || l_orderkey || '_' || l_linenumber,
  l_partkey, '', ['model.shop.o' || l_orderkey, 'source.shop.part_' || l_partkey] from lineitem
union all
select 'chat', 'model.chat.c' || conv_id || '_' || turn, 'c' || conv_id || '_' || turn, conv_id * 1000 + turn,
  case when role = 'system' then 'System turn' end,
  case when turn > 0 then ['model.chat.c' || conv_id || '_' || (turn - 1)] else [] end from conversations
"""

GRAPH = f"""
models as ({FLEET_MODELS}),
links as (
  select project_id, name as dst, pos, dep_id, split_part(dep_id, '.', 3) as src, dep_pos
  from (select project_id, name, pos, unnest(depends_on) as dep_id,
          generate_subscripts(depends_on, 1) as dep_pos from models)),
consumers as (select project_id, src, count(*) as n from links group by all),
exposed as (select distinct 'shop' as project_id, 'o' || o_orderkey as src from orders
            where o_orderpriority = '1-URGENT'),
nodes as (
  select m.project_id, m.node_id, m.name, m.pos, coalesce(c.n, 0) as downstream_count,
    x.src is not null as is_exposed,
    not coalesce(list_bool_or(list_transform(m.depends_on, lambda d: starts_with(d, 'model.'))), false) as is_root
  from models m left join consumers c on c.project_id = m.project_id and c.src = m.name
  left join exposed x on x.project_id = m.project_id and x.src = m.name),
flagged as (
  select *, downstream_count = 0 and not is_exposed as is_orphan, downstream_count >= 5 as is_high_fan_out
  from nodes),
names as (select distinct project_id, name from models),
feeds as (select distinct l.project_id, l.src, l.dst from links l
          join names n on n.project_id = l.project_id and n.name = l.src where l.dep_id like 'model.%'),
walk as (
  select project_id, name, 1 as depth from names
  union all
  select f.project_id, f.dst, w.depth + 1 from walk w join feeds f on f.project_id = w.project_id and f.src = w.name),
depths as (select project_id, name, max(depth) as depth from walk group by all),
summary as (
  select s.*, d.max_chain_depth, d.max_chain_depth > 10 as is_deep, false as has_cycle
  from (select project_id, count(*) as total_models,
          count(distinct name) filter (where is_orphan) as orphan_models,
          count(*) filter (where is_root) as root_models,
          count(distinct name) filter (where is_high_fan_out) as high_fan_out_models,
          min(name) filter (where is_orphan) as first_orphan
        from flagged group by project_id) s
  join (select project_id, max(depth) as max_chain_depth from depths group by project_id) d using (project_id))
"""

# Whether a model depends on no other; ids here hold no comma.
_NO_MODELS = "not contains(',' || coalesce(array_to_string(depends_on, ','), ''), ',model.')"

# The graph without the walk over its chains, for queries that need no depth.
FLAT_GRAPH = GRAPH[: GRAPH.index("feeds as (")].rstrip().rstrip(",")

_AUDIT_FROM = r"""
counts as (
  select project_id, node_id, count(*) as total_columns,
    count(*) filter (where regexp_matches(coalesce(description, ''), '\S')) as documented_columns,
    count(*) filter (where tested) as tested_columns
  from items group by all),
audited as (
  select m.project_id, m.pos, m.node_id, m.name,
    regexp_matches(coalesce(m.description, ''), '\S') as has_description,
    length(coalesce(m.description, '')) as description_len,
    regexp_matches(m.name, '^[a-z][a-z0-9_]*$') as naming_ok,
    case when regexp_matches(m.name, '^[a-z][a-z0-9_]*$') then ''
      else 'Only small letters, digits and underscores make a model name: ' || m.name end as naming_issue,
    coalesce(c.total_columns, 0) as total_columns, coalesce(c.documented_columns, 0) as documented_columns,
    coalesce(c.tested_columns, 0) as tested_columns
  from models m left join counts c on c.project_id = m.project_id and c.node_id = m.node_id),
rated as (
  select *,
    case when total_columns = 0 then case when has_description then 1.0 else 0.0 end
      else documented_columns / total_columns end::double as doc_coverage,
    case when total_columns = 0 then 0.0 else tested_columns / total_columns end::double as test_coverage
  from audited),
totals as (
  select project_id, count(*) as total_models, count(*) filter (where has_description) as models_with_description,
    count(*) filter (where tested_columns > 0) as models_with_any_test,
    sum(total_columns)::bigint as total_columns, sum(documented_columns)::bigint as documented_columns,
    sum(tested_columns)::bigint as tested_columns, count(*) filter (where not naming_ok) as naming_violations
  from rated group by project_id),
scored as (
  select *,
    round_even((models_with_description / total_models * 100)::double, 1)::double as model_doc_score,
    case when total_columns = 0 then 100.0
      else round_even((documented_columns / total_columns * 100)::double, 1) end::double as column_doc_score,
    round_even((models_with_any_test / total_models * 100)::double, 1)::double as test_score,
    round_even(((total_models - naming_violations) / total_models * 100)::double, 1)::double as naming_score
  from totals),
scores as (
  select *, printf('%.1f', model_doc_score * 0.25::double + column_doc_score * 0.30::double
    + test_score * 0.35::double + naming_score * 0.10::double)::double as overall_score from scored),
ranked as (
  select *, doc_coverage + test_coverage as coverage,
    row_number() over (partition by project_id order by doc_coverage + test_coverage, pos, node_id) as rank
  from rated)
"""

TOPICS = f"""
models as (
  select lang as project_id, min(doc_id) as pos, source as node_id,
    case when lang = 'fr' then upper(source) else source end as name,
    max(case when n_chars > 8000 then 'Holds long documents' end) as description
  from documents group by lang, source),
items as (
  select d.lang as project_id, d.source as node_id, d.text as description, l.quality is not null as tested
  from documents d left join labels l using (doc_id)),
{_AUDIT_FROM}"""

FLEET_ITEMS = """
items as (
  select 'shop' as project_id, 'model.shop.o' || l_orderkey as node_id,
    case when l_linestatus = 'F' then 'Finished' else '' end as description, l_returnflag <> 'N' as tested
  from lineitem
  union all
  select 'chat', 'model.chat.c' || conv_id || '_' || turn, text, role = 'assistant' from conversations)"""

_HEALTH = f"with recursive {GRAPH}, {FLEET_ITEMS}, {_AUDIT_FROM}"

_ACTUAL = """(select distinct 'order_' || l_orderkey as tbl, l_linenumber::bigint as ordinal,
    case when l_returnflag = 'A' then 'Line' else 'line' end || l_linenumber as col,
    case when l_linestatus = 'F' then 'int' else 'varchar' end as kind from lineitem)"""
_DECLARED = """(select 'order_' || o_orderkey as tbl, i as pos, 'line' || i as col,
    case o_orderstatus when 'F' then 'bigint' when 'O' then 'character varying' else '' end as kind
    from orders, range(1, 5) r(i))"""


def _counts_sql(table: str, schema: str) -> str:
    """A SELECT per column: counts, and the range of what has one."""
    parts = []
    for ordinal, name, kind in _columns(schema):
        ranged = kind in ("int", "bigint", "double", "timestamp_ntz")
        value = f"{name} + 0.0" if kind == "double" else name  # files state a minimum of zero as -0.0
        low, high = (f"cast({f}({value}) as varchar)" if ranged else "null::varchar" for f in ("min", "max"))
        parts.append(
            f"""select '{table}' as table_name, {ordinal} as ordinal, '{name}' as column_name, '{kind}' as data_type,
                count(*) as total_rows, count({name}) as non_null_count, {low} as min_val, {high} as max_val from {table}"""
        )
    return " union all ".join(parts)


def _drift(agree: str) -> str:
    return f"""
    compared as (
      select coalesce(a.tbl, d.tbl) as table_name,
        case when d.tbl is null then a.col else coalesce(lower(a.col), lower(d.col)) end as column_name,
        case when d.tbl is null then 'added_in_db' when a.tbl is null then 'removed_from_db'
          when not ({agree}) then 'type_changed' end as drift_type,
        a.kind as db_type, d.kind as manifest_type, coalesce(a.ordinal, d.pos) as position
      from {_ACTUAL} a full outer join {_DECLARED} d on a.tbl = d.tbl and lower(a.col) = lower(d.col))"""


_AGREE = "d.kind = '' or contains(a.kind, d.kind) or contains(d.kind, a.kind)"
_AGREE_CANONICAL = f"{_AGREE} or (a.kind = 'varchar' and d.kind = 'character varying')"
_DRIFTED = """select *,
  case drift_type when 'added_in_db' then 1 when 'removed_from_db' then 2 else 3 end as kind_order,
  case drift_type when 'added_in_db' then 'Column ''' || column_name || ''' is not declared'
    when 'removed_from_db' then 'Column ''' || column_name || ''' is not in the table'
    else 'Type of ''' || column_name || ''': table has ' || db_type || ', declared as ' || manifest_type end as message
  from compared where drift_type is not null"""

# One order is one manifest; low-priority orders are not models.
_ORDER_MODELS = "(select *, lower(o_orderstatus) as s from orders where o_orderpriority <> '5-LOW')"

_REGISTRY = """
old as (
  select 'doc_' || doc_id as col, doc_id + 1 as pos, case when toxic = 1 then 'toxic' else '' end as description,
    case when quality = 1 then [{'name': 'not_null', 'config': null::varchar}]
      else [{'name': 'accepted_values', 'config': '{"values":["a"]}'}] end as tests
  from labels),
new as (
  select 'doc_' || doc_id as col, doc_id + 1 as pos, text as description,
    case lang when 'en' then [{'name': 'not_null', 'config': null::varchar}, {'name': 'unique', 'config': null}]
      when 'fr' then [{'name': 'accepted_values', 'config': '{"values":["b"]}'}] else [] end as tests
  from documents),
merged as (
  select coalesce(o.col, n.col) as column_name,
    coalesce(o.pos, (select max(pos) from old) + n.pos) as pos,
    coalesce(nullif(o.description, ''), nullif(n.description, ''), '') as description,
    coalesce(o.tests, []) || list_filter(coalesce(n.tests, []), lambda t: not list_contains(
      list_transform(coalesce(o.tests, []), lambda x: x.name), t.name)) as tests
  from old o full outer join new n on o.col = n.col)
"""

_P_ORDERS = _profile_of("orders")

ORACLE: dict[str, str] = {
    "profile_lineitem": _profile_of("lineitem"),
    "profile_orders": _P_ORDERS,
    "profile_nulls": profile_sql("labelled", *LABELLED),
    "profile_all_tables": " union all ".join(f"({_profile_of(t)})" for t in SCHEMAS),
    "likely_keys": " union all ".join(
        f"(select table_name, column_name from ({_profile_of(t)}) where is_likely_pk)"
        for t in ("customer", "orders", "events", "part")
    ),
    "profile_long_values": profile_sql(
        "stamps", "stamp string", "(select repeat(lang, 200) as stamp from documents)"
    ),
    "estimates_close": f"""select ordinal, column_name, unique_count as exact, true as is_close
        from ({_profile_of("lineitem")})""",
    "profile_approx_ranges": f"""select ordinal, column_name, total_rows, non_null_count, null_rate, min_val, max_val
        from ({_profile_of("lineitem")})""",
    "profile_snapshots": f"""select ordinal, column_name, total_rows, non_null_count, null_rate, min_val, max_val,
        true as is_close from ({_profile_of("lineitem")})""",
    "sample_rows": "select * from orders order by o_orderkey limit 5",
    "sample_repeatable": "select * from customer order by md5('draw' || "
    + " || ".join(
        f"coalesce(length(cast({name} as varchar)) || ':' || cast({name} as varchar), '-')"
        for _, name, _ in _columns(SCHEMAS["customer"])
    )
    + ") limit 20",
    "sample_values": "with s as (select * from orders order by o_orderkey limit 3) "
    + " union all ".join(
        f"""select {n} as ordinal, '{name}' as column_name,
            string_agg(cast({name} as varchar), '|' order by o_orderkey) as sample_list from s"""
        for n, name, _ in _columns(SCHEMAS["orders"])
    ),
    "accepted_values": " union all ".join(
        f"""select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as unique_count,
            string_agg(distinct cast({c} as varchar), ',' order by cast({c} as varchar)) as value_list
            from {t} having count(distinct {c}) <= 10"""
        for t, columns in (
            ("orders", ("o_orderstatus", "o_orderpriority", "o_custkey")),
            ("lineitem", ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")),
            ("events", ("event_type", "user_id")),
        )
        for c in columns
    ),
    "suggest_orders": suggest_sql(_P_ORDERS),
    "suggest_orders_refined": suggest_sql(_P_ORDERS),
    "suggest_nulls": suggest_sql(profile_sql("labelled", *LABELLED)),
    "suggest_sampled_values": suggest_sql(
        f"select p.* exclude (value_list), s.value_list from ({_P_ORDERS}) p join ("
        + " union all ".join(
            f"""select {n} as ordinal, string_agg(distinct cast({name} as varchar), ','
                order by cast({name} as varchar)) as value_list
                from (select * from orders order by o_orderkey limit 3)"""
            for n, name, _ in _columns(SCHEMAS["orders"])
        )
        + ") s using (ordinal)",
        parity=True,
    ),
    "id_rules": suggest_sql(profile_sql("events", *EVENTS_WITH_GAPS)),
    "suggestion_notes": " union all ".join(
        f"""select '{t}' as table_name, 'Only ' || count(*) || ' rows: suggestions may not be reliable' as note
            from {t} having count(*) < 10"""
        for t in ("region", "nation", "customer")
    ),
    "doc_preview": f"""
        with s as ({suggest_sql(_P_ORDERS)})
        select 'p' as project_id, 'orders' as model, column_name, ordinal::bigint as pos, '' as description,
          string_agg(test_name, ',' order by rule_order) as test_names,
          coalesce(string_agg('{{"values":["' || replace(value_list, ',', '","') || '"]}}', ',' order by rule_order), '')
            as test_configs
        from s group by ordinal, column_name""",
    "doc_preview_with_profile": f"""
        with p as ({_P_ORDERS}), s as ({suggest_sql(_P_ORDERS)})
        select p.ordinal, p.column_name, p.total_rows, p.null_rate, p.unique_rate,
          coalesce((select string_agg(s.test_name, ',' order by s.rule_order) from s where s.ordinal = p.ordinal), '')
            as test_names
        from p""",
    "schema_drift": f"with {_drift(_AGREE)} {_DRIFTED}",
    "schema_drift_canonical": f"with {_drift(_AGREE_CANONICAL)} {_DRIFTED}",
    "drift_summary": f"""with {_drift(_AGREE)}
        select table_name, count(drift_type) as total_drifts, count(drift_type) = 0 as is_clean,
          count(*) filter (where drift_type = 'added_in_db') as added,
          count(*) filter (where drift_type = 'removed_from_db') as removed,
          count(*) filter (where drift_type = 'type_changed') as type_changes
        from compared group by table_name""",
    "fleet_drift": """
        with tables as (
          select distinct case when o_orderstatus = 'F' then 'priced_' else 'dated_' end || o_orderkey // 1000 as table_name
          from orders),
        found(kind, column_name, drift_type, db_type, manifest_type, position, kind_order, message) as (values
          ('dated', 'o_orderpriority', 'added_in_db', 'string', null, 2, 1, 'Column ''o_orderpriority'' is not declared'),
          ('dated', 'o_totalprice', 'removed_from_db', null, 'double', 1, 2, 'Column ''o_totalprice'' is not in the table'),
          ('priced', 'o_orderdate', 'removed_from_db', null, 'timestamp_ntz', 2, 2, 'Column ''o_orderdate'' is not in the table'),
          ('priced', 'o_totalprice', 'type_changed', 'decimal(12,2)', 'double', 2, 3,
           'Type of ''o_totalprice'': table has decimal(12,2), declared as double'))
        select table_name, column_name, drift_type, db_type, manifest_type, position::bigint as position, kind_order, message
        from tables join found on starts_with(table_name, kind)""",
    "footer_counts": " union all ".join(_counts_sql(name, schema) for name, schema in SCHEMAS.items()),
    "manifest_models": f"""
        select o_orderkey::varchar as project_id, 0 as pos, 'model.shop.order_' || o_orderkey as node_id,
          'order_' || o_orderkey as name, 'order_' || o_orderkey as alias,
          case when o_orderpriority = '1-URGENT' then 'Urgent order' else '' end as description,
          'models/' || s || '/order_' || o_orderkey || '.sql' as original_file_path, 'shop' as database,
          's_' || s as schema, case when o_orderstatus = 'F' then 'table' else 'view' end as materialized,
          'select ' || o_custkey as raw_sql, '' as compiled_sql, o_orderpriority = '1-URGENT' as has_description,
          3 as column_count, 1 as documented_column_count,
          'source.shop.customer_' || o_custkey || ',model.shop.priority' as depends_on, 't' as tags
        from {_ORDER_MODELS}""",
    "model_details": f"""
        select o_orderkey::varchar as project_id, 'order_' || o_orderkey as name, 's_' || s as schema,
          'order_' || o_orderkey as alias, case when o_orderstatus = 'F' then 'table' else 'view' end as materialized,
          false as is_root, 'select ' || o_custkey as sql_preview, false as sql_is_cut,
          'o_custkey+not_null|relationships,o_orderstatus-accepted_values,o_comment-' as column_details,
          'source.shop.customer_' || o_custkey || ',model.shop.priority' as depends_on
        from {_ORDER_MODELS}""",
    "manifest_columns": f"""
        select o_orderkey::varchar as project_id, 'order_' || o_orderkey as model, c.pos, c.name as column_name,
          c.description, c.data_type, c.tests
        from {_ORDER_MODELS}, (values
          (0, 'o_custkey', 'Customer', 'bigint', 'not_null,relationships'),
          (1, 'o_orderstatus', ' ', null, 'accepted_values'),
          (2, 'o_comment', '', null, '')) c(pos, name, description, data_type, tests)""",
    "manifest_dependencies": f"""
        select o_orderkey::varchar as project_id, 'model.shop.order_' || o_orderkey as node_id,
          'order_' || o_orderkey as name, d.pos as dep_pos,
          case d.pos when 0 then 'source.shop.customer_' || o_custkey else 'model.shop.priority' end as dep_id
        from {_ORDER_MODELS}, (values (0), (1)) d(pos)""",
    "manifest_sources": """
        select o_orderkey::varchar as project_id, 'source.shop.customer_' || o_custkey as source_id,
          'customer_' || o_custkey as name, 'shop' as source_name,
          case when o_orderstatus = 'O' then 'raw_customer' else 'customer_' || o_custkey end as identifier,
          '' as description from orders""",
    "manifest_exposures": """
        select o_orderkey::varchar as project_id, 'e_' || o_orderkey as name, 'dashboard' as type,
          '' as description, 'model.shop.order_' || o_orderkey as depends_on from orders""",
    "manifest_audit": f"""
        with models as (
          select 's_' || s as project_id, 0 as pos, 'model.shop.order_' || o_orderkey as node_id,
            'order_' || o_orderkey as name,
            case when o_orderpriority = '1-URGENT' then 'Urgent order' else '' end as description
          from {_ORDER_MODELS}),
        items as (
          select 's_' || s as project_id, 'model.shop.order_' || o_orderkey as node_id, c.description, c.tested
          from {_ORDER_MODELS}, (values ('Customer', true), (' ', true), (null, false)) c(description, tested)),
        {_AUDIT_FROM} select * from scores""",
    "list_models": f"""
        select o_orderkey::varchar as project_id, 'order_' || o_orderkey as name,
          case when o_orderstatus = 'F' then 'table' else 'view' end as materialized,
          o_orderpriority = '1-URGENT' as has_description, '1/3' as columns_documented, 's_' || s as schema
        from {_ORDER_MODELS}""",
    "model_lookup": """
        select o_orderpriority as project_id, 'cust_' || o_custkey as name, min(o_orderkey) as pos,
          'order_' || min(o_orderkey) as node_id, arg_min(o_totalprice, o_orderkey) as total
        from orders group by o_orderpriority, o_custkey""",
    "model_paths": """
        select o_orderpriority as project_id, 'model.shop.o' || min(o_orderkey) as node_id,
          'models/' || lower(arg_min(o_orderstatus, o_orderkey)) || '/o' || min(o_orderkey) || '.sql' as original_file_path
        from orders where o_orderkey % 7 = 3 group by o_orderpriority""",
    "lineage_direct": """
        select c_mktsegment as project_id, c_name as name, d.pos as dep_pos,
          case d.pos when 0 then 'model.geo.nation_' || c_nationkey else 'source.geo.raw' end as dep_id
        from customer, (values (0), (1)) d(pos)""",
    "test_entry_names": """
        select event_id, json_keys(props)[1] as test_name,
          json_extract_string(props, '$.' || json_keys(props)[1]) as test_config from events""",
    "coverage_by_group": f"with {TOPICS} select * from rated",
    "project_scores": f"with {TOPICS} select * from scores",
    "worst_groups": f"with {TOPICS} select project_id, rank, name, coverage from ranked where rank <= 10",
    "coverage_bands": f"""with {TOPICS}, pct as (
          select *, round_even((test_coverage * 100)::double, 0)::int as test_pct,
            round_even((doc_coverage * 100)::double, 0)::int as doc_pct from rated)
        select project_id, pos, node_id, name, test_pct, doc_pct, tested_columns, total_columns,
          case when test_pct < 20 then 'red' when test_pct < 60 then 'yellow' else 'green' end as band from pct""",
    "naming_violations": """
        select project_id, name as model, 'Only small letters, digits and underscores make a model name: ' || name as issue
        from (select 'parts' as project_id, p_name as name from part
              union select 'events', event_type from events)
        where not regexp_matches(name, '^[a-z][a-z0-9_]*$')""",
    "layer_of": """
        select p_partkey, name,
          case when starts_with(name, 'stg_') then 'staging' when starts_with(name, 'int_') then 'intermediate'
            when starts_with(name, 'fct_') then 'marts_fact' when starts_with(name, 'dim_') then 'marts_dim'
            when starts_with(name, 'scd_') or ends_with(name, '_snapshot') then 'snapshot' else 'other' end as layer
        from (select p_partkey, case when p_size < 10 then 'stg_' when p_size < 20 then 'int_'
                when p_size < 30 then 'fct_' when p_size < 40 then 'dim_' when p_size < 45 then 'scd_' else '' end
                || replace(p_name, ' ', '_') || case when p_type = 'ECONOMY' then '_snapshot' else '' end as name
              from part)""",
    "safe_identifiers": """
        select key, name, regexp_matches(name, '^[a-zA-Z_][a-zA-Z0-9_]{0,127}$') as is_safe
        from (select c_custkey as key, c_name as name from customer
              union all select p_partkey, replace(p_name, ' ', '_') from part)""",
    "graph_nodes": f"""with models as ({FLEET_MODELS}),
        consumers as (
          select project_id, split_part(dep_id, '.', 3) as name, count(*) as n
          from (select project_id, unnest(depends_on) as dep_id from models) group by all),
        exposed as (select distinct 'o' || o_orderkey as name from orders where o_orderpriority = '1-URGENT'),
        told as (
          select m.*, coalesce(c.n, 0) as downstream_count,
            m.project_id = 'shop' and x.name is not null as is_exposed
          from models m left join consumers c using (project_id, name) left join exposed x using (name))
        select project_id, node_id, name, pos, downstream_count, is_exposed, {_NO_MODELS} as is_root,
          downstream_count = 0 and not is_exposed as is_orphan, downstream_count >= 5 as is_high_fan_out
        from told""",
    "orphans": f"with {FLAT_GRAPH} select distinct project_id, name from flagged where is_orphan",
    "roots": f"select project_id, node_id, name, pos from ({FLEET_MODELS}) where {_NO_MODELS}",
    "fan_out": f"""with {FLAT_GRAPH},
        ordered as (select *, row_number() over (partition by project_id, src order by pos, dst, dep_pos) as rn
                    from links)
        select l.project_id, l.src as model, count(*) as downstream_count,
          string_agg(l.dst, ',' order by rn) filter (where rn <= 10) as consumers
        from ordered l join names n on n.project_id = l.project_id and n.name = l.src
        group by l.project_id, l.src having count(*) >= 15""",
    "node_depths": f"""with recursive {GRAPH}
        select project_id, name, depth, false as is_cyclic from depths""",
    "manifest_files": """with placed as (
          select *, o_orderkey // 1000 as project,
            row_number() over (partition by o_orderkey // 1000 order by o_orderkey) - 1 as place from orders)
        select cast(project as varchar) as project_id, cast(place as integer) as pos,
          'model.shop.order_' || o_orderkey as node_id, 'order_' || o_orderkey as name,
          case when o_orderpriority = '1-URGENT' then 'Urgent order' else '' end as description, 2 as column_count,
          1 as documented_column_count, 'source.shop.customer_' || o_custkey as depends_on
        from placed where o_orderpriority <> '5-LOW'""",
    "manifest_file_sources": """select distinct cast(o_orderkey // 1000 as varchar) as project_id, 0 as pos,
          'source.shop.c' as source_id, 'c' as name, 'c' as identifier from orders""",
    "graph_cycles": """with rings as (select o_orderkey from orders where o_custkey % 3 = 0)
        select 'ring' as project_id, 'o' || o_orderkey as name, true as on_cycle from rings
        union all
        select distinct 'ring', 'l' || l_orderkey || '_' || l_linenumber, false
        from lineitem join rings on l_orderkey = o_orderkey""",
    "longest_chains": f"""with recursive {GRAPH},
        chain as (
          select project_id, arg_min(name, (-depth, name)) as name, max(depth) as depth from depths group by project_id
          union all
          select c.project_id, f.src, c.depth - 1 from chain c, lateral (
            select min(f.src) as src from feeds f join depths d on d.project_id = f.project_id and d.name = f.src
            where f.project_id = c.project_id and f.dst = c.name and d.depth = c.depth - 1) f
          where c.depth > 1)
        select project_id, count(*) as models, string_agg(name, ' > ' order by depth) as path from chain group by project_id""",
    "max_depth": f"""with recursive {GRAPH}
        select project_id, max(depth) as max_chain_depth, max(depth) > 10 as is_deep, false as has_cycle
        from depths group by project_id""",
    "graph_summary": f"with recursive {GRAPH} select * from summary",
    "health_dashboard": f"{_HEALTH} select * from scores join (select * exclude (total_models) from summary) using (project_id)",
    "health_actions": f"""{_HEALTH},
        board as (select * from scores join (select * exclude (total_models) from summary) using (project_id)),
        worst as (select project_id, string_agg(name, ', ' order by rank) as names from ranked where rank <= 3
                  group by project_id),
        actions as (
          select project_id, 1 as step, 'Low overall quality: see audit_project' as action from board
            where overall_score < 50
          union all select project_id, 2, 'Run suggest_tests on: ' || names from board join worst using (project_id)
            where test_score < 60
          union all select project_id, 3,
            'Review ' || orphan_models || ' orphan models (first: ' || first_orphan || ')' from board
            where orphan_models > 0
          union all select project_id, 4, 'Run generate_model_docs to document columns' from board
            where column_doc_score < 30)
        select project_id, (row_number() over (partition by project_id order by step))::int as priority, action
        from actions""",
    "report_actions": f"""with {TOPICS},
        actions as (
          select project_id, 1 as step, 'Describe undocumented models' as action from scores where model_doc_score < 80
          union all select project_id, 2, 'Run suggest_tests on the worst models' from scores where test_score < 60
          union all select project_id, 3, 'Run generate_model_docs to document columns' from scores
            where column_doc_score < 50
          union all select project_id, 4, 'Excellent project quality' from scores where overall_score >= 90)
        select project_id, (row_number() over (partition by project_id order by step))::int as priority, action
        from actions""",
    "registry_merge": f"""with {_REGISTRY}
        select 'p' as project_id, 'docs' as model, column_name, pos, description,
          coalesce(array_to_string(list_transform(tests, lambda t: t.name), ','), '') as test_names,
          coalesce(array_to_string(list_filter(list_transform(tests, lambda t: t.config), lambda c: c is not null), ','), '')
            as test_configs
        from merged""",
    "registry_unnamed": f"""with {_REGISTRY.replace("from documents", "from documents where (doc_id + 1) % 3 <> 0 and (doc_id + 1) % 5 <> 0")}
        select 'p' as project_id, 'docs' as model, column_name, pos, description,
          coalesce(array_to_string(list_transform(tests, lambda t: t.name), ','), '') as test_names,
          coalesce(array_to_string(list_filter(list_transform(tests, lambda t: t.config), lambda c: c is not null), ','), '')
            as test_configs
        from merged""",
    "registry_versions": f"""with {_REGISTRY}, kept as (
        select 'p' as project_id, * from merged
        union all by name
        select 'q' as project_id, 'doc_' || doc_id as column_name, doc_id + 1 as pos,
          case when toxic = 1 then 'toxic' else '' end as description,
          [{{'name': case when quality = 1 then 'not_null' else 'accepted_values' end,
             'config': case when quality = 1 then null else '{{"values":["a"]}}' end}}] as tests
        from labels)
        select project_id, 'docs' as model, column_name, pos, description,
          coalesce(array_to_string(list_transform(tests, lambda t: t.name), ','), '') as test_names,
          coalesce(array_to_string(list_filter(list_transform(tests, lambda t: t.config), lambda c: c is not null), ','), '')
            as test_configs
        from kept""",
    "registry_models": """
        select n_regionkey::varchar as project_id, n_nationkey::varchar as model,
          coalesce(arg_max(c_name, c_custkey) filter (where c_mktsegment = 'BUILDING' and c_name <> ''), any_value(n_name))
            as description
        from nation left join customer on c_nationkey = n_nationkey group by n_regionkey, n_nationkey""",
    "documented_columns": """
        select 'p' as project_id, 'doc_' || doc_id as column_name, doc_id + 1 as pos,
          case when toxic = 1 then 'toxic' else '' end as description,
          case when quality = 1 then 'not_null' else 'accepted_values' end as test_names from labels""",
    "registry_saved": f"""with {_REGISTRY}
        select 'p' as project_id, 'docs' as model, count(*) as columns, sum(len(tests))::bigint as tests,
          sum(length(description))::bigint as characters from merged""",
    "adhoc_sql": """
        with spending as (
          select c_nationkey, count(*) as n_orders, sum(cast(o_totalprice as decimal(18, 2))) as total
          from orders join customer on o_custkey = c_custkey group by c_nationkey)
        select n_name, n_orders, cast(total as double) as total
        from spending join nation on c_nationkey = n_nationkey order by total desc, n_name limit 10""",
}
