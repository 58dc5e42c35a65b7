"""DuckDB SQL that recomputes each registered check from the base tables.

The SQL never reads plan JSON: plan nodes, runs and diffs are rebuilt from the
relational columns of ``orders`` and ``lineitem`` (the same rules Spark uses to
derive the plan log), so the Spark path JSON -> VARIANT -> nodes is checked end
to end. Views ``region nation customer ...`` are registered by the caller.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# The test tables' columns and their catalog type names.
AS_IS_COLUMNS = {
    "region": [("r_regionkey", "integer"), ("r_name", "text")],
    "nation": [("n_nationkey", "integer"), ("n_name", "text"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "bigint"), ("c_name", "text"), ("c_nationkey", "integer"),
                 ("c_acctbal", "double precision"), ("c_mktsegment", "text")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "text"), ("s_nationkey", "integer"),
                 ("s_acctbal", "double precision")],
    "part": [("p_partkey", "bigint"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
             ("p_size", "integer"), ("p_retailprice", "double precision")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "text"),
               ("o_totalprice", "double precision"), ("o_orderdate", "timestamp without time zone"),
               ("o_orderpriority", "text"), ("o_orderstatus_or_null", "text")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "integer"), ("l_quantity", "double precision"),
                 ("l_extendedprice", "double precision"), ("l_discount", "double precision"),
                 ("l_tax", "double precision"), ("l_returnflag", "text"), ("l_linestatus", "text"),
                 ("l_shipdate", "timestamp without time zone"), ("l_returnflag_or_null", "text")],
    "events": [("event_id", "bigint"), ("ts", "timestamp without time zone"), ("user_id", "bigint"),
               ("event_type", "text"), ("value", "double precision"), ("props", "text")],
    "documents": [("doc_id", "bigint"), ("text", "text"), ("lang", "text"), ("source", "text"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "ARRAY"), ("label", "integer")],
    "pages": [("page_id", "bigint"), ("url", "text"), ("html", "text")],
    "benchmark": [("item_id", "bigint"), ("text", "text")],
    "labels": [("doc_id", "bigint"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "text"), ("text", "text")],
}
AS_IS_SOURCES = {
    "orders": "SELECT *, nullif(o_orderstatus, 'P') AS o_orderstatus_or_null FROM orders",
    "lineitem": "SELECT *, nullif(l_returnflag, 'R') AS l_returnflag_or_null FROM lineitem",
}

# The renamed tables (name -> source SQL, columns, declared key).
FK_TABLES = {
    "regions": ("SELECT r_regionkey AS id, r_name AS name FROM region",
                [("id", "integer"), ("name", "text")], "id"),
    "nations": ("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region_id FROM nation",
                [("id", "integer"), ("name", "text"), ("region_id", "integer")], "id"),
    "customers": ("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id FROM customer",
                  [("id", "bigint"), ("name", "text"), ("nation_id", "integer")], "id"),
    "suppliers": ("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation_id FROM supplier",
                  [("id", "bigint"), ("name", "text"), ("nation_id", "integer")], "id"),
    "parts": ("SELECT p_partkey AS id, p_name AS name FROM part",
              [("id", "bigint"), ("name", "text")], "id"),
    "part": ("SELECT p_partkey AS id, p_name AS name FROM part",
             [("id", "bigint"), ("name", "text")], None),
    "orders": ("SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, "
               "o_totalprice AS total FROM orders",
               [("id", "bigint"), ("customer_id", "bigint"), ("status", "text"),
                ("total", "double precision")], "id"),
    "line_items": ("SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, "
                   "l_linenumber AS line_number, l_partkey AS customer_id FROM lineitem",
                   [("order_id", "bigint"), ("part_id", "bigint"), ("supplier_id", "bigint"),
                    ("line_number", "integer"), ("customer_id", "bigint")], None),
    "events": ("SELECT event_id, user_id, event_type FROM events",
               [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "text")], "event_id"),
}
# The FK candidates the catalog rules yield for the renamed tables.
FK_CANDIDATES = [
    ("nations", "region_id", "regions", "id"),
    ("customers", "nation_id", "nations", "id"),
    ("orders", "customer_id", "customers", "id"),
    ("line_items", "order_id", "orders", "id"),
    ("line_items", "part_id", "parts", "id"),
    ("line_items", "supplier_id", "suppliers", "id"),
    ("line_items", "customer_id", "customers", "id"),
]
ORPHAN_PAIRS = FK_CANDIDATES[:6] + [
    ("suppliers", "nation_id", "nations", "id"),
    ("line_items", "customer_id", "customers", "id"),
    ("events", "user_id", "customers", "id"),
]

SAMPLED_THRESHOLD = 10_000
SAMPLE_ROWS = 20_000
AS_IS_SAMPLE_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id"}
FK_SAMPLE_KEYS = {"line_items": "order_id", "orders": "id", "events": "event_id"}


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cte_name(prefix: str, table: str) -> str:
    return f"{prefix}_{table}"


# --------------------------------------------------------------------------
# Table sources and scanned rows (full or key-hash sample).

def _sources(prefix: str, tables: dict[str, str], sampled: bool, keys: dict[str, str]) -> list[str]:
    """CTEs ``{prefix}_{t}`` (all rows), ``{prefix}_{t}_n`` (row count) and
    ``{prefix}_{t}_s`` (scanned rows)."""
    ctes = []
    for t, sql in tables.items():
        base = _cte_name(prefix, t)
        ctes.append(f"{base} AS ({sql})")
        ctes.append(f"{base}_n AS (SELECT count(*)::BIGINT AS n FROM {base})")
        if sampled:
            small = f"(SELECT n FROM {base}_n) < {SAMPLED_THRESHOLD}"
            pct = (f"least(100.0::DOUBLE, greatest(0.01::DOUBLE, "
                   f"{SAMPLE_ROWS}::DOUBLE / (SELECT n FROM {base}_n) * 100.0::DOUBLE))")
            ctes.append(f"{base}_p AS (SELECT CASE WHEN {small} THEN 100.0::DOUBLE ELSE {pct} END AS pct, "
                        f"NOT ({small}) AS sampled)")
            cond = "true"
            if t in keys:
                bucket = f"(('0x' || substr(md5(CAST({_q(keys[t])} AS VARCHAR)), 1, 8))::BIGINT % 10000)"
                cond = f"{small} OR {bucket} < {pct} * 100.0::DOUBLE"
            ctes.append(f"{base}_s AS (SELECT * FROM {base} WHERE {cond})")
        else:
            ctes.append(f"{base}_p AS (SELECT 100.0::DOUBLE AS pct, false AS sampled)")
            ctes.append(f"{base}_s AS (SELECT * FROM {base})")
    return ctes


def _stats(prefix: str, columns: dict[str, list[tuple[str, str]]]) -> str:
    """Statistics rows, one per (table, column)."""
    parts = []
    for t, cols in columns.items():
        base = _cte_name(prefix, t)
        for i, (c, dtype) in enumerate(cols, start=1):
            parts.append(
                f"SELECT {_lit(t)} AS table_name, {_lit(c)} AS column_name, {i}::BIGINT AS column_ordinal, "
                f"{_lit(dtype)} AS data_type, (SELECT n FROM {base}_n) AS row_count, "
                f"count(*)::BIGINT AS scanned_rows, "
                f"(count(*) FILTER (WHERE {_q(c)} IS NULL))::BIGINT AS null_count, "
                f"count(DISTINCT {_q(c)})::BIGINT AS distinct_count, "
                f"(SELECT sampled FROM {base}_p) AS sampled, (SELECT pct FROM {base}_p) AS sample_percent "
                f"FROM {base}_s")
    return "\nUNION ALL\n".join(parts)


def _value_lists(prefix: str, columns: dict[str, list[tuple[str, str]]]) -> str:
    parts = []
    for t, cols in columns.items():
        base = _cte_name(prefix, t)
        for c, dtype in cols:
            if dtype != "text" and "character" not in dtype:
                continue
            parts.append(
                f"SELECT {_lit(t)} AS table_name, {_lit(c)} AS column_name, "
                f"string_agg(q, ', ' ORDER BY v) AS in_list FROM ("
                f"SELECT DISTINCT {_q(c)} AS v, '''' || replace({_q(c)}, '''', '''''') || '''' AS q "
                f"FROM {base}_s WHERE {_q(c)} IS NOT NULL "
                f"AND (SELECT count(DISTINCT {_q(c)}) FROM {base}_s) <= 12)")
    return "\nUNION ALL\n".join(parts)


def _profile_ctes(prefix, tables_sql, columns, sampled, keys) -> list[str]:
    ctes = _sources(prefix, tables_sql, sampled, keys)
    ctes.append(f"stats AS ({_stats(prefix, columns)})")
    ctes.append(f"vals AS ({_value_lists(prefix, columns)})")
    return ctes


def _as_is_ctes(sampled: bool) -> list[str]:
    tables_sql = {t: AS_IS_SOURCES.get(t, f"SELECT * FROM {t}") for t in AS_IS_COLUMNS}
    return _profile_ctes("a", tables_sql, AS_IS_COLUMNS, sampled, AS_IS_SAMPLE_KEYS)


def _fk_ctes(sampled: bool) -> list[str]:
    tables_sql = {t: v[0] for t, v in FK_TABLES.items()}
    columns = {t: v[1] for t, v in FK_TABLES.items()}
    return _profile_ctes("f", tables_sql, columns, sampled, FK_SAMPLE_KEYS)


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --------------------------------------------------------------------------
# Inference rules over ``stats`` (and ``vals``); ``decl`` lists declared keys.

_W = "table_name || '.' || column_name"
_SEV = "CASE WHEN sampled THEN 'INFO' ELSE 'SUGGEST' END"
_SUFFIX = "CASE WHEN sampled THEN ' (sampled)' ELSE '' END"


def _qi(expr: str) -> str:
    return f"'\"' || replace({expr}, '\"', '\"\"') || '\"'"


def _finding_select(rule_id: str, title: str, detail: str, sql: str) -> str:
    return (f"SELECT {_lit(rule_id)} AS rule_id, {_SEV} AS severity, {title} AS title, {detail} AS detail, "
            f"'column' AS location_kind, {_W} AS location_identifier, 'ddl' AS suggestion_kind, "
            f"{sql} AS suggestion_sql, table_name, column_name")


def _not_null_sql(not_null: set[tuple[str, str]]) -> str:
    declared = " AND ".join(f"NOT (table_name = {_lit(t)} AND column_name = {_lit(c)})" for t, c in not_null) or "true"
    return (_finding_select(
        "inferencer.not_null",
        f"'`' || {_W} || '` is never null but is declared nullable'",
        f"'No NULLs found in ' || CAST(scanned_rows AS VARCHAR) || ' rows' || {_SUFFIX} || "
        f"'. Consider declaring `' || {_W} || '` NOT NULL.'",
        f"'ALTER TABLE ' || {_qi('table_name')} || ' ALTER COLUMN ' || {_qi('column_name')} || ' SET NOT NULL'")
        + f" FROM stats WHERE row_count > 0 AND scanned_rows > 0 AND null_count = 0 AND {declared}")


def _unique_sql(unique: set[tuple[str, str]]) -> str:
    declared = " AND ".join(f"NOT (table_name = {_lit(t)} AND column_name = {_lit(c)})" for t, c in unique) or "true"
    return (_finding_select(
        "inferencer.unique",
        f"'`' || {_W} || '` looks unique but has no unique constraint'",
        f"'All ' || CAST(scanned_rows AS VARCHAR) || ' scanned values are distinct' || {_SUFFIX} || "
        f"'. Consider a UNIQUE constraint on `' || {_W} || '`.'",
        f"'ALTER TABLE ' || {_qi('table_name')} || ' ADD CONSTRAINT ' || table_name || '_' || column_name || "
        f"'_key UNIQUE (' || {_qi('column_name')} || ')'")
        + f" FROM stats WHERE scanned_rows > 0 AND distinct_count = scanned_rows AND {declared}")


def _enum_sql() -> str:
    return (_finding_select(
        "inferencer.enum",
        f"'`' || {_W} || '` has only ' || CAST(distinct_count AS VARCHAR) || ' distinct values (candidate enum)'",
        f"'Values seen: ' || in_list || {_SUFFIX} || '. A CHECK constraint would enforce the allowed set.'",
        f"'ALTER TABLE ' || {_qi('table_name')} || ' ADD CONSTRAINT ' || table_name || '_' || column_name || "
        f"'_check CHECK (' || {_qi('column_name')} || ' IN (' || in_list || '))'")
        + " FROM stats JOIN vals USING (table_name, column_name) "
          "WHERE (data_type = 'text' OR data_type LIKE '%character%') AND distinct_count BETWEEN 1 AND 12 "
          "AND distinct_count < scanned_rows AND in_list IS NOT NULL")


def _ratio_select(prefix: str, ct: str, cc: str, pt: str, pc: str) -> str:
    child = _cte_name(prefix, ct) + "_s"
    parent = _cte_name(prefix, pt)
    return (f"SELECT {_lit(ct)} AS child_table, {_lit(cc)} AS child_column, {_lit(pt)} AS parent_table, "
            f"{_lit(pc)} AS parent_column, count(*)::BIGINT AS child_rows, "
            f"(count(*) FILTER (WHERE p.k IS NULL))::BIGINT AS orphan_rows, "
            f"coalesce((count(*) FILTER (WHERE p.k IS NULL))::DOUBLE / nullif(count(*), 0), 0.0::DOUBLE) AS orphan_ratio, "
            f"(SELECT sampled FROM {_cte_name(prefix, ct)}_p) AS sampled "
            f"FROM {child} c LEFT JOIN (SELECT DISTINCT {_q(pc)} AS k FROM {parent} WHERE {_q(pc)} IS NOT NULL) p "
            f"ON c.{_q(cc)} = p.k WHERE c.{_q(cc)} IS NOT NULL")


def _fk_findings(prefix: str) -> str:
    ratios = "\nUNION ALL\n".join(_ratio_select(prefix, *p) for p in FK_CANDIDATES)
    nonempty = " AND ".join(
        f"NOT (child_table = {_lit(t)} AND (SELECT n FROM {_cte_name(prefix, t)}_n) = 0)"
        for t in sorted({p[0] for p in FK_CANDIDATES}))
    w = "child_table || '.' || child_column"
    return (
        f"SELECT 'inferencer.fk_overlap' AS rule_id, {_SEV} AS severity, "
        f"'`' || {w} || '` looks like an undeclared foreign key to `' || parent_table || '`' AS title, "
        f"'Every non-null `' || child_column || '` value matches a `' || parent_table || '.' || parent_column || '`' "
        f"|| {_SUFFIX} || '. A FOREIGN KEY would enforce referential integrity.' AS detail, "
        f"'column' AS location_kind, {w} AS location_identifier, 'ddl' AS suggestion_kind, "
        f"'ALTER TABLE ' || {_qi('child_table')} || ' ADD CONSTRAINT ' || child_table || '_' || child_column || "
        f"'_fkey FOREIGN KEY (' || {_qi('child_column')} || ') REFERENCES ' || {_qi('parent_table')} || "
        f"' (' || {_qi('parent_column')} || ')' AS suggestion_sql, "
        f"child_table AS table_name, child_column AS column_name "
        f"FROM ({ratios}) r WHERE orphan_ratio <= 0.0 AND {nonempty}")


def _fk_declared() -> tuple[set, set]:
    keys = {(t, v[2]) for t, v in FK_TABLES.items() if v[2]}
    return keys, keys


def _infer_as_is(rules: list[str], sampled: bool = False) -> str:
    bodies = []
    if "not_null" in rules:
        bodies.append(_not_null_sql(set()))
    if "unique" in rules:
        bodies.append(_unique_sql(set()))
    if "enum" in rules:
        bodies.append(_enum_sql())
    return _with(_as_is_ctes(sampled), "\nUNION ALL\n".join(bodies))


def _infer_fk(rules: list[str], sampled: bool = False) -> str:
    not_null, unique = _fk_declared()
    bodies = []
    if "not_null" in rules:
        bodies.append(_not_null_sql(not_null))
    if "unique" in rules:
        bodies.append(_unique_sql(unique))
    if "enum" in rules:
        bodies.append(_enum_sql())
    if "fk" in rules:
        bodies.append(_fk_findings("f"))
    return _with(_fk_ctes(sampled), "\nUNION ALL\n".join(bodies))


def _ddl_script() -> str:
    inner = _infer_fk(["not_null", "unique", "enum", "fk"])
    return f"SELECT suggestion_sql || ';' AS statement FROM ({inner}) x WHERE suggestion_sql IS NOT NULL"


def _infer_report() -> str:
    inner = _infer_fk(["not_null", "unique", "enum", "fk"])
    return (f"SELECT severity || ': ' || title || CASE WHEN suggestion_sql IS NOT NULL "
            f"THEN chr(10) || '    ' || suggestion_sql || ';' ELSE '' END AS line FROM ({inner}) x")


def _profile(sampled: bool) -> str:
    cols = ("table_name, column_name, column_ordinal, data_type, row_count, scanned_rows, null_count, "
            "distinct_count, sampled")
    if sampled:
        cols += ", sample_percent"
    return _with(_as_is_ctes(sampled), f"SELECT {cols} FROM stats")


def _orphan_ratio() -> str:
    ctes = _sources("f", {t: v[0] for t, v in FK_TABLES.items()}, False, {})
    return _with(ctes, "\nUNION ALL\n".join(_ratio_select("f", *p) for p in ORPHAN_PAIRS))


# --------------------------------------------------------------------------
# Plan log rebuilt from orders and lineitem.

_LINE_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
               "l_returnflag, l_linestatus, l_shipdate")

PLAN_CTES = [
    "runs AS (SELECT o_orderkey AS run_id, "
    "sha256('select * from orders where o_custkey = ' || CAST(o_custkey AS VARCHAR) || ' and note <> ''As Is''') AS query_hash, "
    "'r' || CAST(o_orderkey % 10 AS VARCHAR) AS git_ref, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 END AS execution_time_ms, "
    "o_totalprice / 100000 AS planning_time_ms, "
    "o_totalprice / 1000 AS root_cost FROM orders)",
    f"li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS child_pos, "
    "l_linenumber % 4 AS m4 FROM lineitem)",
    "li2 AS (SELECT *, 2 + coalesce(sum(CASE WHEN m4 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey "
    "ORDER BY child_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node_ord, "
    "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 10 = 0 THEN 0.0::DOUBLE "
    "ELSE floor(l_extendedprice)::DOUBLE END AS act FROM li)",
    "kids AS (SELECT l_orderkey, count(*) + count(*) FILTER (WHERE m4 = 0) AS n_below, "
    "max(l_partkey * 10)::DOUBLE AS max_loops FROM li GROUP BY l_orderkey)",
    "summ AS (SELECT r.*, (1 + coalesce(k.n_below, 0))::BIGINT AS node_count FROM runs r "
    "LEFT JOIN kids k ON k.l_orderkey = r.run_id)",
    "nodes0 AS ("
    "SELECT r.run_id, 1::BIGINT AS node_ord, 0 AS depth, 'NESTED_LOOP' AS node_type, NULL::VARCHAR AS relation, "
    "100.0::DOUBLE AS estimated_rows, 950.0::DOUBLE AS actual_rows, r.root_cost AS estimated_cost, "
    "1.0::DOUBLE AS loops, coalesce(k.max_loops, 0.0::DOUBLE) AS max_child_loops, "
    "NULL::VARCHAR AS sort_method, NULL::VARCHAR AS sort_space_used "
    "FROM runs r LEFT JOIN kids k ON k.l_orderkey = r.run_id "
    "UNION ALL "
    "SELECT l_orderkey, node_ord::BIGINT, 1, "
    "CASE m4 WHEN 0 THEN 'SORT' WHEN 1 THEN 'SEQ_SCAN' WHEN 2 THEN 'INDEX_SCAN' ELSE 'UNKNOWN' END, "
    "CASE WHEN m4 IN (1, 2) THEN CASE l_returnflag WHEN 'A' THEN 'orders' WHEN 'N' THEN 'customers' "
    "WHEN 'R' THEN 'parts' END END, "
    "l_quantity, act, l_extendedprice / 100, (l_partkey * 10)::DOUBLE, "
    "CASE WHEN m4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, "
    "CASE WHEN m4 = 0 THEN CASE WHEN l_tax > 0.04 THEN 'External Merge' ELSE 'quicksort' END END, "
    "CASE WHEN m4 = 0 THEN CAST(l_partkey AS VARCHAR) END "
    "FROM li2 "
    "UNION ALL "
    "SELECT l_orderkey, (node_ord + 1)::BIGINT, 2, 'SEQ_SCAN', 'orders', (l_partkey * 100)::DOUBLE, NULL, "
    "l_extendedprice / 200, 1.0::DOUBLE, 0.0::DOUBLE, NULL, NULL FROM li2 WHERE m4 = 0)",
    "nodes AS (SELECT *, actual_rows * loops AS total_actual_rows, "
    "CASE WHEN actual_rows * loops > 0 AND estimated_rows > 0 THEN "
    "greatest(estimated_rows / (actual_rows * loops), (actual_rows * loops) / estimated_rows) END "
    "AS misestimate_factor, NULL::DOUBLE AS actual_time_ms FROM nodes0)",
]

_NODE_COLS = ("run_id, node_ord, depth, node_type, relation, estimated_rows, actual_rows, estimated_cost, "
              "actual_time_ms, loops, total_actual_rows, misestimate_factor, max_child_loops, "
              "CASE WHEN misestimate_factor >= 100 THEN 'high' WHEN misestimate_factor >= 10 THEN 'medium' "
              "ELSE 'none' END AS heat")

_RULES = {
    "seq_scan": (
        "SELECT 'advisor.seq_scan' AS rule_id, 'WARN' AS severity, "
        "'Seq Scan over large table `' || relation || '`' AS title, "
        "'Sequential scan reads ~' || CAST(CAST(trunc(rws) AS BIGINT) AS VARCHAR) || ' rows from `' || relation || "
        "'`. Consider an index on the filtered columns.' AS detail, "
        "'table' AS location_kind, relation AS location_identifier, 'note' AS suggestion_kind, "
        "'Inspect the WHERE/JOIN predicates on `' || relation || '` for an index candidate.' AS suggestion_note, "
        "run_id, node_ord FROM (SELECT *, coalesce(nullif(total_actual_rows, 0.0), estimated_rows) AS rws "
        "FROM nodes) WHERE node_type = 'SEQ_SCAN' AND relation IS NOT NULL AND rws >= 10000"),
    "row_estimate": (
        "SELECT 'advisor.row_estimate', 'WARN', "
        "'Row estimate off by ' || format('{:.0f}', misestimate_factor) || '× at ' || coalesce(relation, node_type), "
        "'Planner estimated ' || CAST(CAST(trunc(estimated_rows) AS BIGINT) AS VARCHAR) || ' rows but got ' || "
        "CAST(CAST(trunc(total_actual_rows) AS BIGINT) AS VARCHAR) || '. Bad estimates lead to bad plans.', "
        "'plan_node', coalesce(relation, node_type), 'note', "
        "CASE WHEN relation IS NOT NULL THEN 'Run ANALYZE on `' || relation || "
        "'`; consider extended statistics if columns are correlated.' ELSE 'Run ANALYZE on the involved tables.' END, "
        "run_id, node_ord FROM nodes WHERE misestimate_factor >= 100"),
    "sort_spill": (
        "SELECT 'advisor.sort_spill', 'SUGGEST', 'Sort spilled to disk (external merge)', "
        "'A Sort node used an external merge (~' || coalesce(sort_space_used, 'None') || "
        "' kB on disk). Raising work_mem may keep this sort in memory.', 'plan_node', 'Sort', 'note', "
        "'Increase work_mem for this session/query, or reduce the sorted set.', run_id, node_ord "
        "FROM nodes WHERE node_type = 'SORT' AND lower(coalesce(sort_method, '')) LIKE '%external%'"),
    "nested_loop": (
        "SELECT 'advisor.nested_loop', 'WARN', "
        "'Nested loop iterating ' || CAST(CAST(trunc(max_child_loops) AS BIGINT) AS VARCHAR) || '×', "
        "'A nested-loop join runs its inner side a very high number of times. If the planner misestimated "
        "rows, a hash/merge join may be far cheaper.', 'plan_node', 'Nested Loop', 'note', "
        "'Check row estimates on the outer side; ensure the join keys are indexed.', run_id, node_ord "
        "FROM nodes WHERE node_type = 'NESTED_LOOP' AND max_child_loops >= 10000"),
    "unused_index": (
        "SELECT 'advisor.unused_index', 'INFO', 'Seq Scan on `' || relation || '` despite existing index', "
        "'`' || relation || '` has secondary index(es) [ix_orders_customer_id, ix_orders_status] but this query "
        "used a Seq Scan. The predicate may not match the index, or the planner judged the scan cheaper.', "
        "'table', relation, NULL::VARCHAR, NULL::VARCHAR, run_id, node_ord "
        "FROM nodes WHERE node_type = 'SEQ_SCAN' AND relation = 'orders'"),
}


_FINDING_NAMES = ("rule_id, severity, title, detail, location_kind, location_identifier, suggestion_kind, "
                  "suggestion_note, run_id, node_ord")


def _named(rule_sql: str) -> str:
    return f"SELECT * FROM ({rule_sql}) AS f({_FINDING_NAMES})"


def _plan(body: str, extra: list[str] | None = None) -> str:
    return _with(PLAN_CTES + (extra or []), body)


_ALL_RULES = "\nUNION ALL\n".join(_RULES[k] for k in
                                  ["seq_scan", "row_estimate", "sort_spill", "nested_loop", "unused_index"])

_PAIRS = ("pairs AS (SELECT s.*, lag(run_id) OVER (PARTITION BY query_hash ORDER BY run_id) AS prev_run_id "
          "FROM summ s)")
_DIFFS = (
    "diffs AS (SELECT a.run_id, a.query_hash, a.git_ref, a.prev_run_id, "
    "CASE WHEN a.prev_run_id IS NULL THEN NULL "
    "WHEN b.node_count <> a.node_count THEN 'STRUCTURE_CHANGED' "
    "WHEN coalesce(b.execution_time_ms, b.root_cost) IS NULL OR coalesce(a.execution_time_ms, a.root_cost) IS NULL "
    "OR coalesce(b.execution_time_ms, b.root_cost) = 0 THEN 'SAME' "
    "WHEN coalesce(a.execution_time_ms, a.root_cost) < coalesce(b.execution_time_ms, b.root_cost) * 0.9::DOUBLE "
    "THEN 'FASTER' "
    "WHEN coalesce(a.execution_time_ms, a.root_cost) > coalesce(b.execution_time_ms, b.root_cost) * 1.1::DOUBLE "
    "THEN 'SLOWER' ELSE 'SAME' END AS verdict, "
    "CASE WHEN a.prev_run_id IS NULL THEN NULL ELSE b.node_count = a.node_count END AS aligned, "
    "b.node_count AS node_count_before, a.node_count AS node_count_after, "
    "b.execution_time_ms AS time_before_ms, a.execution_time_ms AS time_after_ms, "
    "CASE WHEN a.prev_run_id IS NULL THEN NULL ELSE coalesce(b.execution_time_ms, b.root_cost) END AS metric_before, "
    "coalesce(a.execution_time_ms, a.root_cost) AS metric_after, "
    "CASE WHEN a.prev_run_id IS NULL THEN NULL WHEN b.execution_time_ms IS NOT NULL THEN 'execution_time' "
    "ELSE 'root_cost' END AS metric_before_kind, "
    "CASE WHEN a.execution_time_ms IS NOT NULL THEN 'execution_time' ELSE 'root_cost' END AS metric_after_kind "
    "FROM pairs a LEFT JOIN summ b ON b.run_id = a.prev_run_id)"
)


def _node_deltas() -> str:
    # the shared parts are computed once, and the two sides of a pair meet by the
    # pair's own number and the position
    ctes = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in PLAN_CTES + [_PAIRS, _DIFFS]]
    ctes.append("aligned AS MATERIALIZED (SELECT run_id, prev_run_id FROM diffs WHERE aligned)")
    ctes.append("before AS MATERIALIZED (SELECT p.run_id, n.node_ord, n.node_type, n.relation, n.estimated_cost, "
                "n.estimated_rows, n.actual_time_ms FROM aligned p JOIN nodes n ON n.run_id = p.prev_run_id)")
    return _with(
        ctes,
        "SELECT a.run_id, p.prev_run_id, a.node_ord, a.node_type, coalesce(nullif(a.relation, ''), b.relation) AS relation, "
        "b.estimated_cost AS cost_before, a.estimated_cost AS cost_after, "
        "b.estimated_rows AS rows_before, a.estimated_rows AS rows_after, "
        "b.actual_time_ms AS time_before, a.actual_time_ms AS time_after, "
        "a.node_type <> b.node_type AS node_type_changed "
        "FROM aligned p JOIN nodes a ON a.run_id = p.run_id "
        "JOIN before b ON b.run_id = a.run_id AND b.node_ord = a.node_ord")


def _record_runs() -> str:
    text = ("CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT * FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR) || "
            "' AND note <> ''As Is''' ELSE 'select *' || chr(10) || '  FROM   Orders where O_CUSTKEY = ' || "
            "CAST(o_custkey AS VARCHAR) || '  and NOTE <> ''As Is'' ' END")
    return _plan(
        "SELECT row_number() OVER (ORDER BY o.o_orderkey % 3, o.o_orderdate, o.o_orderkey) AS run_id, "
        f"o.o_orderkey AS order_key, r.query_hash, {text} AS query_text, r.planning_time_ms "
        "FROM orders o JOIN runs r ON r.run_id = o.o_orderkey")


def _user_rules() -> str:
    return _plan("SELECT 'user.wide_sort' AS rule_id, 'INFO' AS severity, 'Wide sort' AS title, run_id, node_ord FROM nodes "
                 "WHERE node_type = 'SORT' AND estimated_rows >= 40 "
                 "UNION ALL SELECT 'user.breaks', 'WARN', 'Advisor user.breaks failed', NULL, NULL")


def _plan_file_stream() -> str:
    return ("WITH s AS (SELECT l_suppkey AS supplier, max(l_extendedprice) / 100 AS root_cost, "
            "CASE l_suppkey % 7 WHEN 1 THEN 'not_json' WHEN 2 THEN 'no_plan' END AS reason FROM lineitem GROUP BY l_suppkey) "
            "SELECT supplier, row_number() OVER (ORDER BY supplier % 3, CAST(supplier AS VARCHAR) || '/') AS run_id, "
            "reason, 2::BIGINT AS node_count, root_cost FROM s WHERE reason IS NULL "
            "UNION ALL SELECT supplier, NULL, reason, NULL, NULL FROM s WHERE reason IS NOT NULL")


def _baseline_vs_candidate() -> str:
    return _plan(
        "SELECT p.before_run_id, p.after_run_id, "
        "CASE WHEN b.node_count <> a.node_count THEN 'STRUCTURE_CHANGED' "
        "WHEN coalesce(b.execution_time_ms, b.root_cost) = 0 THEN 'SAME' "
        "WHEN coalesce(a.execution_time_ms, a.root_cost) < coalesce(b.execution_time_ms, b.root_cost) * 0.9::DOUBLE "
        "THEN 'FASTER' "
        "WHEN coalesce(a.execution_time_ms, a.root_cost) > coalesce(b.execution_time_ms, b.root_cost) * 1.1::DOUBLE "
        "THEN 'SLOWER' ELSE 'SAME' END AS verdict, "
        "b.node_count = a.node_count AS aligned, b.node_count AS node_count_before, a.node_count AS node_count_after, "
        "b.execution_time_ms AS time_before_ms, a.execution_time_ms AS time_after_ms, "
        "coalesce(b.execution_time_ms, b.root_cost) AS metric_before, "
        "coalesce(a.execution_time_ms, a.root_cost) AS metric_after, "
        "CASE WHEN b.execution_time_ms IS NOT NULL THEN 'execution_time' ELSE 'root_cost' END AS metric_before_kind, "
        "CASE WHEN a.execution_time_ms IS NOT NULL THEN 'execution_time' ELSE 'root_cost' END AS metric_after_kind "
        "FROM (SELECT query_hash, min(run_id) AS before_run_id, max(run_id) AS after_run_id FROM runs "
        "GROUP BY query_hash HAVING min(run_id) < max(run_id)) p "
        "JOIN summ b ON b.run_id = p.before_run_id JOIN summ a ON a.run_id = p.after_run_id")


def _baseline_node_deltas() -> str:
    ctes = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in PLAN_CTES]
    ctes.append("p AS MATERIALIZED (SELECT f.before_run_id, f.after_run_id FROM (SELECT min(run_id) AS before_run_id, "
                "max(run_id) AS after_run_id FROM runs GROUP BY query_hash HAVING min(run_id) < max(run_id)) f "
                "JOIN summ b ON b.run_id = f.before_run_id JOIN summ a ON a.run_id = f.after_run_id "
                "WHERE a.node_count = b.node_count)")
    ctes.append("before AS MATERIALIZED (SELECT p.after_run_id, n.* FROM p JOIN nodes n ON n.run_id = p.before_run_id)")
    return _with(
        ctes,
        "SELECT a.run_id, b.run_id AS prev_run_id, a.node_ord, a.node_type, coalesce(a.relation, b.relation) AS relation, "
        "b.estimated_cost AS cost_before, a.estimated_cost AS cost_after, "
        "b.estimated_rows AS rows_before, a.estimated_rows AS rows_after, "
        "b.actual_time_ms AS time_before, a.actual_time_ms AS time_after, a.node_type <> b.node_type AS node_type_changed "
        "FROM nodes a JOIN before b ON b.after_run_id = a.run_id AND b.node_ord = a.node_ord")


_EVIDENCE = ["rows", "cost", "factor", "estimated", "actual", "sort_method", "space_kb", "loops", "indexes", "sampled",
             "sample_size", "distinct_values", "value_list", "orphan_ratio", "parent"]


def _evidence_select(rule: str, where: str, sql_from: str, place: str, **values: str) -> str:
    fields = ", ".join(f"{values.get(e, 'NULL')} AS {e}" for e in _EVIDENCE)
    return f"SELECT '{rule}' AS rule_id, {where} AS identifier, {place}, {fields} FROM {sql_from}"


def _findings_evidence() -> str:
    not_null, unique = _fk_declared()
    node, column = "run_id, node_ord", "NULL AS run_id, NULL AS node_ord"
    scan = "(SELECT *, coalesce(nullif(total_actual_rows, 0.0), estimated_rows) AS rws FROM nodes)"
    ratios = "\nUNION ALL\n".join(_ratio_select("f", *p) for p in FK_CANDIDATES)

    def of_column(rule, findings, source, **values):
        # the finding's own SQL says which columns; their figures stand in stats
        return _evidence_select(rule, "s.table_name || '.' || s.column_name",
                                f"({findings}) f JOIN {source} s USING (table_name, column_name)", column, **values)

    return _with(PLAN_CTES + _fk_ctes(False), "\nUNION ALL\n".join([
        _evidence_select("advisor.seq_scan", "relation", f"{scan} WHERE node_type = 'SEQ_SCAN' AND relation IS NOT NULL "
                         "AND rws >= 10000", node, rows="rws", cost="estimated_cost"),
        _evidence_select("advisor.row_estimate", "coalesce(relation, node_type)", "nodes WHERE misestimate_factor >= 100", node,
                         factor="misestimate_factor", estimated="estimated_rows", actual="total_actual_rows"),
        _evidence_select("advisor.sort_spill", "'Sort'", "nodes WHERE node_type = 'SORT' AND lower(sort_method) LIKE '%external%'",
                         node, sort_method="sort_method", space_kb="CAST(sort_space_used AS BIGINT)"),
        _evidence_select("advisor.nested_loop", "'Nested Loop'", "nodes WHERE node_type = 'NESTED_LOOP' AND "
                         "max_child_loops >= 10000", node, loops="max_child_loops"),
        _evidence_select("advisor.unused_index", "relation", "nodes WHERE node_type = 'SEQ_SCAN' AND relation = 'orders'", node,
                         indexes="'ix_orders_customer_id|ix_orders_status'"),
        of_column("inferencer.not_null", _not_null_sql(not_null), "stats", sampled="s.sampled", sample_size="s.scanned_rows"),
        of_column("inferencer.unique", _unique_sql(unique), "stats", sampled="s.sampled", sample_size="s.scanned_rows"),
        of_column("inferencer.enum", _enum_sql(), "(SELECT * FROM stats JOIN vals USING (table_name, column_name))",
                  sampled="s.sampled", distinct_values="s.distinct_count",
                  value_list="replace(trim(s.in_list, ''''), ''', ''', '|')"),
        _evidence_select("inferencer.fk_overlap", "child_table || '.' || child_column",
                         f"({ratios}) r WHERE orphan_ratio <= 0.0", column, sampled="sampled",
                         orphan_ratio="orphan_ratio", parent="parent_table || '.' || parent_column"),
    ]))


def _catalog_check() -> str:
    keys = ", ".join(f"({_lit(t)}, {_lit(v[2])})" for t, v in FK_TABLES.items() if v[2])
    return _with(_fk_ctes(False) + [f"keys(table_name, column_name) AS (VALUES {keys})"],
                 "SELECT s.table_name, s.column_name, data_type, k.column_name IS NULL AS nullable, k.column_name IS NOT NULL "
                 "AS declared_unique, row_count, null_count, distinct_count, k.column_name IS NULL OR (null_count = 0 AND "
                 "distinct_count = row_count) AS holds FROM stats s LEFT JOIN keys k "
                 "ON s.table_name = k.table_name AND s.column_name = k.column_name")


def _key_pair_types() -> str:
    kinds = {(t, c): kind for t, v in FK_TABLES.items() for c, kind in v[1]}
    types = ", ".join(f"({', '.join(map(_lit, (*p, kinds[p[:2]], kinds[p[2:]])))})" for p in ORPHAN_PAIRS)
    ratios = "\nUNION ALL\n".join(_ratio_select("f", *p) for p in ORPHAN_PAIRS)
    return _with(_fk_ctes(False) + [f"kinds(child_table, child_column, parent_table, parent_column, child_type, parent_type) AS "
                                    f"(VALUES {types})"],
                 "SELECT child_table, child_column, parent_table, parent_column, child_rows, orphan_rows, child_type, "
                 f"parent_type, child_type = parent_type AS same_type FROM ({ratios}) r "
                 "JOIN kinds USING (child_table, child_column, parent_table, parent_column)")


_REPORT = ("SELECT severity || ': ' || title || ' [' || location_identifier || ']' || chr(10) || '    ' || detail "
           "AS line FROM (" + _ALL_RULES + ") f")


def oracle_sql() -> dict[str, str]:
    q = {
        "column_profile": _profile(False),
        "column_profile_sampled": _profile(True),
        "distinct_values": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source LIMIT 12",
        "orphan_ratio": _orphan_ratio(),
        "infer_not_null": _infer_as_is(["not_null"]),
        "infer_unique": _infer_as_is(["unique"]),
        "infer_enum": _infer_as_is(["enum"]),
        "infer_fk": _infer_fk(["fk"]),
        "infer_all": _infer_fk(["not_null", "unique", "enum", "fk"]),
        "infer_all_sampled": _infer_fk(["not_null", "unique", "enum", "fk"], sampled=True),
        "ddl_script": _ddl_script(),
        "infer_report": _infer_report(),
        "plan_nodes": _plan(f"SELECT {_NODE_COLS} FROM nodes"),
        "plan_roundtrip": _plan(f"SELECT {_NODE_COLS} FROM nodes"),
        "plan_documents": _plan("SELECT run_id, planning_time_ms, execution_time_ms FROM runs"),
        "plan_errors": _plan("SELECT run_id, 'WARN' AS severity, 'Plan document of run ' || run_id || ' cannot be read' "
                             "AS title, CASE run_id % 7 WHEN 0 THEN 'null_document' WHEN 1 THEN 'not_json' "
                             "ELSE 'no_plan' END AS reason FROM runs WHERE run_id % 7 < 3"),
        "broken_log_diffs": _plan("SELECT run_id, lag(run_id) OVER (PARTITION BY query_hash ORDER BY run_id) "
                                  "AS prev_run_id FROM runs WHERE run_id % 7 >= 3"),
        "advise_seq_scan": _plan(_named(_RULES["seq_scan"])),
        "advise_row_estimate": _plan(_named(_RULES["row_estimate"])),
        "advise_sort_spill": _plan(_named(_RULES["sort_spill"])),
        "advise_nested_loop": _plan(_named(_RULES["nested_loop"])),
        "advise_unused_index": _plan(_named(_RULES["unused_index"])),
        "advise_all": _plan(_ALL_RULES),
        "findings_rollup": _plan("SELECT rule_id, severity, location_identifier AS identifier, "
                                 "count(*)::BIGINT AS findings FROM (" + _ALL_RULES + ") f GROUP BY ALL"),
        "report_lines": _plan(_REPORT),
        "query_fingerprint": _plan("SELECT run_id, query_hash FROM runs"),
        "latest_runs": _plan("SELECT r.query_hash, r.run_id, r.git_ref, r.execution_time_ms FROM runs r "
                             "JOIN (SELECT query_hash, max(run_id) AS run_id FROM runs GROUP BY query_hash) m "
                             "USING (query_hash, run_id)"),
        "runs_newest_first": _plan("SELECT run_id, query_hash, row_number() OVER (PARTITION BY query_hash "
                                   "ORDER BY run_id DESC)::BIGINT AS pos_desc FROM runs"),
        "previous_runs": _plan("SELECT run_id, query_hash, lag(run_id) OVER (PARTITION BY query_hash "
                               "ORDER BY run_id) AS prev_run_id FROM runs"),
        "plan_diffs": _plan("SELECT * FROM diffs", [_PAIRS, _DIFFS]),
        "node_deltas": _node_deltas(),
        "record_runs": _record_runs(),
        "user_rules": _user_rules(),
        "plan_file_stream": _plan_file_stream(),
        "baseline_vs_candidate": _baseline_vs_candidate(),
        "baseline_node_deltas": _baseline_node_deltas(),
        "findings_evidence": _findings_evidence(),
        "catalog_check": _catalog_check(),
        "key_pair_types": _key_pair_types(),
        "slowdown_history": _plan(
            "SELECT query_hash, count(*)::BIGINT AS slower_runs, min(run_id) AS first_slower_run_id, "
            "arg_min(git_ref, run_id) AS first_slower_git_ref, max(run_id) AS last_slower_run_id, "
            "arg_max(git_ref, run_id) AS last_slower_git_ref FROM diffs WHERE verdict = 'SLOWER' "
            "GROUP BY query_hash", [_PAIRS, _DIFFS]),
        "redact_documents": (
            "SELECT doc_id, regexp_replace(text, '(://[^:/@]+:)[^@]*(@)', '\\1***\\2', 'g') AS text_redacted, "
            "regexp_replace(text, '(://[^:/@]+:)[^@]*(@)', '\\1***\\2', 'g') <> text AS changed FROM documents"),
        "regression_watch": _plan("SELECT * FROM diffs", [_PAIRS, _DIFFS]),
    }
    return q
