"""Flatten EXPLAIN (FORMAT JSON) documents into one row per plan node.

A document is a JSON list whose first element holds ``Plan`` (or that object
itself). Each node may hold ``Plans``, the list of its children.

Everything runs in one map-side pass per document, without Python:

1. ``try_parse_json`` -> VARIANT; the root is ``$[0].Plan`` or ``$.Plan``.
2. Four levels of the plan are cast to nested structs at once, with the fields
   that are asked for, and walked in pre-order (parent before children, children in
   order); each node carries its ``path`` (child positions from the root).
3. What lies below them is read by an ``aggregate`` fold, four levels a step; the
   number of steps is bounded by the count of ``"Plans"`` keys in the text, which
   is at least the depth. The nodes of such a plan are then sorted by ``path``: that is
   pre-order too, since arrays compare element-wise with a prefix first.
4. ``posexplode`` of the array numbers the nodes -- no window, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkup.functions.nodetypes import normalize_node_type
from checkup.operators.findings import WARN, finding_columns

# Plan-document key names.
K_PLAN = "Plan"
K_PLANS = "Plans"
K_NODE_TYPE = "Node Type"
K_RELATION = "Relation Name"
K_PLAN_ROWS = "Plan Rows"
K_ACTUAL_ROWS = "Actual Rows"
K_TOTAL_COST = "Total Cost"
K_ACTUAL_TIME = "Actual Total Time"
K_LOOPS = "Actual Loops"
K_SORT_METHOD = "Sort Method"
K_SORT_SPACE = "Sort Space Used"
K_PLANNING_TIME = "Planning Time"
K_EXECUTION_TIME = "Execution Time"

_DONE_TYPE = "array<struct<path:array<int>,node:variant,child_count:int,max_child_loops:double>>"


def _key(name: str) -> str:
    return '$["' + name + '"]'


def _get(v: Column, name: str, dtype: str) -> Column:
    return F.try_variant_get(v, _key(name), dtype)


def _at(v: Column, path: str, dtype: str) -> Column:
    """``path`` below the top object of document ``v``, which is ``$[0]`` or ``$``
    (one of the two has it); reads the value in place, without a copy of the top object."""
    return F.coalesce(F.try_variant_get(v, "$[0]" + path, dtype), F.try_variant_get(v, "$" + path, dtype))


def _has_plan(v: Column) -> Column:
    """Whether the document holds a Plan; only a Plan that is no object is copied to be looked at."""
    other = _at(v, ".Plan", "variant")
    return (_at(v, ".Plan", f"struct<`{K_NODE_TYPE}`:string>").isNotNull()
            | (other.isNotNull() & ~F.is_variant_null(other)))


def _rows_where(df: DataFrame, cond: Column, *cols) -> DataFrame:
    """``cols`` of the rows with ``cond``. A generator, since Spark would move a filter below the
    projection that parses the documents and parse them once more for each use."""
    return df.select(F.explode(F.when(cond, F.array(F.struct(*cols)))).alias("_row")).select("_row.*")


def parse_plan_documents(runs: DataFrame, json_col: str = "plan_json") -> DataFrame:
    """Adds ``_doc`` (top object), ``_root`` (the Plan node), timings and
    ``parse_status``: ok, null_document, not_json or no_plan."""
    text = F.col(json_col)
    v = F.col("_v")
    return (
        runs.withColumn("_v", F.try_parse_json(text))
        .withColumns({
            "_doc": F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v),
            "_root": _at(v, ".Plan", "variant"),
            "planning_time_ms": _at(v, _key(K_PLANNING_TIME)[1:], "double"),
            "execution_time_ms_doc": _at(v, _key(K_EXECUTION_TIME)[1:], "double"),
            "parse_status": F.when(text.isNull(), F.lit("null_document"))
                             .when(v.isNull(), F.lit("not_json"))
                             .when(~_has_plan(v), F.lit("no_plan"))
                             .otherwise(F.lit("ok")),
        })
        .drop("_v")
    )


def split_plan_documents(runs: DataFrame, json_col: str = "plan_json",
                         key_cols: tuple[str, ...] = ("run_id",),
                         columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: (documents that parse to a plan, errors with a reason). With ``columns`` the
    documents have those only, and no VARIANT is copied that is not asked for."""
    parsed = parse_plan_documents(runs, json_col)
    good = _rows_where(parsed, F.col("parse_status") == "ok", *(parsed.columns if columns is None else columns))
    bad = _rows_where(parsed, F.col("parse_status") != "ok",
                      *key_cols, F.col("parse_status").alias("reason"))
    return good, bad


# What the reasons say.
REASONS = {"null_document": "there is no document", "no_plan": "the document holds no plan",
           "not_json": "the document is no JSON, or is nested too deeply to be read"}


def document_errors(runs: DataFrame, json_col: str = "plan_json") -> DataFrame:
    """One WARN finding for each run whose document cannot be read."""
    _, bad = split_plan_documents(runs, json_col)
    reason = F.col("reason")
    for k, v in REASONS.items():
        reason = F.when(F.col("reason") == k, F.lit(v)).otherwise(reason)
    return bad.select(*finding_columns(
        rule_id="plan.document", rule_rank=0, severity=WARN,
        title=F.format_string("Plan document of run %s cannot be read", F.col("run_id").cast("string")),
        detail=reason, evidence=F.to_json(F.struct("reason")), run_id=F.col("run_id")))


def _kids(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$.Plans", "array<variant>"), F.array().cast("array<variant>"))


def _fold_nodes(root: Column, text: Column, sort: bool = True) -> Column:
    """All nodes below ``root`` as array<struct<path, node, child_count,
    max_child_loops>>, in pre-order when ``sort``.

    Each node's children are read from the VARIANT once, when the node enters
    the front; the same list gives the child count, the largest child loop
    count (A4) and the next level."""
    bound = F.floor((F.length(text) - F.length(F.replace(text, F.lit('"Plans"'), F.lit("")))) / 7)
    steps = F.sequence(F.lit(0), bound.cast("int") + 1)
    start = F.struct(
        F.array().cast(_DONE_TYPE).alias("done"),
        F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("node"),
                         _kids(root).alias("kids"))).alias("front"),
    )

    def emit(f):
        loops = F.transform(f["kids"], lambda c: F.coalesce(_get(c, K_LOOPS, "double"), F.lit(1.0)))
        return F.struct(f["path"].alias("path"), f["node"].alias("node"),
                        F.size(f["kids"]).alias("child_count"),
                        F.coalesce(F.array_max(loops), F.lit(0.0)).alias("max_child_loops"))

    def expand(f):
        return F.transform(f["kids"], lambda c, j: F.struct(
            F.concat(f["path"], F.array(j)).alias("path"), c.alias("node"), _kids(c).alias("kids")))

    def step(acc, _i):
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.struct(
            F.concat(acc["done"], F.transform(acc["front"], emit)).alias("done"),
            F.flatten(F.transform(acc["front"], expand)).alias("front"),
        ))

    folded = F.aggregate(steps, start, step)["done"]
    if not sort:
        return folded
    return F.array_sort(folded, lambda a, b: F.when(a["path"] < b["path"], -1)
                        .when(a["path"] > b["path"], 1).otherwise(0))


# Levels of a plan that are read from its VARIANT at once.
_LEVELS = 4

_NODE_FIELDS = {K_NODE_TYPE: "string", K_RELATION: "string", K_PLAN_ROWS: "double", K_ACTUAL_ROWS: "double",
                K_TOTAL_COST: "double", K_ACTUAL_TIME: "double", K_LOOPS: "double", K_SORT_METHOD: "string",
                K_SORT_SPACE: "variant"}


def _node_struct(kid_fields: dict[str, str], levels: int = _LEVELS, fields: dict[str, str] | None = None) -> str:
    """Type of a node: its fields (``kid_fields`` if not given) and its children, ``levels`` deep; the children of
    the last level stay VARIANT."""
    kids = "variant" if levels == 1 else _node_struct(kid_fields, levels - 1)
    fields = kid_fields if fields is None else fields
    return "struct<" + "".join(f"`{k}`:{t}," for k, t in fields.items()) + f"`{K_PLANS}`:array<{kids}>>"


def _plans_keys(text: Column) -> Column:
    """Count of ``"Plans"`` in the text: a plan is at most that many levels deep below its root."""
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"Plans"'), F.lit("")))) / 7).cast("int")


def _with_roots(docs: DataFrame, keep: tuple[str, ...], json_col: str, fields: dict[str, str],
                kid_fields: dict[str, str]) -> DataFrame:
    """``keep``, ``_text``, ``_v`` (the VARIANT) and ``_root``: the Plan as a struct, ``_LEVELS`` deep, with ``fields``
    of the root and ``kid_fields`` of the nodes below. Documents without a plan are not dropped."""
    v = F.col("_v")
    dtype = _node_struct(kid_fields, fields=fields)
    return docs.select(*keep, F.col(json_col).alias("_text"), F.try_parse_json(json_col).alias("_v")).withColumn(
        "_root", _at(v, "." + K_PLAN, dtype))


def _has_root() -> Column:
    """``_has_plan`` of the documents of ``_with_roots``."""
    return F.col("_root").isNotNull() | _has_plan(F.col("_v"))


def _fold_structs(root: Column, text: Column, fields: dict[str, str],
                  emit: Callable[[Column, Column, Column, bool], Column],
                  emitted: str, path_of: Callable[[Column], Column] | None = None) -> Column:
    """All nodes below the struct ``root`` as an array of ``emit(node, path, children, children are VARIANT)``
    (type ``emitted``).

    ``_LEVELS`` levels are a struct already, each field read once; only what lies below them is taken out
    of its VARIANT for the next round. Within a round nodes come in pre-order; with ``path_of`` (the path of an
    emitted node) a plan of more rounds is sorted by path."""
    dtype = _node_struct(fields)
    keys = _plans_keys(text)
    none = F.array().cast("array<struct<path:array<int>,node:variant>>")

    def full(base, at):
        own = F.array(*at) if at else F.array().cast("array<int>")
        return own if base is None else F.flatten(F.array(base, own))

    def subtree(n, base, at, levels):
        kids = n[K_PLANS]
        me = F.array(emit(n, full(base, at), kids, levels == 1))
        if levels == 1:
            return me
        return F.when(F.size(kids) > 0, F.flatten(F.array(me, F.flatten(F.transform(
            kids, lambda c, j: subtree(c, base, (*at, j), levels - 1)))))).otherwise(me)

    def below(n, base, at, levels):
        if levels == 1:
            found = F.transform(n[K_PLANS], lambda c, j: F.struct(full(base, (*at, j)).alias("path"), c.alias("node")))
        else:
            found = F.flatten(F.transform(n[K_PLANS], lambda c, j: below(c, base, (*at, j), levels - 1)))
        return F.coalesce(found, none)

    def taken_out(deeper):
        return F.transform(deeper, lambda d: F.struct(
            d["path"].alias("path"), F.try_variant_get(d["node"], "$", dtype).alias("n")))

    def step(acc, _i):
        deeper = F.flatten(F.transform(acc["front"], lambda f: below(f["n"], f["path"], (), _LEVELS)))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.struct(
            F.concat(acc["done"], F.flatten(F.transform(
                acc["front"], lambda f: subtree(f["n"], f["path"], (), _LEVELS)))).alias("done"),
            taken_out(deeper).alias("front")))

    def finish(acc):
        if path_of is None:
            return acc["done"]
        return F.array_sort(acc["done"], lambda a, b: F.when(
            path_of(a) < path_of(b), -1).when(path_of(a) > path_of(b), 1).otherwise(0))

    done = subtree(root, None, (), _LEVELS)
    more = below(root, None, (), _LEVELS)
    start = F.struct(done.cast(f"array<{emitted}>").alias("done"), taken_out(more).alias("front"))
    steps = F.sequence(F.lit(0), F.floor(keys / _LEVELS).cast("int") + 1)
    # fewer keys than levels: the struct holds the whole plan, and nothing below it need be looked for
    return F.when(keys < _LEVELS, done).when(F.size(more) == 0, done).otherwise(
        F.aggregate(steps, start, step, finish))


def _emit_node(fields: dict[str, str], with_loops: bool) -> tuple[Callable, str]:
    """What a node emits (its path, ``fields``, number of children and, if asked, their largest loop count, A4)
    and the type of that."""
    def emit(n: Column, path: Column, kids: Column, variant_kids: bool) -> Column:
        cols = [path.alias("path"), *[n[k].alias(k) for k in fields],
                F.when(kids.isNull(), F.lit(0)).otherwise(F.size(kids)).alias("child_count")]
        if with_loops:
            loops = F.transform(kids, lambda c: F.coalesce(_get(c, K_LOOPS, "double") if variant_kids else c[K_LOOPS], F.lit(1.0)))
            cols.append(F.when(F.size(kids) > 0, F.array_max(loops)).otherwise(F.lit(0.0)).alias("max_child_loops"))
        return F.struct(*cols)

    return emit, ("struct<path:array<int>," + "".join(f"`{k}`:{t}," for k, t in fields.items()) + "child_count:int"
                  + (",max_child_loops:double>" if with_loops else ">"))


def _nodes_in_order(root: Column, text: Column, fields: dict[str, str], with_loops: bool) -> Column:
    emit, emitted = _emit_node(fields, with_loops)
    return _fold_structs(root, text, fields, emit, emitted, lambda x: x["path"])


# The values of a plan document that each output column is made of.
_ESTIMATE, _TOTAL = (K_PLAN_ROWS,), (K_ACTUAL_ROWS, K_LOOPS)
_MADE_OF = {"node_type_raw": (K_NODE_TYPE,), "node_type": (K_NODE_TYPE,), "relation": (K_RELATION,),
            "estimated_rows": _ESTIMATE, "actual_rows": (K_ACTUAL_ROWS,), "estimated_cost": (K_TOTAL_COST,),
            "actual_time_ms": (K_ACTUAL_TIME,), "loops": (K_LOOPS,), "total_actual_rows": _TOTAL,
            "misestimate_factor": _ESTIMATE + _TOTAL, "heat": _ESTIMATE + _TOTAL, "max_child_loops": (K_LOOPS,),
            "sort_method": (K_SORT_METHOD,), "sort_space_used": (K_SORT_SPACE,), "sort_space_json": (K_SORT_SPACE,)}


def _struct_fields(f: str, fields: dict[str, str]) -> list[Column]:
    """``fields`` of an emitted node, as ``_raw_fields`` names them."""
    space = F.col(f"{f}.`{K_SORT_SPACE}`")
    names = {K_NODE_TYPE: "_type", K_RELATION: "relation", K_PLAN_ROWS: "_est", K_ACTUAL_ROWS: "actual_rows",
             K_TOTAL_COST: "_cost", K_ACTUAL_TIME: "actual_time_ms", K_LOOPS: "_loops", K_SORT_METHOD: "sort_method"}
    out = [F.col(f"{f}.`{k}`").alias(n) for k, n in names.items() if k in fields]
    if K_SORT_SPACE in fields:
        out += [F.try_variant_get(space, "$", "string").alias("sort_space_used"), F.to_json(space).alias("sort_space_json")]
    return out


def _raw_fields(node: Column) -> list[Column]:
    """Fields read from the node VARIANT (each read once)."""
    return [
        _get(node, K_NODE_TYPE, "string").alias("_type"),
        _get(node, K_RELATION, "string").alias("relation"),
        _get(node, K_PLAN_ROWS, "double").alias("_est"),
        _get(node, K_ACTUAL_ROWS, "double").alias("actual_rows"),
        _get(node, K_TOTAL_COST, "double").alias("_cost"),
        _get(node, K_ACTUAL_TIME, "double").alias("actual_time_ms"),
        _get(node, K_LOOPS, "double").alias("_loops"),
        _get(node, K_SORT_METHOD, "string").alias("sort_method"),
        _get(node, K_SORT_SPACE, "string").alias("sort_space_used"),
        F.to_json(_get(node, K_SORT_SPACE, "variant")).alias("sort_space_json"),
    ]


def _derived_fields() -> dict[str, Column]:
    """N2-N4 and defaults: Plan Rows 0, Total Cost 0, Actual Loops 1."""
    est = F.coalesce(F.col("_est"), F.lit(0.0))
    loops = F.coalesce(F.col("_loops"), F.lit(1.0))
    total = F.col("actual_rows") * loops
    factor = F.when(total.isNotNull() & (total > 0) & (est > 0), F.greatest(est / total, total / est))
    return {
        "node_type_raw": F.coalesce(F.col("_type"), F.lit("")),
        "node_type": normalize_node_type(F.col("_type")),
        "relation": F.col("relation"),
        "estimated_rows": est,
        "actual_rows": F.col("actual_rows"),
        "estimated_cost": F.coalesce(F.col("_cost"), F.lit(0.0)),
        "actual_time_ms": F.col("actual_time_ms"),
        "loops": loops,
        "total_actual_rows": total,
        "misestimate_factor": factor,
        "child_count": F.col("child_count"),
        "max_child_loops": F.col("max_child_loops"),
        "sort_method": F.col("sort_method"),
        "sort_space_used": F.col("sort_space_used"),
        "sort_space_json": F.col("sort_space_json"),
    }


def heat_bucket(factor: Column) -> Column:
    """Misestimate heat: >= 100 high, >= 10 medium, else none."""
    return (F.when(factor >= 100, F.lit("high")).when(factor >= 10, F.lit("medium"))
            .otherwise(F.lit("none")))


def flatten_plans(runs: DataFrame, json_col: str = "plan_json",
                  keep: tuple[str, ...] = ("run_id",), with_raw: bool = False,
                  columns: list[str] | None = None) -> DataFrame:
    """One row per node of every parsable document.

    Columns: ``keep`` columns, node_ord (pre-order from 1), path, depth,
    node_type_raw, node_type, relation, estimated_rows, actual_rows (per loop),
    estimated_cost, actual_time_ms, loops, total_actual_rows,
    misestimate_factor, child_count, max_child_loops, sort_method,
    sort_space_used (as text) and sort_space_json (the raw JSON value), heat,
    and ``raw`` (the node as VARIANT) if asked. With ``columns``, only those of them
    besides ``keep`` (in this order), and no other value is read from the nodes. A
    map-side pass: no shuffle, no window.
    """
    made = [*_derived_fields(), "heat"]
    wanted = made if columns is None else [c for c in made if c in columns]
    if columns is not None and (unknown := set(columns) - {*keep, "node_ord", "path", "depth", *made}):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    needed = {k for c in wanted for k in _MADE_OF.get(c, ())}
    if with_raw:  # the nodes themselves are asked for, so each is taken out of its document
        v, text = F.col("_v"), F.col("_text")
        docs = runs.select(*keep, F.col(json_col).alias("_text"), F.try_parse_json(json_col).alias("_v"))
        nodes = F.when(_has_plan(v), _fold_nodes(_at(v, ".Plan", "variant"), text))
        raw_fields = [*_raw_fields(F.col("_n.node")), F.col("_n.node").alias("raw"),
                      F.col("_n.max_child_loops").alias("max_child_loops")]
    else:
        fields = {k: t for k, t in _NODE_FIELDS.items() if k in needed}
        with_loops = "max_child_loops" in wanted
        docs = _with_roots(runs, keep, json_col, fields, fields)
        nodes = F.when(_has_root(), _nodes_in_order(F.col("_root"), F.col("_text"), fields, with_loops))
        raw_fields = [*_struct_fields("_n", fields), *([F.col("_n.max_child_loops").alias("max_child_loops")] if with_loops else [])]
    exploded = docs.select(*keep, F.posexplode(nodes).alias("_pos", "_n"))
    rows = exploded.select(
        *keep,
        (F.col("_pos") + 1).cast("bigint").alias("node_ord"),
        F.col("_n.path").alias("path"),
        F.size(F.col("_n.path")).alias("depth"),
        F.col("_n.child_count").alias("child_count"),
        *raw_fields,
    )
    derived = _derived_fields()
    derived["heat"] = heat_bucket(derived["misestimate_factor"])
    plain = [c for c in ("node_ord", "path", "depth") if columns is None or c in columns]
    out = rows.select(*keep, *plain, *[derived[c].alias(c) for c in wanted if c != "heat"],
                      *(["raw"] if with_raw else []), *[derived[c].alias(c) for c in wanted if c == "heat"])
    return out


def _count_nodes(root: Column, text: Column) -> Column:
    """Number of nodes below ``root`` (no fields, no order)."""
    return F.size(_fold_structs(root, text, {}, lambda *_: F.lit(True), "boolean"))


# What is compared of a node, and what a summary shows of the root.
_COMPARED_FIELDS = {k: _NODE_FIELDS[k] for k in (K_NODE_TYPE, K_RELATION, K_TOTAL_COST, K_PLAN_ROWS, K_ACTUAL_TIME)}
_ROOT_FIELDS = {k: _NODE_FIELDS[k] for k in (K_NODE_TYPE, K_TOTAL_COST)}


def _compared_node(n: Column, path: Column, *_) -> Column:
    return F.struct(path.alias("path"), *[n[k].alias(k) for k in _COMPARED_FIELDS])


_COMPARED_NODE = "struct<path:array<int>," + ",".join(f"`{k}`:{t}" for k, t in _COMPARED_FIELDS.items()) + ">"


def plan_summaries(runs: DataFrame, json_col: str = "plan_json",
                   keep: tuple[str, ...] = ("run_id",), with_nodes: bool = False) -> DataFrame:
    """One row per parsable document: node_count, root type and cost, timings,
    and with ``with_nodes`` the pre-order array of its nodes (node_ord,
    node_type, relation, estimated_cost, estimated_rows, actual_time_ms) --
    the size of one document, used to compare runs position by position.

    Reads each document once and does not explode it (used by the diff)."""
    fields = _COMPARED_FIELDS if with_nodes else {}
    docs = _with_roots(runs, keep, json_col, fields or _ROOT_FIELDS, fields)
    root, text, v, has_plan = F.col("_root"), F.col("_text"), F.col("_v"), _has_root()
    cols = [
        normalize_node_type(root[K_NODE_TYPE]).alias("root_node_type"),
        F.coalesce(root[K_TOTAL_COST], F.lit(0.0)).alias("root_cost"),
        _at(v, _key(K_PLANNING_TIME)[1:], "double").alias("planning_time_ms"),
        _at(v, _key(K_EXECUTION_TIME)[1:], "double").alias("execution_time_ms"),
    ]
    if not with_nodes:
        return _rows_where(docs, has_plan, *keep, _count_nodes(root, text).cast("bigint").alias("node_count"), *cols)
    found = _fold_structs(root, text, fields, _compared_node, _COMPARED_NODE, lambda x: x["path"])
    nodes = F.transform(found, lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("node_ord"),
        normalize_node_type(x[K_NODE_TYPE]).alias("node_type"),
        x[K_RELATION].alias("relation"),
        F.coalesce(x[K_TOTAL_COST], F.lit(0.0)).alias("estimated_cost"),
        F.coalesce(x[K_PLAN_ROWS], F.lit(0.0)).alias("estimated_rows"),
        x[K_ACTUAL_TIME].alias("actual_time_ms"),
    ))
    return _rows_where(docs, has_plan, *keep, *cols, nodes.alias("nodes")).select(
        *keep, F.size("nodes").cast("bigint").alias("node_count"), "root_node_type", "root_cost", "planning_time_ms",
        "execution_time_ms", "nodes")


def trim_plan_documents(runs: DataFrame, json_col: str = "plan_json",
                        out_col: str = "plan_json") -> DataFrame:
    """K5: keep only the Plan and the two timings of each document.

    The result is a one-element JSON list that flattens to the same nodes.
    Documents that do not parse to a plan are dropped (see S3)."""
    parsed = parse_plan_documents(runs, json_col)
    payload = F.to_json(F.array(F.struct(
        F.col("_root").alias(K_PLAN),
        F.col("planning_time_ms").alias(K_PLANNING_TIME),
        F.col("execution_time_ms_doc").alias(K_EXECUTION_TIME),
    )), {"ignoreNullFields": "false"})
    others = [F.col(f"`{c}`") for c in runs.columns if c != out_col]
    return _rows_where(parsed, F.col("parse_status") == "ok", *others, payload.alias(out_col)).select(
        *[f"`{c}`" for c in dict.fromkeys([*runs.columns, out_col])])
