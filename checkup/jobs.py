"""The checks run over the test tables, one function per registered query.

Each function takes (spark, sf_dir) and returns a DataFrame over the whole
tables (or the plan log Spark derives from orders and lineitem). Columns are
aliased and cast so that they line up with the SQL checks in ``checkup_oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.functions.text import redact_credentials
from checkup.operators import advise as A
from checkup.operators import diff as D
from checkup.operators import history as H
from checkup.operators.catalog import assemble_catalog, has_unique_on, key_columns_to_lists, lookup_column
from checkup.operators.findings import flat_findings
from checkup.operators.infer import infer_constraints
from checkup.operators.profile import column_profile, distinct_values, orphan_ratios
from checkup.operators.run_store import RunStore
from checkup.plans.flatten import (document_errors, flatten_plans, plan_summaries, split_plan_documents,
                                   trim_plan_documents)
from checkup.session import materialize, new_work_path
from checkup.sinks.report import (ddl_lines, infer_report_lines, read_findings_json, report_lines,
                                  write_findings_json)
from checkup.sources import derived
from checkup.sources.catalog import Catalog
from checkup.sources.tables import load_tables
from checkup.streaming.plan_files import PlanFileStream

# Fixed parameters of the sampled runs (P8) over the test tables.
SAMPLED_THRESHOLD = 10_000
SAMPLE_ROWS = 20_000
AS_IS_SAMPLE_KEYS = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"], "events": ["event_id"]}
FK_SAMPLE_KEYS = {"line_items": ["order_id"], "orders": ["id"], "events": ["event_id"]}

# Pairs for the many-pair orphan ratio (P7): the six links, the declared one,
# the decoy, and a column whose parent does not exist under its name.
ORPHAN_PAIRS = [
    ("nations", "region_id", "regions", "id"),
    ("customers", "nation_id", "nations", "id"),
    ("orders", "customer_id", "customers", "id"),
    ("line_items", "order_id", "orders", "id"),
    ("line_items", "part_id", "parts", "id"),
    ("line_items", "supplier_id", "suppliers", "id"),
    ("suppliers", "nation_id", "nations", "id"),
    ("line_items", "customer_id", "customers", "id"),
    ("events", "user_id", "customers", "id"),
]

PLAN_FINDING_COLS = ["rule_id", "severity", "title", "detail", "location_kind", "location_identifier",
                     "suggestion_kind", "suggestion_note", "run_id", "node_ord"]
DATA_FINDING_COLS = ["rule_id", "severity", "title", "detail", "location_kind", "location_identifier",
                     "suggestion_kind", "suggestion_sql", "table_name", "column_name"]


# ---- statistics and inference -------------------------------------------------

def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(derived.as_is_tables(spark, sf_dir)).drop("sample_percent")


def q_column_profile_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(derived.as_is_tables(spark, sf_dir), full_scan_threshold=SAMPLED_THRESHOLD,
                          sample_rows=SAMPLE_ROWS, sample_keys=AS_IS_SAMPLE_KEYS)


def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_tables(spark, sf_dir, ["documents"])["documents"]
    return distinct_values(docs, "source", 12).select(F.col("value").alias("source"))


def q_orphan_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_ratios(derived.fk_tables(spark, sf_dir), ORPHAN_PAIRS)


def _as_is_findings(spark, sf_dir, rules, **kw) -> DataFrame:
    t = derived.as_is_tables(spark, sf_dir)
    f = infer_constraints(t, derived.as_is_catalog(spark, t), rules=rules, **kw)
    return flat_findings(f).select(*DATA_FINDING_COLS)


def _fk_findings(spark, sf_dir, rules=None, **kw) -> DataFrame:
    t = derived.fk_tables(spark, sf_dir)
    f = infer_constraints(t, derived.fk_catalog(spark, t), rules=rules, **kw)
    return flat_findings(f).select(*DATA_FINDING_COLS)


def q_infer_not_null(spark, sf_dir):
    return _as_is_findings(spark, sf_dir, ["inferencer.not_null"])


def q_infer_unique(spark, sf_dir):
    return _as_is_findings(spark, sf_dir, ["inferencer.unique"])


def q_infer_enum(spark, sf_dir):
    return _as_is_findings(spark, sf_dir, ["inferencer.enum"])


def q_infer_fk(spark, sf_dir):
    return _fk_findings(spark, sf_dir, ["inferencer.fk_overlap"])


def q_infer_all(spark, sf_dir):
    return _fk_findings(spark, sf_dir)


def q_infer_all_sampled(spark, sf_dir):
    return _fk_findings(spark, sf_dir, full_scan_threshold=SAMPLED_THRESHOLD, sample_rows=SAMPLE_ROWS,
                        sample_keys=FK_SAMPLE_KEYS)


def q_infer_report(spark, sf_dir):
    t = derived.fk_tables(spark, sf_dir)
    return infer_report_lines(infer_constraints(t, derived.fk_catalog(spark, t))).select("line")


def q_ddl_script(spark, sf_dir):
    t = derived.fk_tables(spark, sf_dir)
    return ddl_lines(infer_constraints(t, derived.fk_catalog(spark, t))).select("statement")


# ---- plan documents ----------------------------------------------------------

NODE_COLS = ["run_id", "node_ord", "depth", "node_type", "relation", "estimated_rows", "actual_rows",
             "estimated_cost", "actual_time_ms", "loops", "total_actual_rows", "misestimate_factor",
             "max_child_loops", "heat"]


def q_plan_nodes(spark, sf_dir):
    return flatten_plans(derived.plan_runs(spark, sf_dir), columns=NODE_COLS).select(*NODE_COLS)


def q_plan_roundtrip(spark, sf_dir):
    """K5: stored payloads flatten back to the same nodes."""
    return flatten_plans(trim_plan_documents(derived.plan_runs(spark, sf_dir)), columns=NODE_COLS).select(*NODE_COLS)


def q_plan_documents_ok(spark, sf_dir):
    """S3: every derived document parses; errors would be listed with a reason."""
    # both halves read the log, so it is derived and written once
    good, bad = split_plan_documents(materialize(derived.plan_runs(spark, sf_dir).select("run_id", "plan_json"), "plan-log"),
                                     columns=["run_id", "planning_time_ms", "execution_time_ms_doc"])
    return good.select("run_id", F.col("planning_time_ms"),
                       F.col("execution_time_ms_doc").alias("execution_time_ms")) \
        .unionByName(bad.select("run_id", F.lit(None).cast("double").alias("planning_time_ms"),
                                F.lit(None).cast("double").alias("execution_time_ms")))


def q_plan_errors(spark, sf_dir):
    """S3, the errors: each spoilt document with its reason, as a finding."""
    found = document_errors(derived.broken_plan_runs(spark, sf_dir))
    return found.select("run_id", "severity", "title", F.get_json_object("evidence", "$.reason").alias("reason"))


def q_broken_log_diffs(spark, sf_dir):
    """D1 over the log whose readable documents are diffed among themselves."""
    return D.diff_runs(derived.broken_plan_runs(spark, sf_dir)).select("run_id", "prev_run_id")


def _nodes_and_catalog(spark, sf_dir, rules=A.RULE_ORDER):
    """The nodes, with what ``rules`` look at (None: with all columns), and the catalog."""
    nodes = flatten_plans(derived.plan_runs(spark, sf_dir), columns=rules and A.node_columns(rules))
    fk = derived.fk_tables(spark, sf_dir)
    cat = derived.fk_catalog(spark, fk)
    return nodes, Catalog(cat.columns, derived.index_catalog(spark), cat.constraints)


def _rule(rule_id):
    def run(spark, sf_dir):
        nodes, cat = _nodes_and_catalog(spark, sf_dir, [rule_id])
        return flat_findings(A.advise(nodes, cat, rules=[rule_id])).select(*PLAN_FINDING_COLS)
    run.__name__ = "q_" + rule_id.split(".")[1]
    return run


def q_advise_all(spark, sf_dir):
    nodes, cat = _nodes_and_catalog(spark, sf_dir)
    return flat_findings(A.advise(nodes, cat)).select(*PLAN_FINDING_COLS)


def q_findings_rollup(spark, sf_dir):
    nodes, cat = _nodes_and_catalog(spark, sf_dir)
    return A.findings_rollup(A.advise(nodes, cat, columns=A.ROLLUP_COLUMNS)).select(
        "rule_id", "severity", "identifier", F.col("findings").cast("bigint"))


def q_report_lines(spark, sf_dir):
    nodes, cat = _nodes_and_catalog(spark, sf_dir)
    return report_lines(A.advise(nodes, cat)).select("line")


EVIDENCE_TYPE = ("struct<rows:double,cost:double,factor:double,estimated:double,actual:double,sort_method:string,"
                 "space_kb:bigint,loops:double,indexes:array<string>,sampled:boolean,sample_size:bigint,"
                 "`distinct`:bigint,`values`:array<string>,orphan_ratio:double,parent:string>")


def q_findings_evidence(spark, sf_dir):
    """K1: the findings of all nine rules written as JSON lines and read back, with
    every field of their evidence."""
    nodes, cat = _nodes_and_catalog(spark, sf_dir)
    tables = derived.fk_tables(spark, sf_dir)
    found = A.advise(nodes, cat).unionByName(infer_constraints(tables, derived.fk_catalog(spark, tables)))
    path = new_work_path(spark, "findings-json")
    write_findings_json(found, path, compression="gzip", own_evidence=True)
    e = F.col("evidence").alias("e")
    return read_findings_json(spark, path, EVIDENCE_TYPE).select("rule_id", "location.identifier", "run_id", "node_ord", e).select(
        "rule_id", "identifier", "run_id", "node_ord", "e.rows", "e.cost", "e.factor", "e.estimated", "e.actual",
        "e.sort_method", "e.space_kb", "e.loops", F.array_join("e.indexes", "|").alias("indexes"), "e.sampled",
        "e.sample_size", F.col("e.distinct").alias("distinct_values"), F.array_join("e.values", "|").alias("value_list"),
        "e.orphan_ratio", "e.parent")


# ---- catalog -----------------------------------------------------------------

def _assembled(spark, sf_dir):
    """The tables and their catalog (C1); its key listings arrive as one row per key
    column, out of order, and are put into lists (C1a)."""
    tables = derived.fk_tables(spark, sf_dir)
    cat = derived.fk_catalog(spark, tables)
    keys = cat.constraints.select("table_name", "constraint_name", "kind", "definition",
                                  F.posexplode("column_names").alias("ordinal", "name")).orderBy(F.desc("ordinal"))
    lists = key_columns_to_lists(keys, ["table_name", "constraint_name", "kind", "definition"], "ordinal", "name", "column_names")
    return tables, assemble_catalog(Catalog(cat.columns, derived.index_catalog(spark), lists))


def q_catalog_check(spark, sf_dir):
    """What the catalog declares of each column beside what its rows show."""
    tables, catalog = _assembled(spark, sf_dir)
    cols = catalog.select("table_name", "indexes", "constraints", F.explode("columns").alias("c")).select(
        "table_name", F.col("c.name").alias("column_name"), F.col("c.nullable").alias("nullable"),
        has_unique_on(F.col("indexes"), F.col("constraints"), F.array("c.name")).alias("declared_unique"))
    seen = column_profile(tables).select("table_name", "column_name", "data_type", "row_count", "null_count", "distinct_count")
    full = F.col("distinct_count") == F.col("row_count") - F.col("null_count")
    holds = (F.col("nullable") | (F.col("null_count") == 0)) & (~F.col("declared_unique") | full)
    return cols.join(seen, ["table_name", "column_name"]).withColumn("holds", holds)


def q_key_pair_types(spark, sf_dir):
    """C4: both columns of each key pair looked up in the catalog, beside the pair's orphans."""
    tables, catalog = _assembled(spark, sf_dir)
    catalog = materialize(catalog, "catalog")  # looked up many times
    ratios = orphan_ratios(tables, ORPHAN_PAIRS).select("child_table", "child_column", "parent_table", "parent_column",
                                                        "child_rows", "orphan_rows")
    found = None
    for table, column in sorted({p[:2] for p in ORPHAN_PAIRS} | {p[2:] for p in ORPHAN_PAIRS}):
        hit = lookup_column(catalog, table, column).select("table_name", "column.name", "column.data_type")
        found = hit if found is None else found.unionByName(hit)
    child = found.toDF("child_table", "child_column", "child_type")
    parent = found.toDF("parent_table", "parent_column", "parent_type")
    return (ratios.join(child, ["child_table", "child_column"]).join(parent, ["parent_table", "parent_column"])
            .withColumn("same_type", F.col("child_type") == F.col("parent_type")))


# ---- history and diffs -------------------------------------------------------

def q_query_fingerprint(spark, sf_dir):
    return derived.plan_runs(spark, sf_dir).select("run_id", "query_hash")


def q_latest_runs(spark, sf_dir):
    runs = derived.plan_runs(spark, sf_dir).select("query_hash", "run_id", "git_ref", "execution_time_ms")
    return H.latest_runs(runs)


def q_runs_newest_first(spark, sf_dir):
    runs = derived.plan_runs(spark, sf_dir).select("run_id", "query_hash")
    return H.runs_newest_first(runs).select("run_id", "query_hash", "pos_desc")


def q_previous_runs(spark, sf_dir):
    runs = derived.plan_runs(spark, sf_dir).select("run_id", "query_hash")
    return H.previous_runs(runs).select("run_id", "query_hash", "prev_run_id")


def _written_log(spark, sf_dir):
    """The plan log for queries that read it more than once: derived once, written without what
    plans are not compared by."""
    return materialize(derived.plan_runs(spark, sf_dir).select("run_id", "query_hash", "git_ref", "plan_json"), "plan-log")


def q_plan_diffs(spark, sf_dir):
    return D.diff_runs(derived.plan_runs(spark, sf_dir))


def q_node_deltas(spark, sf_dir):
    return D.node_deltas(derived.plan_runs(spark, sf_dir))


def q_baseline_vs_candidate(spark, sf_dir):
    """D3: per query, its first run as baseline and its latest as candidate."""
    runs = _written_log(spark, sf_dir)
    pairs = (runs.groupBy("query_hash").agg(F.min("run_id").alias("before_run_id"),
                                            F.max("run_id").alias("after_run_id"))
             .where(F.col("before_run_id") < F.col("after_run_id")))
    return D.diff_pairs(materialize(D.run_summaries(runs), "run-summaries"), pairs)


def q_baseline_node_deltas(spark, sf_dir):
    """D3, the nodes: per query, its first run against its latest, position by position."""
    runs = _written_log(spark, sf_dir)
    pairs = (runs.groupBy("query_hash").agg(F.min("run_id").alias("before_run_id"),
                                            F.max("run_id").alias("after_run_id"))
             .where(F.col("before_run_id") < F.col("after_run_id")))
    nodes = flatten_plans(runs, columns=D.DELTA_COLS).select("run_id", *D.DELTA_COLS)
    return D.node_deltas_for_pairs(pairs, materialize(nodes, "nodes"))


def q_slowdown_history(spark, sf_dir):
    return D.slowdown_history(D.diff_runs(derived.plan_runs(spark, sf_dir)))


def q_redact_documents(spark, sf_dir):
    docs = load_tables(spark, sf_dir, ["documents"])["documents"]
    red = redact_credentials(F.col("text"))
    return docs.select("doc_id", red.alias("text_redacted"), (red != F.col("text")).alias("changed"))


def q_regression_watch(spark, sf_dir):
    from checkup.streaming.watch import replay_as_stream
    # what arrives is what the watch reads of a run
    runs = derived.plan_runs(spark, sf_dir).select("run_id", "query_hash", "git_ref", "plan_json")
    return replay_as_stream(spark, runs, arrivals=3)


def q_record_runs(spark, sf_dir):
    """H2, K4, K5: the log recorded in three batches, redacted and trimmed, under
    gapless ids, and read back."""
    runs = derived.plan_runs(spark, sf_dir).withColumnRenamed("run_id", "order_key").drop("execution_time_ms")
    runs = materialize(runs, "plan-log")  # every batch reads it
    store = RunStore(spark, new_work_path(spark, "run-store"))
    for batch in range(3):
        part = H.redact_log(runs.where(F.col("order_key") % 3 == batch))
        store.record(trim_plan_documents(part), batch, ["recorded_at", "order_key"])
    return store.runs().select("run_id", "order_key", "query_hash", "query_text",
                               F.get_json_object("plan_json", "$[0]['Planning Time']").cast("double").alias("planning_time_ms"))


def q_plan_file_stream(spark, sf_dir):
    """S2 as a stream: a plan file per supplier, in three arrivals; readable ones are
    recorded, each broken one is a finding."""
    base = new_work_path(spark, "plan-files")
    docs = materialize(derived.supplier_plans(spark, sf_dir), "supplier-plans")
    stream = PlanFileStream(f"{base}/source", f"{base}/store", f"{base}/quarantine", f"{base}/checkpoint")
    tasks = 4 * spark.sparkContext.defaultParallelism  # a stated number: few bytes, but a file per supplier
    for arrival in range(3):
        (docs.where(F.col("l_suppkey") % 3 == arrival).repartition(tasks, "l_suppkey").write.partitionBy("l_suppkey")
         .text(f"{base}/source/arrival_{arrival}"))
        stream.start(spark).awaitTermination()
    supplier = F.regexp_extract("source", "l_suppkey=([0-9]+)", 1).cast("bigint").alias("supplier")
    none = F.lit(None)
    good = plan_summaries(stream.runs(spark), keep=("run_id", "source")).select(
        supplier, "run_id", none.cast("string").alias("reason"), "node_count", "root_cost")
    bad = stream.findings(spark).withColumn("source", F.col("location.identifier")).select(
        supplier, none.cast("bigint").alias("run_id"), F.get_json_object("evidence", "$.reason").alias("reason"),
        none.cast("bigint").alias("node_count"), none.cast("double").alias("root_cost"))
    return good.unionByName(bad)


def q_user_rules(spark, sf_dir):
    """Three rules of a user over the plan log: one that finds sorts on disk below
    large joins, one that fails while it runs on some row, one that does not apply."""
    nodes, cat = _nodes_and_catalog(spark, sf_dir, None)
    nodes = materialize(nodes, "nodes")  # read again, rule by rule, when one fails
    note = [F.lit("INFO").alias("severity"), F.lit("").alias("detail"), "run_id", "node_ord"]

    def wide(nodes, catalog):
        return nodes.where("node_type = 'SORT' AND estimated_rows >= 40").select(F.lit("Wide sort").alias("title"), *note)

    def breaks(nodes, catalog):
        wrong = F.when(F.col("node_ord") > 3, F.raise_error(F.lit("no such node"))).otherwise(F.lit("Never seen"))
        return nodes.select(wrong.cast("string").alias("title"), *note)

    rules = [A.UserRule("user.wide_sort", wide), A.UserRule("user.breaks", breaks),
             A.UserRule("user.not_here", breaks, applies_to=lambda nodes, catalog: "sort_key" in nodes.columns)]
    found = A.run_user_rules(nodes, cat, rules)[0]
    return found.select("rule_id", "severity", "title", "run_id", "node_ord")


JOBS = {
    "column_profile": q_column_profile,
    "column_profile_sampled": q_column_profile_sampled,
    "distinct_values": q_distinct_values,
    "orphan_ratio": q_orphan_ratio,
    "infer_not_null": q_infer_not_null,
    "infer_unique": q_infer_unique,
    "infer_enum": q_infer_enum,
    "infer_fk": q_infer_fk,
    "infer_all": q_infer_all,
    "infer_all_sampled": q_infer_all_sampled,
    "ddl_script": q_ddl_script,
    "infer_report": q_infer_report,
    "plan_nodes": q_plan_nodes,
    "plan_roundtrip": q_plan_roundtrip,
    "plan_documents": q_plan_documents_ok,
    "plan_errors": q_plan_errors,
    "broken_log_diffs": q_broken_log_diffs,
    "advise_seq_scan": _rule(A.SEQ_SCAN),
    "advise_row_estimate": _rule(A.ROW_ESTIMATE),
    "advise_sort_spill": _rule(A.SORT_SPILL),
    "advise_nested_loop": _rule(A.NESTED_LOOP),
    "advise_unused_index": _rule(A.UNUSED_INDEX),
    "advise_all": q_advise_all,
    "findings_rollup": q_findings_rollup,
    "report_lines": q_report_lines,
    "query_fingerprint": q_query_fingerprint,
    "latest_runs": q_latest_runs,
    "runs_newest_first": q_runs_newest_first,
    "previous_runs": q_previous_runs,
    "plan_diffs": q_plan_diffs,
    "node_deltas": q_node_deltas,
    "baseline_vs_candidate": q_baseline_vs_candidate,
    "baseline_node_deltas": q_baseline_node_deltas,
    "findings_evidence": q_findings_evidence,
    "catalog_check": q_catalog_check,
    "key_pair_types": q_key_pair_types,
    "slowdown_history": q_slowdown_history,
    "redact_documents": q_redact_documents,
    "regression_watch": q_regression_watch,
    "user_rules": q_user_rules,
    "record_runs": q_record_runs,
    "plan_file_stream": q_plan_file_stream,
}
