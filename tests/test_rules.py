import json

import pytest

from checkup.operators import advise as A
from checkup.operators.findings import flat_findings
from checkup.plans import flatten_plans
from checkup.sinks import report_lines
from checkup.sources.catalog import Catalog, columns_listing, indexes_listing
from tests import plan_docs as P


def _nodes(spark, *docs):
    runs = spark.createDataFrame(list(enumerate(docs)), "run_id long, plan_json string")
    return flatten_plans(runs)


def _rules(df):
    return [(r.rule_id, r.location_identifier) for r in flat_findings(df).orderBy("rule_id", "node_ord").collect()]


def test_slow_plan_findings(spark):
    f = _rules(A.advise(_nodes(spark, P.SLOW)))
    # 950x misestimate on the index probe of customers; nothing else fires.
    assert f == [("advisor.row_estimate", "customers")]


def test_seq_scan_rows_threshold(spark):
    f = flat_findings(A.advise(_nodes(spark, P.BIG_SCAN))).collect()
    assert [x.rule_id for x in f] == ["advisor.seq_scan"]
    assert f[0].detail.startswith("Sequential scan reads ~25000 rows from `orders`")
    small = P.doc(P.node("Seq Scan", 9999, 1.0, relation="t", actual=9999, loops=1))
    assert A.advise(_nodes(spark, small)).count() == 0
    edge = P.doc(P.node("Seq Scan", 10000, 1.0, relation="t", actual=10000, loops=1))
    assert _rules(A.advise(_nodes(spark, edge))) == [("advisor.seq_scan", "t")]


def test_seq_scan_uses_estimate_when_actual_is_zero(spark):
    never_run = P.doc(P.node("Seq Scan", 50000, 1.0, relation="t", actual=0, loops=0))
    assert _rules(A.advise(_nodes(spark, never_run))) == [("advisor.seq_scan", "t")]
    no_relation = P.doc(P.node("Seq Scan", 50000, 1.0))
    assert A.advise(_nodes(spark, no_relation), rules=[A.SEQ_SCAN]).count() == 0


def test_row_estimate_inclusive_and_text(spark):
    d = P.doc(P.node("Hash", 1, 1.0, actual=100, loops=1))
    f = flat_findings(A.advise(_nodes(spark, d))).first()
    assert f.title == "Row estimate off by 100× at HASH"
    assert f.detail == "Planner estimated 1 rows but got 100. Bad estimates lead to bad plans."
    assert f.suggestion_note == "Run ANALYZE on the involved tables."
    d2 = P.doc(P.node("Hash", 1, 1.0, actual=99, loops=1))
    assert A.advise(_nodes(spark, d2)).count() == 0


def test_row_estimate_half_even(spark):
    d = P.doc(P.node("Hash", 2, 1.0, actual=1001, loops=1))   # factor 500.5 -> "500"
    assert flat_findings(A.advise(_nodes(spark, d))).first().title.startswith("Row estimate off by 500×")


def test_sort_spill(spark):
    d = P.doc(P.node("Sort", 10, 1.0, **{"Sort Method": "external MERGE", "Sort Space Used": 20480}))
    f = flat_findings(A.advise(_nodes(spark, d))).first()
    assert f.rule_id == "advisor.sort_spill" and f.severity == "SUGGEST"
    assert "(~20480 kB on disk)" in f.detail
    ev = json.loads(A.advise(_nodes(spark, d)).first().evidence)
    assert ev == {"sort_method": "external MERGE", "space_kb": 20480}
    mem = P.doc(P.node("Sort", 10, 1.0, **{"Sort Method": "quicksort", "Sort Space Used": 25}))
    assert A.advise(_nodes(spark, mem)).count() == 0
    no_space = P.doc(P.node("Sort", 10, 1.0, **{"Sort Method": "external sort"}))
    assert "(~None kB on disk)" in flat_findings(A.advise(_nodes(spark, no_space))).first().detail
    assert json.loads(A.advise(_nodes(spark, no_space)).first().evidence)["space_kb"] is None


def test_nested_loop(spark):
    hot = P.doc(P.node("Nested Loop", 1, 1.0, plans=[P.node("Seq Scan", 1, 1.0), P.node("Index Scan", 1, 1.0, loops=10000)]))
    f = flat_findings(A.advise(_nodes(spark, hot), rules=[A.NESTED_LOOP])).first()
    assert f.title == "Nested loop iterating 10000×" and f.location_identifier == "Nested Loop"
    cold = P.doc(P.node("Nested Loop", 1, 1.0, plans=[P.node("Index Scan", 1, 1.0, loops=9999)]))
    assert A.advise(_nodes(spark, cold), rules=[A.NESTED_LOOP]).count() == 0
    empty = P.doc(P.node("Nested Loop", 1, 1.0))
    assert A.advise(_nodes(spark, empty), rules=[A.NESTED_LOOP]).count() == 0


def _catalog(spark):
    t = {"orders": spark.range(1).selectExpr("id", "id AS customer_id"),
         "customers": spark.range(1)}
    idx = [("orders", "ix_orders_status", ["status"], False, None),
           ("orders", "ix_orders_customer_id", ["customer_id"], False, None),
           ("customers", "customers_pkey", ["id"], True, None),
           ("ghost", "ix_ghost", ["x"], False, None)]
    return Catalog(columns_listing(spark, t), indexes_listing(spark, idx))


def test_unused_index(spark):
    cat = _catalog(spark)
    d = P.doc(P.node("Hash Join", 1, 1.0, plans=[
        P.node("Seq Scan", 5, 1.0, relation="orders"), P.node("Seq Scan", 5, 1.0, relation="customers"),
        P.node("Seq Scan", 5, 1.0, relation="ghost"), P.node("Index Scan", 5, 1.0, relation="orders")]))
    f = flat_findings(A.advise(_nodes(spark, d), cat, rules=[A.UNUSED_INDEX])).collect()
    assert len(f) == 1 and f[0].severity == "INFO" and f[0].suggestion_kind is None
    assert "[ix_orders_customer_id, ix_orders_status]" in f[0].detail
    assert A.advise(_nodes(spark, d), None, rules=[A.UNUSED_INDEX]).count() == 0


def test_rule_order_and_report_lines(spark):
    d = P.doc(P.node("Hash Join", 1, 1.0, actual=100, loops=1, plans=[
        P.node("Seq Scan", 20000, 1.0, relation="orders", actual=200, loops=100)]))
    f = A.advise(_nodes(spark, d), _catalog(spark))
    assert [r.rule_id for r in f.orderBy("rule_rank").collect()] == \
        ["advisor.seq_scan", "advisor.row_estimate", "advisor.unused_index"]
    lines = [r.line for r in report_lines(f).orderBy("rule_rank").collect()]
    assert len(lines) == 3
    assert lines[0] == ("WARN: Seq Scan over large table `orders` [orders]\n    Sequential scan reads ~20000 rows "
                        "from `orders`. Consider an index on the filtered columns.")
    none = report_lines(A.advise(_nodes(spark, P.doc(P.node("Hash", 1, 1.0)))), empty_marker=True).collect()
    assert [r.line for r in none] == ["No findings."]


def test_rollup(spark):
    f = A.advise(_nodes(spark, P.SLOW, P.SLOW, P.BIG_SCAN))
    got = {(r.rule_id, r.identifier): r.findings for r in A.findings_rollup(f).collect()}
    assert got == {("advisor.row_estimate", "customers"): 2, ("advisor.seq_scan", "orders"): 1}
    lean = A.advise(_nodes(spark, P.SLOW, P.SLOW, P.BIG_SCAN), columns=A.ROLLUP_COLUMNS)
    assert lean.columns == A.ROLLUP_COLUMNS
    assert {(r.rule_id, r.identifier): r.findings for r in A.findings_rollup(lean).collect()} == got


def test_user_rules(spark):
    from pyspark.sql import functions as F

    def hashes(nodes, catalog):
        return nodes.where("node_type = 'HASH'").select(
            F.lit("INFO").alias("severity"), F.lit("hash node").alias("title"),
            F.lit("a hash").alias("detail"), "run_id", "node_ord")

    def broken(nodes, catalog):
        raise RuntimeError("boom")

    d = P.doc(P.node("Hash", 1, 1.0))
    f = A.advise(_nodes(spark, d), extra_rules=[A.UserRule("user.hash", hashes), A.UserRule("user.broken", broken)])
    rows = {r.rule_id: r for r in f.collect()}
    assert rows["user.hash"].title == "hash node"
    assert rows["user.broken"].severity == "WARN" and rows["user.broken"].detail == "boom"
    with pytest.raises(ValueError):
        A.advise(_nodes(spark, d), extra_rules=[A.UserRule("advisor.seq_scan", hashes)])


def test_user_rule_runtime_error_isolated(spark):
    from pyspark.sql import functions as F

    def fails_late(nodes, catalog):
        return nodes.select(F.lit("WARN").alias("severity"), F.lit("x").alias("title"),
                            F.raise_error(F.lit("late")).cast("string").alias("detail"))

    f = A.advise(_nodes(spark, P.SLOW), extra_rules=[A.UserRule("user.late", fails_late)], isolate=True)
    late = [r for r in f.collect() if r.rule_id == "user.late"]
    assert len(late) == 1 and late[0].title == "Advisor user.late failed"


def test_row_estimate_empty_relation_uses_type(spark):
    d = P.doc(P.node("Seq Scan", 1, 1.0, relation="", actual=500, loops=1))
    f = flat_findings(A.advise(_nodes(spark, d), rules=[A.ROW_ESTIMATE])).first()
    assert f.location_identifier == "SEQ_SCAN" and f.suggestion_note == "Run ANALYZE on the involved tables."


def test_user_rule_reads_raw_node(spark):
    from pyspark.sql import functions as F

    def workers(nodes, catalog):
        launched = F.try_variant_get("raw", '$["Workers Launched"]', "int")
        planned = F.try_variant_get("raw", '$["Workers Planned"]', "int")
        return nodes.where(launched < planned).select(
            F.lit("INFO").alias("severity"), F.lit("fewer workers than planned").alias("title"),
            F.format_string("%d of %d workers", launched, planned).alias("detail"), "run_id", "node_ord")

    d = P.doc(P.node("Gather", 1, 1.0, **{"Workers Planned": 4, "Workers Launched": 2}))
    runs = spark.createDataFrame([(0, d)], "run_id long, plan_json string")
    nodes = flatten_plans(runs, with_raw=True)
    f = [r for r in A.advise(nodes, extra_rules=[A.UserRule("user.workers", workers)]).collect()
         if r.rule_id == "user.workers"]
    assert len(f) == 1 and f[0].detail == "2 of 4 workers" and f[0].node_ord == 1


def test_one_failing_rule_keeps_all_other_findings(spark):
    from pyspark.sql import functions as F

    from checkup.operators.infer import DataRule, infer_constraints
    from checkup.sources.catalog import Catalog, columns_listing

    nodes = _nodes(spark, P.SLOW, P.FAST)
    say = [F.lit("INFO").alias("severity"), F.lit("t").alias("title"), F.lit("d").alias("detail"), "run_id", "node_ord"]
    late = F.when(F.col("node_ord") > 1, F.raise_error(F.lit("row k"))).otherwise(F.lit("x")).cast("string")
    rules = [A.UserRule("user.all", lambda n, c: n.select(*say)),
             A.UserRule("user.late", lambda n, c: n.select(late.alias("title"), *[x for x in say[0:1] + say[2:]])),
             A.UserRule("user.early", lambda n, c: n.select("no such column")),
             A.UserRule("user.silent", lambda n, c: n.select("no such column"), applies_to=lambda n, c: False),
             A.UserRule("user.unsure", lambda n, c: n.select(*say), applies_to=lambda n, c: 1 / 0)]
    rows = A.run_user_rules(nodes, None, rules)[0].collect()
    failed = {r.rule_id for r in rows if r.title.endswith("failed")}
    assert failed == {"user.late", "user.early", "user.unsure"} and all(r.severity == "WARN" for r in rows if r.rule_id in failed)
    assert sum(r.rule_id == "user.all" for r in rows) == nodes.count() and len(rows) == nodes.count() + 3
    table = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")}
    catalog = Catalog(columns_listing(spark, table))
    late_rule = DataRule("user.data", lambda p, c, t: t["t"].select(
        F.raise_error(F.lit("late")).cast("string").alias("title"), F.lit("INFO").alias("severity"), F.lit("").alias("detail")))
    plain = {r.title for r in infer_constraints(table, catalog).collect()}
    mixed = {r.title for r in infer_constraints(table, catalog, extra_rules=[late_rule]).collect()}  # without being asked
    assert mixed == plain | {"Advisor user.data failed"} and plain
