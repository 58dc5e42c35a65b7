import contextlib
import io
import json

from checkup.plans import flatten_plans, plan_summaries, split_plan_documents, trim_plan_documents
from tests import plan_docs as P


def _runs(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "run_id long, plan_json string")


def test_three_nodes_in_preorder(spark):
    rows = flatten_plans(_runs(spark, [P.SLOW])).orderBy("node_ord").collect()
    assert [r.node_type for r in rows] == ["NESTED_LOOP", "SEQ_SCAN", "INDEX_SCAN"]
    assert [r.node_ord for r in rows] == [1, 2, 3]
    assert [r.depth for r in rows] == [0, 1, 1]
    root = rows[0]
    assert root.max_child_loops == 950.0 and root.child_count == 2
    assert rows[1].relation == "orders" and rows[1].misestimate_factor == 9.5
    assert rows[2].total_actual_rows == 950.0 and rows[2].misestimate_factor == 950.0
    assert rows[2].heat == "high" and rows[1].heat == "none"


def test_timings_from_document(spark):
    s = plan_summaries(_runs(spark, [P.SLOW])).first()
    assert s.planning_time_ms == 0.35 and s.execution_time_ms == 13.1
    assert s.node_count == 3 and s.root_cost == 250.5 and s.root_node_type == "NESTED_LOOP"


def test_unknown_types_and_defaults(spark):
    d = '{"Plan": {"Node Type": "Gather Merge Turbo", "Plan Rows": null, "Plans": []}}'
    r = flatten_plans(_runs(spark, [d])).first()
    assert r.node_type == "UNKNOWN" and r.node_type_raw == "Gather Merge Turbo"
    assert r.estimated_rows == 0.0 and r.estimated_cost == 0.0 and r.loops == 1.0
    assert r.actual_rows is None and r.total_actual_rows is None and r.misestimate_factor is None
    assert r.max_child_loops == 0.0 and r.child_count == 0


def test_preorder_deep_and_wide(spark):
    d = P.doc(P.node("Hash Join", 1, 1, plans=[
        P.node("Hash", 1, 2, plans=[P.node("Seq Scan", 1, 3, relation="a"), P.node("Seq Scan", 1, 4, relation="b")]),
        P.node("Sort", 1, 5, plans=[P.node("Limit", 1, 6)]),
        P.node("Aggregate", 1, 7),
    ]))
    costs = [r.estimated_cost for r in flatten_plans(_runs(spark, [d])).orderBy("node_ord").collect()]
    assert costs == [1, 2, 3, 4, 5, 6, 7]


def test_chain_of_41(spark):
    rows = flatten_plans(_runs(spark, [P.chain(41)])).orderBy("node_ord").collect()
    assert len(rows) == 41 and rows[-1].depth == 40 and rows[-1].relation == "t"


def test_zero_loops_and_dict_form(spark):
    d = P.doc(P.node("Seq Scan", 50000, 10, relation="t", actual=0, loops=0), as_list=False)
    r = flatten_plans(_runs(spark, [d])).first()
    assert r.loops == 0.0 and r.total_actual_rows == 0.0 and r.misestimate_factor is None


def test_bad_documents_are_split_out(spark):
    docs = [P.SLOW, "not json", None, '[{"Foo": 1}]', '{"Plan": null}']
    good, bad = split_plan_documents(_runs(spark, docs))
    assert [r.run_id for r in good.collect()] == [0]
    reasons = {r.run_id: r.reason for r in bad.collect()}
    assert reasons == {1: "not_json", 2: "null_document", 3: "no_plan", 4: "no_plan"}
    assert flatten_plans(_runs(spark, docs)).select("run_id").distinct().count() == 1


def test_trimmed_payload_flattens_to_same_nodes(spark):
    runs = _runs(spark, [P.SLOW, P.BIG_SCAN, P.chain(5)])
    trimmed = trim_plan_documents(runs)
    payload = json.loads(trimmed.where("run_id = 1").first().plan_json)
    assert isinstance(payload, list) and set(payload[0]) == {"Plan", "Planning Time", "Execution Time"}
    cols = ["run_id", "node_ord", "node_type", "relation", "estimated_rows", "actual_rows", "loops"]
    a = flatten_plans(runs).select(*cols).orderBy("run_id", "node_ord").collect()
    b = flatten_plans(trimmed).select(*cols).orderBy("run_id", "node_ord").collect()
    assert a == b


def test_flatten_is_map_side(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        flatten_plans(_runs(spark, [P.SLOW])).explain()
    plan = buf.getvalue()
    assert "Exchange" not in plan and "Window" not in plan and "Generate" in plan


def test_only_asked_for_columns_are_read(spark):
    deep = P.node("Sort", 9, 7.0, loops=3, plans=[P.node("Seq Scan", 5, 1.0, relation="t", actual=0, loops=2)])
    for n in range(6):  # deeper than what is read at once
        deep = P.node("Limit", n, 2.0, plans=[P.node("Seq Scan", 1, 1.0, relation=f"r{n}"), deep])
    runs = _runs(spark, [P.SLOW, P.doc(deep), "[]", None, P.BIG_SCAN])
    for cols in (["run_id", "node_ord", "relation"], ["run_id", "node_ord", "max_child_loops"], ["run_id", "node_ord", "depth", "heat"]):
        few = flatten_plans(runs, columns=cols)
        assert few.columns == sorted(cols, key=["run_id", "node_ord", "depth", "relation", "max_child_loops", "heat"].index)
        got = few.select(*cols).orderBy("run_id", "node_ord").collect()
        assert got == flatten_plans(runs, with_raw=True).select(*cols).orderBy("run_id", "node_ord").collect()
        assert len(got) == 3 + 14 + 1
    plan = flatten_plans(runs, columns=["run_id", "node_ord", "relation"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation Name" in plan and "Actual Rows" not in plan


def test_summaries_read_no_value_of_the_nodes_below(spark):
    plan = plan_summaries(_runs(spark, [P.SLOW]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Total Cost: double") <= 2  # of the root: in a list of documents, and at the top
    assert "Actual Loops" not in plan
