import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checkup.functions import query_hash
from checkup.operators import diff as D
from checkup.operators import history as H
from checkup.plans import flatten_plans, plan_summaries
from tests import plan_docs as P


def _runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, query_hash string, git_ref string, plan_json string")


def test_fingerprint_contract(spark):
    df = spark.createDataFrame([
        ("SELECT * FROM t WHERE a = 1",), ("select *\n  from T   where A = 1 ",),
        ("SELECT * FROM t WHERE a = 2",), ("SELECT * FROM t WHERE s = 'Ab  C'",),
        ("select * from t where s = 'ab c'",), ("",), (None,)], "q string")
    h = [r.h for r in df.select(query_hash("q").alias("h")).collect()]
    assert h[0] == h[1] and h[0] != h[2] and h[3] != h[4]
    assert all(x is not None and len(x) == 64 for x in h)


def test_verdicts(spark):
    runs = _runs(spark, [
        (1, "q", "a", P.SLOW), (2, "q", "b", P.FAST), (3, "q", "c", P.SLOW), (4, "q", "d", P.SLOW),
        (5, "q", "e", P.BIG_SCAN), (6, "other", "f", P.SLOW)])
    d = {r.run_id: r for r in D.diff_runs(runs).collect()}
    assert d[1].verdict is None and d[1].prev_run_id is None and d[6].verdict is None
    assert d[2].verdict == "FASTER" and d[2].aligned and d[2].prev_run_id == 1
    assert d[3].verdict == "SLOWER" and d[4].verdict == "SAME"
    assert d[5].verdict == "STRUCTURE_CHANGED" and d[5].aligned is False
    assert d[5].time_before_ms == 13.1 and d[5].time_after_ms == 15.6
    deltas = D.node_deltas(runs).where("run_id = 2").orderBy("node_ord").collect()
    assert [(x.node_type, x.relation, x.node_type_changed) for x in deltas] == [
        ("NESTED_LOOP", None, False), ("INDEX_SCAN", "orders", True), ("INDEX_SCAN", "customers", False)]
    assert deltas[1].cost_before == 200.0 and deltas[1].cost_after == 10.0 and deltas[1].rows_before == 100.0
    assert D.node_deltas(runs).where("run_id = 5").count() == 0


def test_metric_falls_back_to_cost_and_zero_is_same(spark):
    no_time = P.doc(P.node("Hash", 1, 100.0))
    cheap = P.doc(P.node("Hash", 1, 5.0), execution=50.0)
    zero = P.doc(P.node("Hash", 1, 0.0))
    runs = _runs(spark, [(1, "q", None, no_time), (2, "q", None, cheap), (3, "z", None, zero),
                         (4, "z", None, cheap)])
    d = {r.run_id: r for r in D.diff_runs(runs).collect()}
    assert d[2].verdict == "FASTER" and d[2].metric_before_kind == "root_cost"
    assert d[2].metric_after_kind == "execution_time" and d[2].metric_before == 100.0
    assert d[4].verdict == "SAME"


def test_unknown_types_align(spark):
    a = P.doc(P.node("Gather", 1, 10.0))
    b = P.doc(P.node("Incremental Sort", 1, 10.0))
    runs = _runs(spark, [(1, "q", None, a), (2, "q", None, b)])
    x = D.node_deltas(runs).first()
    assert x.node_type == "UNKNOWN" and x.node_type_changed is False


def test_explicit_pairs(spark):
    runs = _runs(spark, [(1, "q", None, P.SLOW), (2, "q", None, P.FAST), (3, "q", None, P.BIG_SCAN)])
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, 3)], "before_run_id long, after_run_id long")
    v = {(r.before_run_id, r.after_run_id): r.verdict for r in D.diff_pairs(D.run_summaries(runs), pairs).collect()}
    assert v == {(1, 2): "FASTER", (2, 1): "SLOWER", (1, 1): "SAME", (1, 3): "STRUCTURE_CHANGED"}
    nd = D.node_deltas_for_pairs(pairs, flatten_plans(runs))
    assert nd.where("run_id = 2 AND prev_run_id = 1").count() == 3 and nd.where("run_id = 3").count() == 0


def test_latest_and_newest_first(spark):
    runs = _runs(spark, [(5, "q", "x", P.SLOW), (9, "q", "y", P.FAST), (7, "p", "z", P.SLOW)])
    latest = {r.query_hash: (r.run_id, r.git_ref) for r in H.latest_runs(runs).collect()}
    assert latest == {"q": (9, "y"), "p": (7, "z")}
    assert [r.run_id for r in H.runs_newest_first(runs, "q").collect()] == [9, 5]
    pos = {r.run_id: r.pos_desc for r in H.runs_newest_first(runs).collect()}
    assert pos == {9: 1, 5: 2, 7: 1}


def test_slowdown_history(spark):
    runs = _runs(spark, [(1, "q", "v1", P.FAST), (2, "q", "v2", P.SLOW), (3, "q", "v3", P.FAST),
                         (4, "q", "v4", P.SLOW)])
    r = D.slowdown_history(D.diff_runs(runs)).first()
    assert (r.slower_runs, r.first_slower_run_id, r.first_slower_git_ref, r.last_slower_git_ref) == (2, 2, "v2", "v4")


def test_sequence_within_matches_plain_window(spark):
    """The bucketed ordering equals a plain window, also across bucket edges
    and for one hot key holding most rows."""
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}"
        # sparse, uneven ids: gaps up to 1000
        rows.append((key, i * 1000 + rnd.randrange(1000), float(rnd.randrange(100))))
    df = spark.createDataFrame(rows, "k string, o long, v double")
    got = H.sequence_within(df, "k", "o", carry=("v",), rows_per_bucket=7)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.lag("o").over(w).alias("prev_o"), F.lag("v").over(w).alias("prev_v"),
                     F.row_number().over(w).alias("pos_asc"),
                     F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"))).alias("pos_desc"))
    cols = ["k", "o", "prev_o", "prev_v", "pos_asc", "pos_desc"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_summaries_node_arrays(spark):
    s = plan_summaries(_runs(spark, [(1, "q", None, P.SLOW)]), keep=("run_id",), with_nodes=True).first()
    assert s.node_count == 3 and [n.node_ord for n in s.nodes] == [1, 2, 3]
    assert s.nodes[1].relation == "orders"
