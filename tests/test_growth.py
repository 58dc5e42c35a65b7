import json
import os

from checkup import jobs
from checkup.operators.advise import advise
from checkup.plans import flatten_plans, plan_summaries, split_plan_documents, trim_plan_documents
from checkup.sinks.report import read_findings_json, write_findings_json
from checkup.sources import derived
from checkup.streaming.plan_files import listing_session
from tests import plan_docs as P

SMOKE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _runs(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "run_id long, plan_json string")


def test_documents_are_parsed_once(spark, workdir):
    _runs(spark, ['{"Plan": {}}']).write.parquet(f"{workdir}/runs")
    runs = spark.read.parquet(f"{workdir}/runs")
    for df in [plan_summaries(runs), plan_summaries(runs, with_nodes=True), trim_plan_documents(runs),
               *split_plan_documents(runs), flatten_plans(runs)]:
        assert _plan(df).count("parseJson") == 1


def test_plans_deeper_than_one_round_keep_their_order(spark):
    def chain(d):
        return {"Plan Rows": d, **({"Plans": [{"Plan Rows": 100 + d}, chain(d - 1), None]} if d else {})}

    def walk(n):
        return [(n or {}).get("Plan Rows", 0)] + [x for c in (n or {}).get("Plans", []) for x in walk(c)]

    runs = _runs(spark, [json.dumps([{"Plan": chain(11)}])])
    rows = flatten_plans(runs).orderBy("node_ord").collect()
    assert [r.estimated_rows for r in rows] == walk(chain(11))
    raw = flatten_plans(runs, with_raw=True).drop("raw").orderBy("node_ord").collect()
    assert raw == rows
    assert plan_summaries(runs).first().node_count == len(rows)


def test_a_plan_that_is_no_object_is_one_node(spark):
    runs = _runs(spark, ['{"Plan": 5}', '{"Plan": null}', "[]", "[null]", '{"Plan": {"Plans": 5}}'])
    assert sorted(r.run_id for r in flatten_plans(runs).collect()) == [0, 4]
    assert sorted(r.run_id for r in split_plan_documents(runs)[0].collect()) == [0, 4]


def test_the_log_is_derived_once(spark):
    for name in ["plan_documents", "baseline_vs_candidate", "baseline_node_deltas", "user_rules"]:
        read = jobs.JOBS[name](spark, SMOKE).inputFiles()
        assert read and not [f for f in read if "testdata" in f], name


def test_the_shuffle_of_the_log_carries_no_built_nodes(spark):
    plan = _plan(derived.plan_runs(spark, SMOKE).select("plan_json"))
    shuffled = plan[plan.index("Exchange"):]
    assert "Node Type" not in shuffled


def test_findings_can_be_written_compressed(spark, workdir):
    runs = _runs(spark, [json.dumps([{"Plan": {"Node Type": "Seq Scan", "Relation Name": "t", "Plan Rows": 20000}}])])
    found = advise(flatten_plans(runs))
    write_findings_json(found, f"{workdir}/plain")
    write_findings_json(found, f"{workdir}/small", compression="gzip")
    assert [f for f in os.listdir(f"{workdir}/small") if f.endswith(".json.gz")]
    a, b = (read_findings_json(spark, f"{workdir}/{x}").collect() for x in ("plain", "small"))
    assert a == b and len(a) == 1


def test_a_stream_lists_in_few_tasks(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    own = listing_session(spark)
    assert int(own.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert spark.conf.get(key) == before


def test_readable_documents_are_split_off_with_the_columns_asked_for(spark):
    runs = spark.createDataFrame([(1, P.SLOW), (2, "{"), (3, None)], "run_id long, plan_json string")
    good, bad = split_plan_documents(runs, columns=["run_id", "planning_time_ms"])
    assert good.columns == ["run_id", "planning_time_ms"] and [tuple(r) for r in good.collect()] == [(1, 0.35)]
    assert sorted((r.run_id, r.reason) for r in bad.collect()) == [(2, "not_json"), (3, "null_document")]
