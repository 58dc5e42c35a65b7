"""Hot queries, null keys, odd names and values, failing rules."""

import pytest
from pyspark.sql import functions as F

from checkup import api
from checkup.functions import trunc_int
from checkup.operators import history as H
from checkup.operators.infer import DataRule, infer_constraints
from checkup.operators.profile import column_profile, orphan_ratio
from checkup.session import shared_dir
from checkup.sources.catalog import Catalog, columns_listing


def test_no_range_holds_more_than_its_share_of_a_hot_query(spark):
    hot = spark.range(40_000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("q"), F.col("id") % 50)).alias("k"),
                                     F.when(F.col("id") == 0, 1).otherwise(10**12 + F.col("id")).alias("o"))
    ranged = H.in_ranges(hot, "k", "o", 1000)
    sizes = ranged.groupBy("_b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1300 and sizes.count() >= 35
    # the number of ranges follows the data: no cap
    assert H.in_ranges(hot, "k", "o", 20).select("_b").distinct().count() > 1500
    plan = H.sequence_within(hot, "k", "o", rows_per_bucket=1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "_b" in text
        got = plan.where("k = 'hot'").agg(F.max("pos_asc"), F.count(F.when(F.col("prev_o").isNull(), 1)), F.count("*")).first()
        assert tuple(got) == (32_000, 1, 32_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_query_hashes_are_one_group(spark):
    runs = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "query_hash string, run_id long")
    got = {r.run_id: r.prev_run_id for r in H.previous_runs(runs).collect()}
    assert got == {1: None, 2: None, 3: 1}


def test_large_numbers_are_shown_without_overflow(spark):
    df = spark.createDataFrame([(1e20,), (12.9,), (-3.5,), (1e300,), (None,), (float("inf"),)], "v double")
    got = [r[0] for r in df.select(trunc_int("v")).collect()]
    assert got == ["100000000000000000000", "12", "-3", "1.0E300", None, "Infinity"]


def test_odd_inputs_of_the_profile(spark):
    assert column_profile({}).count() == 0
    assert column_profile({"m": spark.sql("SELECT map(1, 2) AS m")}).count() == 0
    odd = spark.createDataFrame([(1,), (None,)], "`a``b` int")
    row = column_profile({"t": odd}).first()
    assert (row.column_name, row.null_count, row.distinct_count) == ("a`b", 1, 1)
    child = spark.createDataFrame([("1",), ("x1",), (None,)], "pid string")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    assert tuple(orphan_ratio(child, "pid", parent, "id").first()) == (2, 1, 0.5)


def test_a_failing_rule_does_not_stop_the_others(spark):
    tables = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")}
    catalog = Catalog(columns_listing(spark, tables))
    assert infer_constraints({}, catalog).count() == 0

    def good(profile, catalog, tables):
        return profile.where("distinct_count = 2").select(
            F.lit("INFO").alias("severity"), F.col("column_name").alias("title"), F.lit("two values").alias("detail"))

    def late(profile, catalog, tables):
        return profile.select(F.lit("INFO").alias("severity"), F.col("column_name").cast("int").cast("string").alias("title"),
                              F.lit("").alias("detail"))

    def early(profile, catalog, tables):
        raise KeyError("no such table")

    rules = [DataRule("own.good", good), DataRule("own.late", late), DataRule("own.early", early)]
    rows = api.infer(tables, catalog, extra_rules=rules, isolate=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.rule_id, []).append((r.severity, r.title))
    assert sorted(t for _, t in by["own.good"]) == ["id", "name"]
    assert by["own.late"] == [("WARN", "Advisor own.late failed")] and by["own.early"][0][0] == "WARN"
    assert "inferencer.not_null" in by
    with pytest.raises(ValueError):
        infer_constraints(tables, catalog, extra_rules=[rules[0], rules[0]])


def test_shared_folder_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_missing_watch_state_is_an_error(spark, workdir):
    from checkup.streaming.watch import RegressionWatch

    watch = RegressionWatch("", f"{workdir}/diffs", f"{workdir}/state", "")
    assert watch._prior(spark, 0).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        watch._prior(spark, 7)


def test_findings_json_nests_evidence_and_keeps_nulls(spark, workdir):
    import json
    import os

    from checkup.plans.flatten import document_errors
    from checkup.sinks.report import write_findings_json

    deep = '{"Node Type": "Result", "Plans": [' * 900 + '{"Node Type": "Result"}' + "]}" * 900
    runs = spark.createDataFrame([(1, None), (2, "no json"), (3, "[]"), (4, '[{"Plan": ' + deep + "}]")],
                                 "run_id long, plan_json string")
    write_findings_json(document_errors(runs), f"{workdir}/findings")
    rows = [json.loads(line) for f in os.listdir(f"{workdir}/findings") if f.endswith(".json")
            for line in open(f"{workdir}/findings/{f}")]
    got = {r["run_id"]: r["evidence"]["reason"] for r in rows}
    assert got == {1: "null_document", 2: "not_json", 3: "no_plan", 4: "not_json"}
    assert all("suggestion" in r and r["suggestion"] is None and "rule_rank" not in r for r in rows)


def test_own_evidence_is_set_into_the_lines_and_read_in_one_pass(spark, workdir):
    import json

    from checkup import schemas
    from checkup.jobs import EVIDENCE_TYPE
    from checkup.sinks.report import read_findings_json, write_findings_json

    texts = ['{"rows":12345.5,"cost":1.0E7}', '{"indexes":["a\\"b","é中"],"space_kb":7}', None, "{}", '{"space_kb":"many","loops":3.0}',
             '{"distinct":2,"values":["x","y"],"sampled":false,"sample_size":9,"parent":"p.id","orphan_ratio":0.25}',
             '{"sort_method":"external merge","space_kb":null}', "[1]", '"text"']
    rows = [("r", 1, "WARN", f'line one\nline "two" {i}', None, ("table", "t") if i % 2 else None, e, ("note", None, "") if i % 3 else None,
             None, None, None, i, i * 10) for i, e in enumerate(texts)]
    found = spark.createDataFrame(rows, schemas.FINDINGS)
    write_findings_json(found, f"{workdir}/parsed")
    write_findings_json(found, f"{workdir}/own", compression="gzip", own_evidence=True)
    lines = lambda at: sorted((json.loads(r.value) for r in spark.read.text(at).collect()), key=lambda r: r["run_id"])
    assert lines(f"{workdir}/own") == lines(f"{workdir}/parsed") and len(lines(f"{workdir}/own")) == len(rows)
    cols = ["rule_id", "title", "location", "suggestion", "run_id", "node_ord"]
    text = read_findings_json(spark, f"{workdir}/parsed").select(*cols, F.from_json("evidence", EVIDENCE_TYPE).alias("e"))
    typed = read_findings_json(spark, f"{workdir}/own", EVIDENCE_TYPE).select(*cols, F.col("evidence").alias("e"))
    flat = lambda df: sorted(map(str, df.select(*cols, "e.*").collect()))
    assert flat(typed) == flat(text)
    assert "space_kb" in typed.select("e.*").columns and typed.where("e.loops = 3 AND e.space_kb IS NULL").count() == 1
