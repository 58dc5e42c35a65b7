import json
import os

from pyspark.sql import functions as F

from checkup.functions import fmt_half_even, quote_ident, quote_literal, redact_credentials, trunc_int
from checkup.operators.findings import flat_findings
from checkup.operators.infer import infer_constraints
from checkup.sinks import (ddl_lines, infer_report_lines, record_runs, write_ddl_script,
                           write_findings_json, write_report)
from checkup.sources.catalog import Catalog, columns_listing


def test_redact(spark):
    df = spark.createDataFrame([("postgresql://bob:s3cr:et@host/db and http://a:b@c",), ("no url",)], "u string")
    got = [r.r for r in df.select(redact_credentials("u").alias("r")).collect()]
    assert got == ["postgresql://bob:***@host/db and http://a:***@c", "no url"]


def test_quoting_and_numbers(spark):
    df = spark.createDataFrame([('we"ird', "it's", 2.5, 3.5, -7.9)], "a string, b string, x double, y double, z double")
    r = df.select(quote_ident("a").alias("qi"), quote_literal("b").alias("ql"), fmt_half_even("x").alias("fx"),
                  fmt_half_even("y").alias("fy"), trunc_int("z").alias("tz")).first()
    assert (r.qi, r.ql, r.fx, r.fy, r.tz) == ('"we""ird"', "'it''s'", "2", "4", "-7")


def _findings(spark):
    t = {"t": spark.createDataFrame([("a", 1), ("a", 2)], "c string, u int"),
         "e": spark.createDataFrame([], "x int")}
    return infer_constraints(t, Catalog(columns_listing(spark, t)))


def test_ddl_and_reports(spark, workdir):
    f = _findings(spark)
    stmts = sorted(r.statement for r in ddl_lines(f).collect())
    assert 'ALTER TABLE "t" ADD CONSTRAINT t_u_key UNIQUE ("u");' in stmts
    lines = [r.line for r in infer_report_lines(f).collect()]
    assert any(x.startswith("SUGGEST: `t.c` is never null") and x.endswith("SET NOT NULL;") for x in lines)
    write_ddl_script(f, os.path.join(workdir, "ddl"))
    write_report(f, os.path.join(workdir, "report"))
    write_findings_json(f, os.path.join(workdir, "json"))
    parts = [p for p in os.listdir(os.path.join(workdir, "json")) if p.endswith(".json")]
    rec = [json.loads(x) for p in parts for x in open(os.path.join(workdir, "json", p))]
    assert rec and all("location" in r and "identifier" in r["location"] for r in rec)
    text = "".join(open(os.path.join(workdir, "ddl", p)).read() for p in sorted(os.listdir(os.path.join(workdir, "ddl")))
                   if p.startswith("part-"))
    assert text.index("SET NOT NULL") < text.index("UNIQUE")
    empty = infer_report_lines(f.limit(0), empty_marker=True).collect()
    assert [r.line for r in empty] == ["No candidate constraints found."]
    write_report(f.limit(0), os.path.join(workdir, "empty"))
    assert [r.value for r in spark.read.text(os.path.join(workdir, "empty")).collect()] == ["No findings."]
    assert flat_findings(f).where("table_name = 'e'").count() == 0


def test_record_runs_replay_does_not_double(spark, workdir):
    path = os.path.join(workdir, "history")
    a = spark.createDataFrame([(1, "q"), (2, "q")], "run_id long, query_hash string")
    record_runs(a, path, 0)
    record_runs(a, path, 0)
    record_runs(a.withColumn("run_id", F.col("run_id") + 10), path, 1)
    assert spark.read.parquet(path).count() == 4


def test_redact_log_columns(spark):
    from checkup.operators.history import redact_log
    runs = spark.createDataFrame([(1, "COPY x FROM 'postgres://etl:hunter2@db/x'")], "run_id long, query_text string")
    assert redact_log(runs).first().query_text == "COPY x FROM 'postgres://etl:***@db/x'"
