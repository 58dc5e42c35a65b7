import os

from pyspark.sql import functions as F

from checkup import api
from checkup.operators.catalog import key_columns_to_lists, lookup_column, lookup_table, assemble_catalog
from checkup.operators.findings import flat_findings
from checkup.operators.history import assign_run_ids
from checkup.sources import read_plan_files
from checkup.sources.catalog import Catalog, columns_listing, constraints_listing
from tests import plan_docs as P


def test_plan_files_source(spark, workdir):
    d = os.path.join(workdir, "plans")
    os.makedirs(d)
    for i, doc in enumerate([P.SLOW, P.BIG_SCAN, "{broken"]):
        with open(os.path.join(d, f"plan_{i}.json"), "w") as fh:
            fh.write(doc)
    runs = read_plan_files(spark, d)
    assert runs.count() == 3
    ids = [r.run_id for r in runs.orderBy("source").collect()]
    assert ids == sorted(ids)
    f = {r.rule_id for r in api.report(runs).collect()}
    assert f == {"advisor.row_estimate", "advisor.seq_scan", "plan.document"}  # the broken file is reported


def test_infer_without_catalog_and_quoted_names(spark):
    t = {'we"ird': spark.createDataFrame([(1, "a"), (2, "a")], "id int, c string")}
    f = {r.rule_id: r for r in flat_findings(api.infer(t)).collect()}
    assert f["inferencer.not_null"].suggestion_sql.startswith('ALTER TABLE "we""ird" ALTER COLUMN')


def test_composite_key_does_not_block_single_column(spark):
    t = {"pairs": spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "a int, b int")}
    cons = [("pairs", "pairs_pkey", "p", ["a", "b"], "PRIMARY KEY (a, b)")]
    f = flat_findings(api.infer(t, Catalog(columns_listing(spark, t), constraints=constraints_listing(spark, cons)),
                                rules=["inferencer.unique"])).collect()
    assert [r.location_identifier for r in f] == ["pairs.a"]


def test_key_columns_and_lookups(spark):
    rows = spark.createDataFrame([("t", "ix", 2, "b"), ("t", "ix", 1, "a"), ("t", "iy", 1, "c")],
                                 "table_name string, index_name string, ord int, attname string")
    got = {r.index_name: r.column_names for r in key_columns_to_lists(rows, ["table_name", "index_name"], "ord", "attname").collect()}
    assert got == {"ix": ["a", "b"], "iy": ["c"]}
    t = {"t": spark.createDataFrame([(1, "x")], "id int, name string")}
    tables = assemble_catalog(Catalog(columns_listing(spark, t)))
    assert lookup_table(tables, "t").count() == 1 and lookup_table(tables, "nope").count() == 0
    col = lookup_column(tables, "t", "name").first().column
    assert col.name == "name" and col.data_type == "text" and col.nullable
    assert lookup_column(tables, "t", "missing").count() == 0


def test_record_and_diff_batches(spark, workdir):
    base = os.path.join(workdir, "hist")
    first = spark.createDataFrame([(1, "q", "a", P.SLOW)], "run_id long, query_hash string, git_ref string, plan_json string")
    second = spark.createDataFrame([(2, "q", "b", P.FAST), (3, "p", "c", P.SLOW)],
                                   "run_id long, query_hash string, git_ref string, plan_json string")
    d0 = api.record_and_diff(first, base, 0).collect()
    assert [r.verdict for r in d0] == [None]
    d1 = {r.run_id: r.verdict for r in api.record_and_diff(second, base, 1).collect()}
    assert d1 == {2: "FASTER", 3: None}
    d1_again = {r.run_id: r.verdict for r in api.record_and_diff(second, base, 1).collect()}
    assert d1_again == d1 and spark.read.parquet(base + "/runs").count() == 3


def test_assign_run_ids(spark):
    df = spark.createDataFrame([("2024-01-03",), ("2024-01-01",), ("2024-01-02",)], "recorded_at string")
    rows = assign_run_ids(df, 41).orderBy("recorded_at").collect()
    ids = [r.run_id for r in rows]
    assert ids == sorted(ids) and ids[0] > 41
    assert F is not None
