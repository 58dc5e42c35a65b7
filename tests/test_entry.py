import duckdb

import __spark_entry__ as E
from checkup.jobs import JOBS
from tools.check_oracle import digest

SMOKE = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "rule_id" in df.columns


def test_every_query_has_sql():
    assert set(JOBS) <= set(E.oracle_sql()) <= set(E.queries())


def test_oracle_matches_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    sqls = E.oracle_sql()
    for name in ["infer_all", "plan_diffs", "advise_all", "orphan_ratio", "node_deltas", "findings_evidence",
                 "catalog_check", "key_pair_types", "baseline_node_deltas"]:
        df = E.queries()[name](spark, SMOKE)
        cur = con.execute(sqls[name])
        cols = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(cols), name
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, cur.fetchall())[0], name
