import duckdb

from checkup.llm.queries import ORACLE_SQL, QUERIES
from tools.check_oracle import digest

SMOKE = "/root/testdata/sf0.001"


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SMOKE)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(cols), name
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, cur.fetchall())[0], name
