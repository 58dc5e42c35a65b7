from checkup.operators import diff as D
from checkup.streaming import replay_as_stream
from tests import plan_docs as P


def test_stream_equals_batch(spark):
    docs = [P.SLOW, P.FAST, P.BIG_SCAN, P.SLOW]
    rows = [(i, f"q{i % 3}", f"r{i}", docs[i % 4]) for i in range(1, 31)]
    runs = spark.createDataFrame(rows, "run_id long, query_hash string, git_ref string, plan_json string")
    batch = sorted(map(tuple, D.diff_runs(runs).collect()))
    streamed = replay_as_stream(spark, runs, arrivals=3)
    assert sorted(map(tuple, streamed.select(*D.diff_runs(runs).columns).collect())) == batch
