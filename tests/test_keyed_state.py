"""Keyed state: linear hashing, work that follows the batch, replays, watch equality."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkup.operators import diff as D
from checkup.streaming.keyed_state import KeyedState, bucket_address, split_source
from checkup.streaming.watch import RegressionWatch
from tests import plan_docs as P

SCHEMA = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_split_source_is_where_the_rows_were(spark):
    keys = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("k"))
    for old, new in ((1, 2), (1, 7), (3, 4), (5, 13), (8, 9), (6, 40)):
        moved = keys.select(bucket_address(F.col("k"), old).alias("a"), bucket_address(F.col("k"), new).alias("b")).distinct().collect()
        for r in moved:
            assert r.b == r.a if r.b < old else r.a == split_source(r.b, old), (old, new, r)


def test_batches_equal_a_plain_dictionary_and_replays_change_nothing(spark, workdir):
    rnd = random.Random(2)
    state, want = KeyedState(spark, f"{workdir}/s", SCHEMA, "k", "run_id", bucket_rows=7), {}
    for n in range(4):
        rows = [(n * 100 + i, None if i == 0 else f"q{rnd.randrange(40 * (n + 1))}", float(i)) for i in range(50)] if n != 2 else []
        df = spark.createDataFrame(rows, SCHEMA)
        prior = {r.k: r.run_id for r in state.prior(n, df).collect()}
        assert prior == {k: want[k][0] for k in {r[1] for r in rows} if k in want}
        first = state.advance(n, df)
        assert state.advance(n, df) == first  # the same batch again
        for r in rows:
            want[r[1]] = r
        assert sorted(map(tuple, state.rows(n).collect()), key=str) == sorted(want.values(), key=str)
        assert first["rows"] == len(want) and first["buckets"] == max(1, -(-len(want) // 7))
    state.drop_older(3)
    assert sorted(map(tuple, state.rows(3).collect()), key=str) == sorted(want.values(), key=str)
    assert state.advance(3, df) == first
    with pytest.raises(Exception):
        state.advance(9, df)


def test_a_batch_writes_what_its_keys_need(spark, workdir):
    """Five queries among 2,000 and among 40,000 known ones: about the same bytes."""
    sizes = []
    for known in (2_000, 40_000):
        state = KeyedState(spark, f"{workdir}/{known}", SCHEMA, "k", "run_id", bucket_rows=200)
        state.advance(0, spark.range(known).selectExpr("id AS run_id", "concat('q', id) AS k", "CAST(id AS double) AS v"))
        state.advance(1, spark.range(5).selectExpr("id + 1000000 AS run_id", "concat('q', id * 17) AS k", "1.5D AS v"))
        sizes.append(written(f"{state.path}/versions/batch_id=1"))
        pointer = json.load(open(f"{state.path}/pointers/1.json"))
        assert pointer["buckets"] == known // 200 and sum(v == 1 for v in pointer["versions"].values()) <= 5
    assert sizes[1] < 2 * sizes[0] and sizes[1] < written(f"{state.path}/versions/batch_id=0") / 10


def test_watch_in_many_batches_equals_one_diff(spark, workdir):
    docs = [P.SLOW, P.FAST, P.BIG_SCAN]
    rows = [(i, None if i % 11 == 0 else f"q{i * i % 7}", "r", docs[i % 3]) for i in range(1, 41)]
    runs = spark.createDataFrame(rows, "run_id long, query_hash string, git_ref string, plan_json string")
    watch = RegressionWatch("", f"{workdir}/out", f"{workdir}/state", "")
    for n in range(4):
        part = runs.where((F.col("run_id") > 10 * n) & (F.col("run_id") <= 10 * n + 10))
        watch.process_batch(part, n)
        if n == 2:
            watch.process_batch(part, n)
    want = D.diff_runs(runs)
    assert sorted(map(tuple, watch.results(spark).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
