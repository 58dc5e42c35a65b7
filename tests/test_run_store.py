"""Gapless ids, commits that refuse a second writer, and plan files that arrive over time."""

import os

import pytest
from pyspark.sql import functions as F

from checkup.operators.run_store import BatchConflict, RunStore, with_gapless_ids
from checkup.plans.flatten import flatten_plans
from checkup.sources import read_plan_files
from checkup.streaming.plan_files import PlanFileStream
from tests import plan_docs as P


def test_ids_have_no_gaps_and_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("at"), (F.col("id") % 3).alias("tie"), "id")
    want = [r.id for r in df.orderBy("at").collect()]
    for parts in (1, 5, 40):
        got = with_gapless_ids(df.repartition(parts), ["at"], 11).orderBy("run_id").collect()
        assert [r.run_id for r in got] == list(range(11, 1011)) and [r.id for r in got] == want
    same = [[(r.run_id, r.id) for r in with_gapless_ids(df.repartition(n), ["tie"]).orderBy("run_id").collect()] for n in (2, 9)]
    assert same[0] == same[1]  # ties too
    assert with_gapless_ids(df.limit(0), ["at"]).collect() == []


def test_replay_and_second_writer(spark, workdir):
    store = RunStore(spark, f"{workdir}/store")
    a = spark.createDataFrame([(3, "x"), (1, "y"), (2, None)], "recorded_at int, plan_json string")
    b = spark.createDataFrame([(9, "z")], a.schema)
    first = sorted(map(tuple, store.record(a, 0).collect()))
    assert first == [(1, 1, "y"), (2, 2, None), (3, 3, "x")]
    assert sorted(map(tuple, store.record(a.repartition(3), 0).collect())) == first  # again: the same ids, nothing doubles
    with pytest.raises(BatchConflict, match="other rows"):
        store.record(b, 0)
    with pytest.raises(BatchConflict, match="not committed"):
        store.record(b, 2)
    assert [r.run_id for r in store.record(b, 1).collect()] == [4]
    open(f"{workdir}/store/commits/2.claim", "w").close()  # another writer is at work, or died
    with pytest.raises(BatchConflict, match="another writer"):
        store.record(b, 2)
    assert store.runs().count() == 4 and len(os.listdir(f"{workdir}/store/data")) == 2
    assert [r.run_id for r in store.record(b, 2, take_over=True).collect()] == [5]
    assert store.record(b.limit(0), 3).count() == 0 and store.next_id(4) == 6


def test_files_that_arrive_equal_the_batch_run(spark, workdir):
    docs = {"a": P.SLOW, "b": '{"cut', "c": P.FAST, "d": '[{"Planning Time": 1}]', "e": P.BIG_SCAN, "f": " ", "g": P.SLOW}
    src = f"{workdir}/src"
    os.makedirs(src)
    stream = PlanFileStream(src, f"{workdir}/store", f"{workdir}/quarantine", f"{workdir}/checkpoint")
    for names in ("ab", "c", "", "defg"):
        for n in names:
            with open(f"{src}/{n}.json", "w") as f:
                f.write(docs[n])
        stream.start(spark).awaitTermination()
    cols = ["file", "node_ord", "node_type", "relation", "estimated_rows", "actual_rows"]
    name = F.regexp_extract("source", "([a-z]).json", 1).alias("file")

    def nodes(runs):
        flat = flatten_plans(runs.select("run_id", "plan_json")).join(runs.select("run_id", name), "run_id")
        return sorted(map(tuple, flat.select(*cols).collect()), key=str)

    batch = read_plan_files(spark, src)
    assert sorted(r.run_id for r in batch.collect()) == list(range(7))
    assert nodes(stream.runs(spark)) == nodes(batch) and len(nodes(batch)) > 4
    assert [r.run_id for r in stream.runs(spark).orderBy("run_id").collect()] == [1, 2, 3, 4]
    found = {r.location.identifier[-6]: r.evidence for r in stream.findings(spark).collect()}
    assert set(found) == {"b", "d", "f"} and "not_json" in found["b"] and "no_plan" in found["d"]
    # a batch that is processed again adds nothing
    again = spark.createDataFrame([(f"{src}/{n}.json", docs[n]) for n in "defg"], "source string, plan_json string")
    last = max(int(f.split(".")[0]) for f in os.listdir(f"{workdir}/store/commits") if f.endswith(".json"))
    before = sorted(map(tuple, stream.runs(spark).select("run_id", "plan_json").collect()))
    files = stream.runs(spark).where("run_id > 2").select("source").collect()
    again = again.withColumn("source", F.concat(F.lit(files[0].source.rsplit("/", 1)[0] + "/"), F.element_at(F.split("source", "/"), -1)))
    stream.process_batch(again, last)
    assert sorted(map(tuple, stream.runs(spark).select("run_id", "plan_json").collect())) == before
    assert stream.findings(spark).count() == 3


def test_stream_over_many_small_files_keeps_little_on_the_driver(spark, workdir, monkeypatch):
    import gc
    import weakref

    from checkup.streaming import plan_files

    src, kept, tasks = f"{workdir}/src", [], []
    parse, process = plan_files.parse_plan_documents, PlanFileStream.process_batch
    monkeypatch.setattr(plan_files, "parse_plan_documents", lambda b: (out := parse(b), kept.append(weakref.ref(out)))[0])
    monkeypatch.setattr(PlanFileStream, "process_batch", lambda self, batch, n: (
        tasks.append(batch.rdd.getNumPartitions()), process(self, batch, n))[1])
    stream = PlanFileStream(src, f"{workdir}/store", f"{workdir}/quarantine", f"{workdir}/checkpoint")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    gc.disable()  # what the stream does not collect itself stays
    try:
        for arrival in range(2):
            os.makedirs(f"{src}/{arrival}")
            for i in range(300):
                with open(f"{src}/{arrival}/{i:03d}.json", "w") as f:
                    f.write(P.FAST if i % 3 else '{"cut')
            stream.start(spark).awaitTermination()
        query = stream.start(spark)  # nothing has arrived, but what the arrivals left is gone
        query.awaitTermination()
    finally:
        gc.enable()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(tasks) == 2 and max(tasks) <= 2 * spark.sparkContext.defaultParallelism
    assert [r() for r in kept] == [None, None]
    assert [r.run_id for r in stream.runs(spark).orderBy("run_id").collect()] == list(range(1, 401))
    assert stream.findings(spark).count() == 200
