"""Regression watch -- each arriving run is diffed with the last stored run
of its query, then becomes the last stored run.

A file source of plan runs (parquet, ``run_id`` increasing in arrival order)
feeds ``foreachBatch``. Per micro-batch N:

1. summarise each document once (node count, root cost, execution time);
2. union with the latest runs of the batch's queries, read from the buckets of
   those queries only (``keyed_state``); only batch 0 may start without state;
3. pair runs with their previous run and compute verdicts (same code as the
   batch diff), keeping the batch's own runs;
4. overwrite partition ``batch_id=N`` of the output, then write the touched buckets
   and commit them with one rename.

What a batch reads and writes follows its own queries, not the number of known
ones. A replayed batch (after a driver or executor loss) starts from the state
before it, gives the same rows, and nothing doubles. There is no
watermark: arrival order decides what "previous" means.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkup.operators import diff as D
from checkup.operators.history import latest_runs
from checkup.session import new_work_path
from checkup.streaming.keyed_state import KeyedState

_STATE_COLS = ["run_id", "query_hash", "git_ref", "node_count", "root_cost", "execution_time_ms"]
_STATE_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("query_hash", T.StringType()),
    T.StructField("git_ref", T.StringType()), T.StructField("node_count", T.LongType()),
    T.StructField("root_cost", T.DoubleType()), T.StructField("execution_time_ms", T.DoubleType()),
])


def _overwrite_partition(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace only partition ``batch_id=<id>`` of ``path`` (write option, so
    the session's settings are untouched)."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


@dataclass
class RegressionWatch:
    """Paths of one watch: ``source`` (incoming runs), ``output`` (diffs),
    ``state`` (latest run per query), ``checkpoint`` (stream progress)."""

    source: str
    output: str
    state: str
    checkpoint: str

    def known(self, spark: SparkSession) -> KeyedState:
        """The stored latest run of each query."""
        return KeyedState(spark, self.state, _STATE_SCHEMA, "query_hash", "run_id")

    def _prior(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Everything known before a batch (for reports; a batch reads its own buckets only)."""
        return self.known(spark).rows(batch_id - 1)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        # Each document is parsed once; the summaries feed both writes.
        summ = D.run_summaries(batch).select(*_STATE_COLS).persist()
        try:
            known = self.known(batch.sparkSession)
            prior = known.prior(batch_id, summ)
            diffs = D.diff_runs(None, summaries=prior.unionByName(summ))
            fresh = diffs.join(prior.select("run_id"), "run_id", "left_anti")
            _overwrite_partition(fresh, self.output, batch_id)
            known.advance(batch_id, latest_runs(summ).select(*_STATE_COLS))
        finally:
            summ.unpersist()

    def start(self, spark: SparkSession, schema: T.StructType, *, available_now: bool = True,
              max_files_per_trigger: int | None = None):
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        stream = reader.parquet(self.source)
        writer = (stream.writeStream.foreachBatch(self.process_batch)
                  .option("checkpointLocation", self.checkpoint))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        return writer.start()

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.output)


def replay_as_stream(spark: SparkSession, runs: DataFrame, arrivals: int = 3) -> DataFrame:
    """Feed ``runs`` to a regression watch in ``arrivals`` run_id ranges, one
    stream run per arrival, and return the watch's diffs (without batch_id).
    The result equals the batch ``diff_runs`` over the same runs."""
    base = new_work_path(spark, "watch")
    watch = RegressionWatch(f"{base}/source/*", f"{base}/diffs", f"{base}/state", f"{base}/checkpoint")
    # Stage the runs once; each arrival is then a cheap cut of the staged copy.
    runs.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/staged")
    runs = spark.read.parquet(f"{base}/staged")
    bounds = runs.agg(F.min("run_id").alias("lo"), F.max("run_id").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        return D.diff_runs(runs).limit(0)
    step = (hi - lo) // arrivals + 1
    schema = runs.schema
    for i in range(arrivals):
        part = runs.where((F.col("run_id") >= lo + i * step) & (F.col("run_id") < lo + (i + 1) * step))
        part.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/source/arrival_{i:05d}")
        q = watch.start(spark, schema, available_now=True)
        q.awaitTermination()
    return watch.results(spark).drop("batch_id")
