"""S2 as a stream: plan files that arrive over time go into the run store, broken
ones into quarantine.

Per micro-batch N the files are parsed once. Documents with a plan are trimmed (K5) and
recorded as batch N of a ``RunStore`` under gapless ids, in the order of their file
names; each file that cannot be read is one finding in ``quarantine/batch_id=N``.
Both writes give the same result when a batch is run again, so a lost driver or
executor neither loses nor doubles a file.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.operators.findings import WARN, finding_columns
from checkup.operators.run_store import RunStore
from checkup.plans.flatten import REASONS, parse_plan_documents, trim_plan_documents
from checkup.sources.plan_docs import stream_plan_files


def file_findings(bad: DataFrame) -> DataFrame:
    """One WARN finding for each file (``source``, ``reason``) that cannot be read."""
    text = F.col("reason")
    for k, v in REASONS.items():
        text = F.when(F.col("reason") == k, F.lit(v)).otherwise(text)
    return bad.select(*finding_columns(
        rule_id="plan.file", rule_rank=0, severity=WARN,
        title=F.format_string("Plan file %s cannot be read", F.element_at(F.split("source", "/"), -1)), detail=text,
        location_kind="file", location_identifier=F.col("source"), evidence=F.to_json(F.struct("reason"))))


# What the driver holds and runs for a stream over very many small files, by setting.
_SMALL_FILES = {
    # the driver need not remember where a small file lies, nor keep what it listed for later reads: each file is read once
    "spark.sql.sources.ignoreDataLocality": "true",
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    # hundreds of small files a task, not four; large ones are still dealt out by size
    "spark.sql.files.openCostInBytes": "64k",
}


def listing_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that lists folders in a few tasks a core. Spark's default
    is a task a folder, up to 10,000, for every listing, and a stream over small files lists twice a batch.
    It also holds less for each file (``_SMALL_FILES``)."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    for k, v in _SMALL_FILES.items():
        own.conf.set(k, v)
    return own


@dataclass
class PlanFileStream:
    """Paths of one stream: ``source`` (arriving files), ``store`` (recorded runs),
    ``quarantine`` (findings), ``checkpoint`` (stream progress)."""

    source: str
    store: str
    quarantine: str
    checkpoint: str

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        gc.collect()  # the DataFrames of the batch before, which keep its files listed on the driver
        spark = batch.sparkSession
        known = parse_plan_documents(batch).select("source", "plan_json", F.col("parse_status").alias("reason")).persist()
        try:
            good = known.where("reason = 'ok'").select("source", "plan_json")
            # a writer that died here is this stream's own earlier attempt
            RunStore(spark, self.store).record(trim_plan_documents(good), batch_id, ["source"], take_over=True)
            (file_findings(known.where("reason <> 'ok'")).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.quarantine))
        finally:
            known.unpersist()

    def start(self, spark: SparkSession, *, available_now: bool = True, max_files_per_trigger: int | None = None):
        gc.collect()
        writer = (stream_plan_files(listing_session(spark), self.source, max_files_per_trigger).writeStream.foreachBatch(self.process_batch)
                  .option("checkpointLocation", self.checkpoint))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        return writer.start()

    def runs(self, spark: SparkSession) -> DataFrame | None:
        return RunStore(spark, self.store).runs()

    def findings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.quarantine)
