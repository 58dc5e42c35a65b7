"""Spark session helpers: a configured session and the shared work folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "checkup") -> SparkSession:
    """A session tuned for the checkup jobs (AQE on, UTC, UI off)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("CHECKUP_SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CHECKUP_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set and the master is local (tests, one machine), a private
    folder is made, registered as the checkpoint dir and removed at exit. On a
    cluster a folder that one machine sees would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to storage that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkup-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def new_work_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for one job's tables."""
    return f"{shared_dir(spark)}/checkup-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared folder and read it back.

    Used for intermediates that several branches of a plan read (column
    statistics, per-run plan summaries): they are computed once, and the
    lineage is cut, so a lost executor does not send work back to the
    sources. (A reliable ``checkpoint()`` would compute an unpersisted input
    twice.)"""
    spark = df.sparkSession
    path = new_work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
