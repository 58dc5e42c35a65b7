"""Plan documents, one JSON document per file or one per table row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.operators.run_store import with_gapless_ids
from checkup.session import materialize


def read_plan_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file under ``path`` is one EXPLAIN (FORMAT JSON) document.

    Returns ``run_id``, ``source`` (the file) and ``plan_json``. The files are read once
    and kept as one table; ids follow the file names, from 0, without gaps (a sort by name, then a count per
    sorted partition), so no task sees all files.
    Unparsable files stay in the table; ``split_plan_documents`` sorts them out. A
    file of no bytes at all is no row, here and in the stream.
    """
    files = materialize(spark.read.option("wholetext", "true").text(path)
                        .select(F.input_file_name().alias("source"), F.col("value").alias("plan_json")), "plan-files")
    return with_gapless_ids(files, ["source"], first_id=0)


def stream_plan_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream: ``source`` and ``plan_json`` of each file that arrives."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", "true") \
        .option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("plan_json"))
