"""The corpus pipeline: STAGES applied to ``documents`` one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checkup.llm import stages
from checkup.session import new_work_path

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("secret_scans", stages.secret_scans),
    ("best_fit_packing", stages.best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written as Parquet and
    read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: None: learned rules and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None
