"""Tables to check, held as ``dict[name, DataFrame]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load_tables(spark: SparkSession, base_dir: str, names=None) -> dict[str, DataFrame]:
    """Read ``{base_dir}/{name}.parquet`` for each name (lazy; nothing is scanned)."""
    names = list(names) if names is not None else TEST_TABLES
    return {n: spark.read.parquet(f"{base_dir.rstrip('/')}/{n}.parquet") for n in names}
