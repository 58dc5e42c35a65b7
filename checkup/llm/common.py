"""Helpers shared by the operators: shipping code, work tables, components."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.session import materialize

BITMAP = 1 << 23  # bits of the semi-join filter (1 MB)
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per Spark context, so
    that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_checkup_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="checkup-code-"), "checkup_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "checkup")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._checkup_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back. The shuffle files
    that led to it are of no more use; Spark deletes them when the driver collects
    its garbage, so that is done here. Otherwise the shuffles of all steps of a
    long job lie on the executors' disks until its end."""
    out = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; Spark removes the
    shuffle files of the job when it has ended, as the table stands in for them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def text_batches(batches, max_bytes: int = 4 << 20):
    """Arrow batches cut into slices of about ``max_bytes`` of data (one row at
    least), so that a worker's Python objects stay bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(max_bytes * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (columns ``a``, ``b``: long ids) as
    rows (``id``, ``component``), the component being its smallest id.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): each
    round is two aggregations for the smallest neighbour (combined on the map
    side) and two joins. Every round is written to the shared folder, which
    cuts the lineage. No neighbour list is ever collected. Ends when a round
    changes nothing; a graph that has not settled after ``max_rounds`` raises.
    """
    spark = edges.sparkSession
    cur = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            return spark.createDataFrame([], "id long, component long")
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour goes to the smallest one around
        large = (both.where("b > a").join(low, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours and the node itself go to the smallest
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low2.select("a", F.col("m").alias("b"))).distinct())
        cur = stored(small, name)
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free hash sums of an edge table: equal marks mean
    that a round changed nothing."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                  F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(r)


def _with_bit(df: DataFrame, ids: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with a flag: whether ``col`` may be among ``ids`` (same name). The
    bitmap has a fixed size (``BITMAP`` bits in words of 64, whatever the input)
    and is broadcast."""
    h = F.pmod(F.xxhash64(F.col(col)), F.lit(BITMAP))
    word, bit = F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")
    words = (ids.select(word.alias("__word"), bit.alias("__bit"))
             .groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits")))
    return (df.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
            .withColumn(out, F.coalesce(F.getbit("__bits", bit) == 1, F.lit(False)))
            .drop("__word", "__bits"))


def bitmap_filter(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be among ``ids``, so that an exact join
    after it shuffles fewer rows."""
    return _with_bit(df, ids, col, "__maybe").where("__maybe").drop("__maybe")


def bitmap_split(df: DataFrame, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose ``col`` may be among ``ids``, and rows
    whose ``col`` is surely not, which need no join and no shuffle."""
    flagged = _with_bit(df, ids, col, "__maybe")
    return flagged.where("__maybe").drop("__maybe"), flagged.where("NOT __maybe").drop("__maybe")
