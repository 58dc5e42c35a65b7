"""Stored plan runs (H2, K4): gapless run ids, and one writer per batch.

Ids are dealt in two passes. The new runs are sorted by their order columns and
written; each sorted partition is then counted, and a run's id is the
first free id, the rows of the partitions before, and its place in its own. Ids
have no gaps, follow the order, and are the same whenever the same batch is
written again, however its rows were partitioned. No task sees all rows; one
count per partition is added up.

A batch is committed by a file that can be created once (``commits/N.claim``), then
described in ``commits/N.json`` (first id, rows, a digest of the contents, the folder).
Rows of a batch that was never committed are not read. Writing a committed batch
again with the same contents changes nothing; other contents, or a second writer, are an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checkup.session import materialize

_PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the place in it below


class BatchConflict(RuntimeError):
    """Another writer holds the batch, or it was committed with other rows."""


def with_gapless_ids(df: DataFrame, order_cols, first_id: int = 1, out_col: str = "run_id") -> DataFrame:
    """``df`` with ids from ``first_id`` on, without gaps, in the order of ``order_cols``
    (ties by a hash of the whole row; equal rows are alike)."""
    others = [F.col(f"`{c}`") for c in df.columns]
    taken = set(df.columns)
    place = next(n for n in ("_place", "_place_of_row", f"_place_{uuid.uuid4().hex}") if n not in taken)
    tie = F.xxhash64(*[c.cast("string") if df.schema[n].dataType.typeName() in ("map", "variant") else c
                       for n, c in zip(df.columns, others)])
    ordered = df.orderBy(*order_cols, tie).withColumn(place, F.monotonically_increasing_id())
    staged = materialize(ordered, "ordered-rows")
    part = F.shiftright(F.col(place), 33)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per sorted partition: their running total in one small task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    out = staged.join(F.broadcast(offsets), part == F.col("_part"))
    return out.select((F.col("_before") + F.col(place).bitwiseAND(F.lit(_PLACE)) + F.lit(int(first_id))).cast("bigint").alias(out_col),
                      *others)


class RunStore:
    """Runs below ``path``, in batches 0, 1, 2, ..."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commit_of(self, batch_id: int) -> dict | None:
        """What is committed as batch ``batch_id``, or None."""
        fs, p = self._fs(f"commits/{batch_id}.json")
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.option("wholetext", "true").text(p.toString()).first()[0])

    def next_id(self, batch_id: int) -> int:
        """The first id of batch ``batch_id``; the batch before it must be committed."""
        if batch_id == 0:
            return 1
        before = self.commit_of(batch_id - 1)
        if before is None:
            raise BatchConflict(f"batch {batch_id - 1} is not committed")
        return before["first_id"] + before["rows"]

    def record(self, runs: DataFrame, batch_id: int, order_cols=("recorded_at",), take_over: bool = False) -> DataFrame:
        """H2: store ``runs`` as one batch and return them with their ids.

        ``take_over`` lets a batch be finished whose writer died between claim and commit."""
        start = self.next_id(batch_id)
        folder = f"data/batch_id={batch_id}-{uuid.uuid4().hex[:12]}"
        with_gapless_ids(runs, order_cols, start).write.parquet(f"{self.path}/{folder}")
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        total, digest = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")).first()
        mine = {"first_id": start, "rows": total, "digest": digest, "folder": folder}
        done = self.commit_of(batch_id)
        if done is None:
            fs, claim = self._fs(f"commits/{batch_id}.claim")
            if not fs.createNewFile(claim) and not take_over:
                self._drop(folder)
                raise BatchConflict(f"batch {batch_id} is being written by another writer")
            _, aside = self._fs(f"commits/.{batch_id}.writing")
            out = fs.create(aside, True)
            out.write(bytearray(json.dumps(mine, sort_keys=True).encode()))
            out.close()
            if not fs.rename(aside, self._fs(f"commits/{batch_id}.json")[1]):
                raise OSError(f"could not commit batch {batch_id}")
            return rows
        self._drop(folder)
        if (done["rows"], done["digest"]) != (total, digest):
            raise BatchConflict(f"batch {batch_id} was committed with other rows")
        return self.spark.read.parquet(f"{self.path}/{done['folder']}")

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(folder)
        fs.delete(p, True)

    def runs(self) -> DataFrame | None:
        """All committed runs, or None before the first batch."""
        folders, n = [], 0
        while (done := self.commit_of(n)) is not None:
            folders.append(f"{self.path}/{done['folder']}")
            n += 1
        return self.spark.read.parquet(*folders) if folders else None
