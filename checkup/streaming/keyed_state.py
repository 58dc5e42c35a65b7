"""One row per key, kept in files between batches; a batch reads and writes only
the buckets of its own keys.

Keys are dealt by hash into buckets of about ``BUCKET_ROWS`` rows. The number of
buckets grows with the stored rows by linear hashing: a new bucket takes rows out
of one old bucket only, so no batch ever deals all rows anew. A batch therefore
reads and writes the buckets of its keys and as many split ones as its new keys call
for, whatever else is stored; the pointer it writes has one short entry per bucket.

``versions/batch_id=N/bucket=B`` holds the rows that batch N wrote. The pointer file
of batch N (``pointers/N.json``: number of buckets, rows, and for each bucket the batch
that wrote it last) is written aside and renamed, which is the commit: a batch that dies before has
changed nothing. Batch N starts from pointer N - 1, so running it again writes the
same rows and the same pointer. Only batch 0 may start without one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_ROWS = 2048


def bucket_address(key: Column, buckets: int) -> Column:
    """Linear hashing: the bucket of a key among ``buckets``."""
    level = 1 << (buckets.bit_length() - 1)
    a = F.pmod(F.xxhash64(key), F.lit(2 * level))
    return F.when(a >= buckets, a - F.lit(level)).otherwise(a)


def split_source(bucket: int, buckets: int) -> int:
    """Which of the first ``buckets`` buckets holds the rows of a later one."""
    while bucket >= buckets:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


class KeyedState:
    """The rows with the largest ``order`` of each ``key``, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str,
                 bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.bucket_rows = bucket_rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def pointer(self, batch_id: int) -> dict:
        """State after batch ``batch_id``; -1 is the empty state. A missing one is an
        error: going on without it would make every key a new one."""
        if batch_id < 0:
            return {"buckets": 1, "rows": 0, "versions": {}}
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/pointers/{batch_id}.json").first()[0]
        return json.loads(text)

    def _commit(self, batch_id: int, pointer: dict) -> None:
        fs, aside = self._fs(f"{self.path}/pointers/.{batch_id}.writing")
        _, final = self._fs(f"{self.path}/pointers/{batch_id}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        out.close()
        fs.delete(final, False)  # of an earlier run of the same batch
        if not fs.rename(aside, final):
            raise OSError(f"could not commit {final}")

    def _rows(self, pointer: dict, buckets) -> DataFrame:
        paths = [f"{self.path}/versions/batch_id={pointer['versions'][str(b)]}/bucket={b}"
                 for b in sorted(buckets) if str(b) in pointer["versions"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        """Buckets of the rows' keys (at most as many numbers as there are buckets)."""
        found = rows.select(bucket_address(F.col(self.key), buckets).alias("b")).distinct().collect()
        return {r["b"] for r in found}

    def prior(self, batch_id: int, rows: DataFrame) -> DataFrame:
        """What is stored for the keys of ``rows`` before batch ``batch_id``."""
        before = self.pointer(batch_id - 1)
        stored = self._rows(before, self._touched(rows, before["buckets"]))
        keys = rows.select(F.col(self.key).alias("__key")).distinct()
        return stored.join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")

    def advance(self, batch_id: int, rows: DataFrame) -> dict:
        """Take in the rows of batch ``batch_id`` and commit. Returns the new pointer."""
        before = self.pointer(batch_id - 1)
        old = before["buckets"]
        touched = self._touched(rows, old)
        stored = self._rows(before, touched)
        cols = [f.name for f in self.schema.fields]
        last = F.max_by(F.struct(*cols), F.col(self.order)).alias("r")
        new_keys = rows.select(self.key).distinct().join(
            stored.select(F.col(self.key).alias("__key")), F.col(self.key).eqNullSafe(F.col("__key")), "left_anti").count()
        total = before["rows"] + new_keys
        buckets = max(old, -(-total // self.bucket_rows))
        sources = {split_source(b, old) for b in range(old, buckets)}
        affected = touched | sources
        merged = (self._rows(before, affected).select(*cols).unionByName(rows.select(*cols))
                  .groupBy(F.col(self.key).alias("__key")).agg(last).select("r.*")
                  .withColumn("bucket", bucket_address(F.col(self.key), buckets)))
        target = f"{self.path}/versions/batch_id={batch_id}"
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = set()
        if affected:
            written = {r["bucket"] for r in self.spark.read.parquet(target).select("bucket").distinct().collect()}
        versions = {b: v for b, v in before["versions"].items() if int(b) not in affected}
        versions |= {str(b): batch_id for b in written}
        after = {"buckets": buckets, "rows": total, "versions": versions}
        self._commit(batch_id, after)
        return after

    def rows(self, batch_id: int) -> DataFrame:
        """All rows after batch ``batch_id``."""
        pointer = self.pointer(batch_id)
        return self._rows(pointer, map(int, pointer["versions"]))

    def drop_older(self, batch_id: int) -> int:
        """Remove buckets and pointers that neither batch ``batch_id`` nor the one
        before it (which a re-run starts from) uses. Returns how many buckets went."""
        used = {(str(v), b) for n in (batch_id - 1, batch_id) for b, v in self.pointer(n)["versions"].items()}
        gone = 0
        fs, top = self._fs(f"{self.path}/versions")
        for batch in fs.listStatus(top):
            n = batch.getPath().getName().partition("=")[2]
            for bucket in fs.listStatus(batch.getPath()):
                b = bucket.getPath().getName().partition("=")[2]
                if b and int(n) <= batch_id and (n, b) not in used:
                    gone += bool(fs.delete(bucket.getPath(), True))
        fs, top = self._fs(f"{self.path}/pointers")
        for f in fs.listStatus(top):
            name = f.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) < batch_id - 1:
                fs.delete(f.getPath(), False)
        return gone
