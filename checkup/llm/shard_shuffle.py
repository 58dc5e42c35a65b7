"""Operator 7: two-pass external shuffle into shards.

Pass one numbers the records, scatters them over buckets by a seeded hash of
their numbers (one shuffle), brings each bucket into Fisher-Yates order
(``shuffle`` with a seed) and writes it; Spark removes the shuffle's files then.
Numbers are distinct, so buckets fill uniformly whatever ids, sources or copies
the records hold; the number of buckets follows from the input's bytes, so that
one fits in memory. Pass two places each bucket behind the buckets before it.
The places form a random permutation of the records; each shard is a stretch of
places, so records go to their shards as they are read. A bucket's offset is one
number: Spark broadcasts the table of offsets while it is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it. The query's rows
are derived from the written shards. Only Spark SQL functions are used.

The law is ``rows``: shard sizes in records differ by one at most.

Defined results: a null text has no bytes and the checksum of the empty
string; null ids are records like others; repeated rows are records of their
own; an empty table gives an empty result; all columns of the input travel in
one struct, so no name can clash. Pass one's table fixes numbers and order; the
same seed gives the same shards under the same partitioning of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkup.llm.common import step
from checkup.session import new_work_path

SHARDS, SEED = 40, 17
BUCKET_BYTES = 16 << 20
RECORD_BYTES = 16  # counted for each record besides its text
GROUP = 4096  # buckets whose offsets one task adds up


def _size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _offsets(counts: DataFrame) -> DataFrame:
    """``bucket, offset`` from ``bucket, n``: how many records the buckets
    before it hold, added up within groups of buckets and over the groups."""
    group = F.floor(F.col("bucket") / GROUP)
    counts = counts.withColumn("group", group)
    groups = (counts.groupBy("group").agg(F.sum("n").alias("g"))
              .select("group", F.coalesce(F.sum("g").over(W.orderBy("group").rowsBetween(
                  W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    inside = F.sum("n").over(W.partitionBy("group").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    return (counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(groups, "group")
            .select("bucket", (F.col("base") + F.col("inside")).alias("offset")))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
             text_col: str = "text") -> DataFrame:
    """``shard, slot, record``: every record (a struct of the input's columns)
    with its shard and its place there."""
    total = docs.agg(F.sum(_size(F.col(text_col)))).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    # pass one; sorted first, so that the draw does not depend on how rows arrived
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
                         F.monotonically_increasing_id().alias("number"))
    buckets = (tagged.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(n_buckets)))
               .groupBy("bucket").agg(F.collect_list(F.struct("number", "record")).alias("rows")))
    in_order = F.array_sort("rows", lambda a, b: F.when(a["number"] < b["number"], -1).otherwise(1))
    mixed = step(buckets.select("bucket", F.posexplode(F.shuffle(in_order, F.lit(seed))).alias("at", "row"))
                 .select("bucket", "at", "row.record"), "shuffle-buckets")
    # pass two
    counts = step(mixed.groupBy("bucket").agg(F.count("*").alias("n")), "shuffle-counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    placed = mixed.join(step(_offsets(counts), "shuffle-offsets"), "bucket")
    return placed.select(*_stretch(F.col("offset") + F.col("at"), n, shards), "record")


def _stretch(place, n: int, shards: int):
    """Shard and slot of a place: the first ``n mod shards`` shards hold one
    record more than the others."""
    q, longer = n // shards, n % shards
    edge = longer * (q + 1)
    later = place - edge
    shard = F.when(place < edge, F.floor(place / (q + 1))).otherwise(longer + F.floor(later / max(q, 1)))
    slot = F.when(place < edge, place % (q + 1)).otherwise(later % max(q, 1))
    return shard.cast("int").alias("shard"), slot.cast("long").alias("slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, its records with their ``slot``."""
    placed.write.partitionBy("shard").parquet(path)


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of the records
    in the shards, which are written to the shared folder and read back."""
    placed = shuffled(docs, shards, text_col=text_col, **options)
    path = new_work_path(docs.sparkSession, "shards")
    write_shards(placed, path)
    placed = docs.sparkSession.read.schema(placed.schema).parquet(path)
    text = F.col(f"record.`{text_col}`")
    return placed.select(
        F.col(f"record.`{id_col}`").cast("long").alias("doc_id"), _size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
