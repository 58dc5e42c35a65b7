"""Operator 4: token counts through a digest cache.

The cache is a Parquet table (``version``, ``digest``, ``n_tokens``). ``digest``
is the SHA-256 of the normalised content, ``version`` the SHA-256 of the
tokenizer file and the library's version. Documents are reduced to distinct
digests (combined before the shuffle, so a group of copies travels once per
map task), digests that the cache holds are left out, only the distinct misses
are encoded, and their counts are appended. Counts then join back by digest.

Normalised content is the text itself with null as empty: any further
normalisation would change what the tokenizer counts.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows
each get a row; an empty table gives an empty result; a null ``doc_id`` stays
null; other columns are ignored, whatever their names. A digest appended twice
by two writers counts once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.llm.chunk_tokenizer import memo_encoder
from checkup.llm.common import ship, text_batches

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def _digest(text: str = "text"):
    return F.unhex(F.sha2(text, 256))


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import tokenizers

    h = hashlib.sha256(f"tokenizers {tokenizers.__version__}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version: one row per digest."""
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
            .where(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(misses: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens), encoded by the library."""

    def run(batches):
        count = memo_encoder(tokenizer_path, "byte", "count")
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())],
                names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, digest`` for each row of
    ``docs``; appends the counts of unseen texts to the cache first."""
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    keyed = base.select(_digest().alias("digest"), "text")
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    # makes sure that the cache table exists
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path, version)
    misses = distinct.join(known, "digest", "left_anti")
    (encode_misses(misses, tokenizer_path)
     .select(F.lit(version).alias("version"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))
    # small rows; a digest with many documents is a skewed join that AQE splits
    rows = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _digest().alias("digest"))
    return (rows.join(read_cache(spark, cache_path, version), "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit"), "digest"))
