"""Stages of the corpus pipeline: one thin function for each operator.

All but the last return the columns of ``documents`` they were given. Rows with
equal ``doc_id`` are one document to the stages that work by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkup.llm.common import read_table


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the learned rules."""
    from checkup.llm.quality_rules import fit_rules, with_quality

    rules = fit_rules(docs, read_table(spark, sf_dir, "labels"))
    out = "__quality"
    return with_quality(docs, rules, out=out).where(f"{out}.kept").select(*docs.columns)


def _recounted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``n_chars`` (where there is one) as the length of the changed text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = before.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                           .otherwise(F.char_length("text").cast(kind)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand (nearly) alike in an earlier place."""
    from checkup.llm.line_dedup import MIN_EXACT, without_repeats

    return _recounted(without_repeats(docs, min_exact=MIN_EXACT), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    from checkup.llm.jaccard_join import one_of_each

    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    from checkup.llm.secrets import with_redacted

    out = with_redacted(docs, out="__secrets")
    return _recounted(out, docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, packed into sequences."""
    from checkup.llm.packing import pack_documents

    return pack_documents(docs, _vocab("word_bpe_49k.json"))
