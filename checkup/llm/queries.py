"""Queries of the operators and, where SQL can express them, DuckDB SQL."""

from __future__ import annotations

from checkup.llm import jaccard_sql, knn_join, license_scan, source_audit
from checkup.llm.common import read_table
from checkup.session import new_work_path


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark, sf_dir):
    from checkup.llm.jaccard_join import similarity_components

    return similarity_components(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    from checkup.llm.line_dedup import MIN_EXACT, line_rows

    return line_rows(read_table(spark, sf_dir, "documents"), min_exact=MIN_EXACT)


def op3_quality_rules(spark, sf_dir):
    from checkup.llm.quality_rules import quality_rows

    return quality_rows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_counts(spark, sf_dir):
    from checkup.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"),
                        new_work_path(spark, "token-cache"))


def op6_best_fit_packing(spark, sf_dir):
    from checkup.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), _vocab("word_bpe_49k.json"))


def op5_secret_scans(spark, sf_dir):
    from checkup.llm.secrets import secret_rows

    return secret_rows(read_table(spark, sf_dir, "documents"))


def op7_shard_shuffle(spark, sf_dir):
    from checkup.llm.shard_shuffle import shard_rows

    return shard_rows(read_table(spark, sf_dir, "documents"))


def op8_license_scans(spark, sf_dir):
    from checkup.llm.license_scan import license_rows

    return license_rows(read_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark, sf_dir):
    from checkup.llm.knn_join import top_products

    return top_products(read_table(spark, sf_dir, "embeddings"))


def op9_byte_level_bpe(spark, sf_dir):
    from checkup.llm.byte_bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), _vocab("byte_bpe_multi_50k.tiktoken"))


def op11_suffix_array_dedup(spark, sf_dir):
    from checkup.llm.suffix_repeats import repeat_rows

    return repeat_rows(read_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    from checkup.llm.token_alignment import alignment_rows

    return alignment_rows(read_table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"), _vocab("piece_bpe_32k.model"))


def op13_source_audit(spark, sf_dir):
    return source_audit.audit_rows(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scans": op5_secret_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_shard_shuffle": op7_shard_shuffle,
    "op8_license_scans": op8_license_scans,
    "op10_exact_top_k": op10_exact_top_k,
    "op9_byte_level_bpe": op9_byte_level_bpe,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_audit": op13_source_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_sql.ORACLE_SQL,
    "op8_license_scans": license_scan.oracle_sql(),
    "op10_exact_top_k": knn_join.ORACLE_SQL,
    "op13_source_audit": source_audit.ORACLE_SQL,
}
