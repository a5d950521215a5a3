"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, conversation_repair, decontamination, embedding_dedup, fm_dedup, license_scan, line_dedup, mixing, ngram_join, quality, secret_scan, sql, suffix_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": lambda s, d: suffix_dedup.digest(_read(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxicity.digest(_read(s, d, "documents"), _read(s, d, "labels")),
        "op3_embedding_dedup": lambda s, d: embedding_dedup.digest(_read(s, d, "embeddings")),
        "op4_fm_dedup": lambda s, d: fm_dedup.digest(_read(s, d, "documents")),
        "op5_license_scan": lambda s, d: license_scan.digest(_read(s, d, "documents")),
        "op6_line_dedup": lambda s, d: line_dedup.digest(_read(s, d, "documents")),
        "op7_quality": lambda s, d: quality.digest(_read(s, d, "documents"), _read(s, d, "labels")),
        "op8_ngram_join": lambda s, d: ngram_join.digest(_read(s, d, "documents")),
        "op9_decontamination": lambda s, d: decontamination.digest(_read(s, d, "documents"), _read(s, d, "benchmark")),
        "op10_mixing": lambda s, d: mixing.digest(_read(s, d, "documents")),
        "op11_alignment": lambda s, d: alignment.digest(_read(s, d, "documents")),
        "op12_conversation_repair": lambda s, d: conversation_repair.digest(_read(s, d, "conversations")),
        "op13_secret_scan": lambda s, d: secret_scan.digest(_read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": sql.EMBEDDING_DEDUP,
        "op4_fm_dedup": sql.FM_DEDUP,
        "op5_license_scan": license_scan.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
        "op8_ngram_join": sql.NGRAM_JOIN,
        "op13_secret_scan": secret_scan.ORACLE_SQL,
    }
