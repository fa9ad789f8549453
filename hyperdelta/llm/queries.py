"""The training-data queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arc, chat, decontaminate, kneser_ney, packing, pii, quality_rules, simhash, tokenfiles, urlfilter
from .common import table


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.round_trip(table(spark, sf_dir, "pages"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.document_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = chat.PROBE
    probe = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(chat.text_parts(rows.unionByName(probe))))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES[quality_rules.CURRENT])


def op5_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_skip_chain_pii": op5_skip_chain_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_kneser_ney_quality": op7_kneser_ney_quality,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_separator_scan": op9_separator_scan,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": chat.ORACLE,
    "op3_url_filter": urlfilter.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_arc_to_warc": arc.ORACLE,
}
