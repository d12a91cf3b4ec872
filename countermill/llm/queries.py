"""The queries over the corpus tables, one per operator, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countermill.llm import (
    bloom_lm,
    conversation_repair,
    conversation_sql,
    decontaminate,
    fill_middle,
    html_crf,
    minmax_dedup,
    mixing,
    rule_ledger,
    skip_join,
    suffix_levels,
    toxicity,
    wavelet,
    weak_quality,
)
from countermill.llm.common import read_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.scored(read_documents(spark, sf_dir))


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.removed_repeats(read_documents(spark, sf_dir))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(read_documents(spark, sf_dir))


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir))


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(read_documents(spark, sf_dir))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.judged(rule_ledger.ledger(read_documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept"
    )


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(read_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_join.joined(read_documents(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_crf,
        op2_simhash_decontamination,
        op3_weak_quality,
        op4_suffix_levels,
        op5_bloom_lm,
        op6_water_filling,
        op7_ftrl_toxicity,
        op8_minmax_dedup,
        op9_rule_ledger,
        op10_wavelet_tokens,
        op11_conversation_repair,
        op12_skip_join,
        op13_fill_middle,
    )
}

SQL = {
    "op6_water_filling": mixing.SQL,
    "op9_rule_ledger": rule_ledger.SQL,
    "op11_conversation_repair": conversation_sql.SQL,
    "op12_skip_join": skip_join.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
