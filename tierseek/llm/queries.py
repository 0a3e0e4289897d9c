"""The operators' queries: each runs over its whole table. ORACLES holds DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierseek.llm import chat, jaccard, langid, licences, mixing, packing, pii, quality, substrings, topk


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_read(spark, sf_dir, "documents"), words=3, similarity=(90, 100))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=20)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), max_len=1024, end_id=2)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_digest(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(_read(spark, sf_dir, "documents"), window=50)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_digest(_read(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_read(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_read(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_exact_topk, op3_best_fit_packing, op4_licence_scan, op5_quality_rules,
        op6_substring_dedup, op7_language_id, op8_chat_formatting, op9_pii, op10_mix_sources,
    )
}

ORACLES = {
    "op2_exact_topk": topk.SQL,
    "op4_licence_scan": licences.licence_sql(),
    "op5_quality_rules": quality.sql(),
    "op8_chat_formatting": chat.RENDER_SQL,
}
