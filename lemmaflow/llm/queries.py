"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language_model, packing, quality, sharding, substring, template, toxicity, warc
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search: every benchmark item against all documents; only leaks are returned."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), may_learn=toxicity.crc_remainder("doc_id", 3) != 1)
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.coalesce(toxicity.crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.repeated_removed(table(spark, sf_dir, "documents").select("doc_id", "text"), width=35, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extracted(table(spark, sf_dir, "pages"))


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.crc_remainder("doc_id", 7) == 2
    return language_model.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, held)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest, payload=False).drop("target_uri")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", "n_failed_rules")


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_decontamination": op2_decontamination,
        "op3_stratified_sharding": op3_stratified_sharding,
        "op4_toxicity": op4_toxicity,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_template_extraction": op7_template_extraction,
        "op8_attention_scores": op8_attention_scores,
        "op9_warc_round_trip": op9_warc_round_trip,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
