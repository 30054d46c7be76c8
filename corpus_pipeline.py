"""Five stages from raw documents to packed training sequences.

Each stage gets the whole output of the one before as a Parquet table. Its
decisions take effect: rejected documents go, repeated passages are cut from the
texts, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm import decontaminate, jaccard, packing, quality, store, substring

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The named columns beside all but the text in one struct, so that no name can clash with those that a stage makes."""
    return docs.select(*apart, F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame, text: F.Column) -> DataFrame:
    return df.select(*[text.alias("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those of a bad host go if they fail a rule themselves, so that clean ones stay."""
    judged = quality.quality_rules(_packed(docs, "text", "source"), spare_clean=True)
    return _unpacked(judged.where("kept"), docs, F.col("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one with the least doc_id.

    Rows are told apart by a key of their own, so rows that share a doc_id, or have none, are judged by their texts;
    within one doc_id (nulls last) the text with the least hash stays. Texts without words link with nothing."""
    key = next(name for n in range(len(docs.columns) + 1) if (name := "_key" + "_" * n) not in docs.columns)
    keyed = store.written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = store.written(jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100), "components").withColumnRenamed("doc_id", "_row")
    linked = store.written(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id"), "linked")
    light = keyed.select(F.col(key).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    members = store.written(found.join(linked, "component_id").select("component_id", "_row").join(light, "_row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_hash", "_row"))["_row"].alias("_first"))
    gone = store.written(members.join(first, "component_id").where("_row != _first").select(F.col("_row").alias(key)), "gone")
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated windows of 50 words; those with no words left go."""
    cut = substring.repeated_removed(_packed(docs, "text"), width=50)
    out = _unpacked(cut.where("kept_text != ''"), docs, F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2,048 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
