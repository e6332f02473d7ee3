"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, mix, paragraphs, quality, shard, suffixes, suffixtree, toxicity, urlrank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "class_id", "group_id", "n_links", "n_class_links")


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = shard.keyed(docs).select("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "_size", "_key")
    placed = shard.placed(rows, 8)
    return placed.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *quality.COUNTS, "base_failed", "kept", "p_low")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_link_trust": op1_link_trust, "op5_sparse_suffixes": op5_sparse_suffixes, "op6_ordinal_toxicity": op6_ordinal_toxicity, "op2_paragraph_minhash": op2_paragraph_minhash, "op3_pivotal_mix": op3_pivotal_mix, "op4_qgram_decontamination": op4_qgram_decontamination, "op7_jaccard_forest": op7_jaccard_forest, "op8_histogram_shards": op8_histogram_shards, "op9_quality_trees": op9_quality_trees, "op10_suffix_tree": op10_suffix_tree}


def oracle_sql() -> dict[str, str]:
    return {}
