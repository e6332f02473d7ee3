"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import decontaminate, jaccard, mix, quality, shard, store
from brightloom.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go; null and blank texts are among them; repeated rows go or stay together."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id (a null id last); texts without words all stay."""
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; without a benchmark all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; documents without words are not taken, a null source is one of its own."""
    return mix.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, shard (0 to 7) and slot; columns of these names are replaced."""
    return shard.sharded(docs, 8)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: The stages learn from data and draw at random; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again. Only the last one's table stays (in `store.tables`, for
    `store.cleanup`): a stage's input and what its operators wrote are deleted once its own table is there.

    An empty table gives an empty result, null and blank texts fail the quality rules, and extra columns are kept but for
    those that `shards` adds."""
    docs = table(spark, sf_dir, "documents")
    base, last = f"{store.shared_dir(spark).rstrip('/')}/brightloom-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        before, path = len(store.tables), f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        store.cleanup(spark, before)
        if last:
            store.delete(spark, last)
        store.tables.append(path)
        store.freed(spark)
        last = path
    return docs
