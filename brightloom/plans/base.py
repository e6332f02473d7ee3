"""Registry of queries: a Spark function and, where SQL can express it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import experiments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """Text functions are bound by the CPU: a table of fewer splits than cores is dealt over all of them first."""
        rows = self.spark.read.parquet(f"{self.folder}/documents.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores, "doc_id") if rows.rdd.getNumPartitions() < cores else rows

    def utterances(self) -> DataFrame:
        """Documents in the shape of an utterance manifest: a duration and a split derived from the id, a tier from the labels."""
        d, labels = self.documents, self.labels.select("doc_id", "quality", "toxic")
        c = F.col
        return d.join(labels, "doc_id", "left").select(
            "doc_id", F.concat(F.lit("doc/"), c("doc_id")).alias("audio_path"), c("source").alias("dataset_id"), F.concat_ws("/", "lang", "source").alias("speaker_id"),
            ((c("doc_id") * 7919 % 400 + 1) / 10.0).cast("double").alias("duration"), "text", F.when(c("doc_id") % 10 == 0, "test").when(c("doc_id") % 10 == 1, "val").otherwise("train").alias("split"),
            F.when(c("quality") == 1, "gold").when(c("quality") == 0, "silver").otherwise("bronze").alias("tier"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
        )

    def waves(self) -> DataFrame:
        """Embeddings as waveforms of different loudness."""
        gain = F.pow(F.lit(10.0), -(F.col("vec_id") % 6))
        return self.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: (v.cast("double") * gain).cast("float")).alias("wave"))

    def averages(self, **metrics: Column) -> DataFrame:
        """Aggregates of each run's wer, cer and loss, summed in the order of the table's files and their rows, as SQL on one thread does."""
        c = F.col
        rows = self.lineitem.select(c("l_orderkey").alias("run"), c("l_discount").alias("wer"), c("l_tax").alias("cer"), (c("l_quantity") / 10).alias("loss"), c("_metadata.file_path").alias("_file"), c("_metadata.row_index").alias("_row"))
        return experiments.means(rows, "run", ["_file", "_row"], **metrics)

    def curve(self) -> DataFrame:
        """Line items as metric curves: an order is a run, its lines in order are the steps."""
        c = F.col
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        return self.lineitem.select(c("l_orderkey").alias("run"), F.row_number().over(order).alias("step"), c("l_discount").alias("wer"), c("l_tax").alias("cer"), (c("l_quantity") / 10).alias("loss"))


UTTERANCES = """u AS (SELECT d.doc_id, concat('doc/', d.doc_id) AS audio_path, d.source AS dataset_id, concat(d.lang, '/', d.source) AS speaker_id,
  CAST((d.doc_id * 7919 % 400 + 1) / 10.0 AS DOUBLE) AS duration, d.text, CASE d.doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
  CASE l.quality WHEN 1 THEN 'gold' WHEN 0 THEN 'silver' ELSE 'bronze' END AS tier, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
WAVES = "w AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(CAST(v AS DOUBLE) * pow(10.0, -(vec_id % 6)) AS FLOAT)) AS wave FROM embeddings)"
CURVE = "c AS (SELECT l_orderkey AS run, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS INTEGER) AS step, l_discount AS wer, l_tax AS cer, l_quantity / 10 AS loss FROM lineitem)"


def query(sql: str | None = None, name: str | None = None):
    """Registers fn(tables) under its name, and the SQL beside it."""

    def add(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
