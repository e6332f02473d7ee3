"""Lookups of one corpus in another: by exact signal, by head and duration, by text and duration, by locked text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCKED = ("val", "validation", "test")
KEYS = {"exact_audio": ["audio_sha1"], "near_audio": ["audio_head_sha1", "duration_bucket"], "text_duration": ["transcript_sha1", "duration_bucket"], "locked": ["transcript_sha1"]}


def index(corpus: DataFrame, family: str, order: str) -> DataFrame:
    """One row for each key of the family, with the split of its last row."""
    rows = corpus.where(F.coalesce(F.col(KEYS[family][0]), F.lit("")) != "")
    if family == "locked":
        rows = rows.where(F.col("split").isin(*LOCKED))
    return rows.groupBy(*KEYS[family]).agg(F.max_by("split", order).alias(f"{family}_split"))


def lookup(df: DataFrame, corpus: DataFrame, order: str) -> DataFrame:
    """Adds overlap_split and overlap_reason of the first family that hits; Catalyst picks each join's strategy by size."""
    for family, keys in KEYS.items():
        df = df.join(index(corpus, family, order), keys, "left")
    reason = {"exact_audio": "exact_audio_overlap_gold", "near_audio": "near_audio_overlap_gold", "text_duration": "text_duration_overlap_gold", "locked": "transcript_overlap_locked_eval"}
    says, split = F.lit("").cast("string"), F.lit("").cast("string")
    for family in reversed(KEYS):
        hit = F.col(f"{family}_split").isNotNull()
        says, split = F.when(hit, reason[family]).otherwise(says), F.when(hit, F.col(f"{family}_split")).otherwise(split)
    return df.withColumns({"overlap_reason": says, "overlap_split": split}).drop(*[f"{f}_split" for f in KEYS])


def without(df: DataFrame, corpus: DataFrame, family: str) -> DataFrame:
    """Rows whose key the corpus has not (nulls have no key)."""
    return df.join(corpus.select(*KEYS[family]).distinct(), KEYS[family], "left_anti")


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def details(master: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Master joined with the last detail row of each key; raises if one has none."""
    columns = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_d"))
    missing = master.join(last, key, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"rows of the master have no details by {key}")
    return master.join(last, key).select(*master.columns, *[F.col(f"_d.{c}") for c in columns if c not in master.columns])


def first_seen(df: DataFrame, order: str) -> DataFrame:
    """duplicate_reason: the first family (signal, head and bucket, text and bucket) of which an earlier row has the key."""
    again = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1
    audio = (F.col("audio_sha1") != "") & again("audio_sha1")
    head = (F.col("audio_head_sha1") != "") & again("audio_head_sha1", "duration_bucket")
    text = again("transcript_sha1", "duration_bucket")
    says = F.when(audio, "exact_audio_duplicate_silver").when(head, "near_audio_duplicate_silver").when(text, "text_duration_duplicate_silver")
    return df.withColumn("duplicate_reason", F.coalesce(says, F.lit("")))
