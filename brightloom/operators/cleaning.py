"""The cleaning cascade: each row has the first reason that fails, and repeats count among survivors only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text


def first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first condition that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(out)
    return out


def cascade(df: DataFrame, order: str, exists: str | None = None, least: float = 1.0, most: float = 30.0, chars: tuple[int, int] = (2, 500)) -> DataFrame:
    """Adds clean_text and reason (null: kept) to rows(audio_path, text, duration)."""
    path, clean, duration = F.trim("audio_path"), text.normalize_legacy(F.col("text")), F.col("duration")
    missing = F.coalesce(path == "", F.lit(True)) | (~F.col(exists) if exists else F.lit(False))
    df = df.withColumns({"audio_path": path, "clean_text": clean})
    n = F.length("clean_text")
    reason = first_reason(
        ("empty_transcript", n == 0), ("transcript_too_short", n < chars[0]), ("transcript_too_long", n > chars[1]), ("missing_audio", missing),
        ("corrupted_audio", ~numeric.finite(duration) | (duration <= 0)), ("duration_too_short", duration < least), ("duration_too_long", duration > most),
    )
    df = df.withColumn("reason", reason)
    again = F.row_number().over(Window.partitionBy("audio_path", "clean_text", F.col("reason").isNull()).orderBy(order)) > 1
    return df.withColumn("reason", F.coalesce("reason", F.when(again, "duplicate_sample")))


def report(cleaned: DataFrame) -> DataFrame:
    """(reason, rows, hours); a null reason is what stays."""
    return cleaned.groupBy("reason").agg(F.count("*").alias("rows"), (F.sum("duration") / 3600).alias("hours"))


def archive_reason(df: DataFrame, most: float = 30.0, tolerance: float = 0.1) -> Column:
    """Why a clip of an archive is not used; needs decoded_duration, declared_duration, transcript, decode_error."""
    d = F.col("decoded_duration")
    return first_reason(
        ("decode_error", F.col("decode_error").isNotNull()), ("empty_audio", d == 0), ("invalid_duration", ~numeric.finite(d) | (d < 0)), ("duration_too_long", d > most),
        ("missing_transcript", F.trim("transcript") == ""), ("duration_mismatch", F.abs(d - F.col("declared_duration")) > tolerance),
    )


def safe_member(name: Column) -> Column:
    """Whether an archive member's path stays inside: relative, without `..` parts."""
    return ~name.rlike(r"^(/|\\|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")
