"""Sinks: tables in several formats, fan-out by a column, JSON and Markdown reports, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """The columns that the table has, with a header."""
    (df.select(*[c for c in columns if c in df.columns]) if columns else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def header_only(spark: SparkSession, schema: T.StructType, path: str) -> None:
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def fan_out(df: DataFrame, path: str, by: str) -> None:
    """One pass into a folder for each value of `by`."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def split_manifests(df: DataFrame, path: str, projections: dict[str, Callable[[DataFrame], DataFrame]], split: str = "split") -> None:
    """For each named projection, a table partitioned by split."""
    for name, project in projections.items():
        project(df).write.mode("overwrite").partitionBy(split).parquet(f"{path}/{name}")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at `path` has not yet; returns how many. Tasks commit whole files, so it can be repeated."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as error:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def json_report(df: DataFrame) -> DataFrame:
    """One JSON string for each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small report (at most `most` rows)."""
    rows = df.limit(most).collect()
    text = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [df.columns, ["---"] * len(df.columns), *[[text(v) for v in r] for r in rows]]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def section(text: str, name: str, body: str) -> str:
    """`text` with the part between the section's markers replaced, or added at the end."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = f"{start}\n{body.strip()}\n{end}"
    if start in text and end in text:
        return text[: text.index(start)] + block + text[text.index(end) + len(end) :]
    return f"{text.rstrip()}\n\n{block}\n"


def snapshot(df: DataFrame, path: str) -> None:
    """Replaces the table at `path` whole: written beside it, then renamed; the previous one stays as .old."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    live, new, old = hadoop(path), hadoop(f"{path}.tmp"), hadoop(f"{path}.old")
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(live):
        fs.rename(live, old)
    fs.rename(new, live)
