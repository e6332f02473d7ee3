"""Cutting lineage in the folder that all executors share, and bounding Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: bounds a worker's memory whatever a row's size.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20


#: Paths of the tables that `written` made in this session.
tables: list[str] = []
#: The session's Arrow settings before `bounded_batches` lowered them.
settings: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder if all runs on one machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not path and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="brightloom-"))
    return path or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` as a Parquet table in the shared folder; for bulky columns. codec: uncompressed or snappy where binary columns are compressed already."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/brightloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    tables.append(path)
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(table, True)
    if path in tables:
        tables.remove(path)


def cleanup(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that `written` left, but for the first `since`, and (for all of them) restore the Arrow settings.

    Results that still read the tables must have been saved before."""
    for path in tables[since:]:
        delete(spark, path)
    if not since:
        for key, old in settings.items():
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)
        settings.clear()


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are no longer held: it does so once the driver's garbage is collected.

    Spark's event queues hold the plan of the last query until they have taken the next event, hence the query of nothing."""
    for _ in range(2):
        gc.collect()
        spark.sql("SELECT 1").collect()
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts do not meet in one batch. Plans read these settings when they run; `cleanup` restores them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        settings.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, most)


#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 24 << 20


def small(df: DataFrame, row_bytes: int = 48) -> DataFrame:
    """`df` (cut before: it is counted) with a broadcast hint if rows of `row_bytes` at most keep it below the bound; else as it is, for a shuffled join."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def released() -> None:
    """Give the memory that numpy and Arrow have freed back to the system; an idle Python worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives its memory back at the end of the task."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            released()

    return run


def lean_group(fn: Callable) -> Callable:
    """The same for applyInArrow."""

    def run(table):
        try:
            return fn(table)
        finally:
            released()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
