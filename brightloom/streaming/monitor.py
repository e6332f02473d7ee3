"""Structured Streaming forms of the online behaviours: windows, best-so-far, patience, early stop, first-seen rows, milestones.

Each takes a streaming DataFrame and returns one, or starts a query with an `availableNow` trigger; the
batch functions in `operators` give the same results on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_a_batch: int = 1, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def windowed(df: DataFrame, time: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes", *group: str) -> DataFrame:
    """Samples, mean and peak of tumbling or sliding windows; rows later than `late` are dropped."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    out = df.withWatermark(time, late).groupBy(span, *group).agg(F.count(value).alias("samples"), F.avg(value).alias("average"), F.max(value).alias("peak"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *group, "samples", "average", "peak")


def sessions(df: DataFrame, time: str, gap: str, late: str, *group: str) -> DataFrame:
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *group).agg(F.count("*").alias("rows"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *group, "rows")


def first_seen(df: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark; state older than that is given up."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def _stateful(df: DataFrame, key: str, order: str, fold: Callable, start: tuple, state: str, added: str) -> DataFrame:
    extra_fields = T._parse_datatype_string(added).fields
    schema, names = T.StructType([*df.schema.fields, *extra_fields]), [f.name for f in extra_fields]

    def step(_key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable", ignore_index=True)
        now, extra = fold(kept.get if kept.exists else start, rows)
        kept.update(now)
        yield rows.assign(**dict(zip(names, extra, strict=True)))

    return df.groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def best_so_far(df: DataFrame, key: str, order: str, metric: str) -> DataFrame:
    """Adds is_best: strictly under every value that the key had before."""

    def fold(now: tuple, rows: pd.DataFrame) -> tuple:
        x = rows[metric].to_numpy(float)
        least = np.fmin.accumulate(np.concatenate([[now[0]], x]))
        return (float(least[-1]),), (x < least[:-1],)

    return _stateful(df, key, order, fold, (float("inf"),), "best double", "is_best boolean")


def patience(df: DataFrame, key: str, order: str, value: str, limit: float, least: int) -> DataFrame:
    """Adds in_a_row, the values over the limit in a row, and stop once they are `least`."""

    def fold(now: tuple, rows: pd.DataFrame) -> tuple:
        at = np.arange(len(rows))
        good = np.maximum.accumulate(np.where(rows[value].to_numpy(float) > limit, -1, at))
        n = np.where(good < 0, at + 1 + now[0], at - good)
        return (int(n[-1]),), (n, n >= least)

    return _stateful(df, key, order, fold, (0,), "n long", "in_a_row long, stop boolean")


def worsening(df: DataFrame, key: str, order: str, metric: str) -> DataFrame:
    """Adds worsening: two steps in a row, each worse than the one before."""

    def fold(now: tuple, rows: pd.DataFrame) -> tuple:
        x = np.concatenate([now, rows[metric].to_numpy(float)])
        return (float(x[-2]), float(x[-1])), ((x[2:] > x[1:-1]) & (x[1:-1] > x[:-2]),)

    return _stateful(df, key, order, fold, (float("inf"), float("inf")), "older double, old double", "worsening boolean")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there into an in-memory table of that name; for reports and tests."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_files(df: DataFrame, path: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Appends to files exactly once; a run that is stopped goes on from the checkpoint."""
    query = df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def milestones(df: DataFrame, step: str, steps: list[int], report: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls report(rows, batch) with the rows at the given steps."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(step).isin(steps))
        if not rows.isEmpty():
            report(rows, number)

    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ready(df: DataFrame, key: str, order: str, good: Column, least: int = 3) -> DataFrame:
    """Adds in_a_row and stop for good samples in a row (an idle gate)."""
    return patience(df.withColumn("_good", good.cast("double")), key, order, "_good", 0.5, least).drop("_good")
