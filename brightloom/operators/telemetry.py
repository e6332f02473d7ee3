"""Sensor series, latency percentiles, throughput and capacity planning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric


def summary(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Samples, mean and peak of the values that are there."""
    return df.groupBy(*group).agg(F.count(value).alias("samples"), F.avg(value).alias("average"), F.max(value).alias("peak"))


def percentiles(df: DataFrame, value: str, points: list[float], *group: str) -> DataFrame:
    """Exact, linearly interpolated percentiles p50, p95 ..."""
    return df.groupBy(*group).agg(*[F.percentile(value, p).alias(f"p{round(100 * p)}") for p in points])


def throughput(df: DataFrame, audio: str, wall: str, *group: str) -> DataFrame:
    """Real-time factor, speed and audio hours an hour, of sums."""
    a, w = F.sum(audio), F.sum(wall)
    return df.groupBy(*group).agg(a.alias("audio_seconds"), w.alias("wall_seconds"), F.try_divide(w, a).alias("rtf"), F.try_divide(a, w).alias("speed"), F.avg(wall).alias("average_latency"))


def capacity_plan(hardware: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every scenario (streams, redundancy) on every hardware (speed, utilization, gpus_a_server, hourly); both are configuration tables."""
    rows = hardware.crossJoin(F.broadcast(scenarios))
    c = F.col
    return rows.withColumns(numeric.capacity(c("streams"), c("speed"), c("utilization"), c("redundancy"), c("gpus_a_server"), c("hourly")))


def islands(df: DataFrame, group: str, order: str, good: Column, least: int) -> DataFrame:
    """Adds run (good samples in a row up to here) and ready (at least `least`)."""
    w = Window.partitionBy(group).orderBy(order)
    df = df.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_bad", F.sum((~F.col("_good")).cast("int")).over(w))
    run = F.sum(F.col("_good").cast("int")).over(Window.partitionBy(group, "_bad").orderBy(order))
    return df.withColumn("run", run).withColumn("ready", F.col("run") >= least).drop("_good", "_bad")


def recordings(df: DataFrame, group: str, order: str, duration: str, ident: str, most: float) -> DataFrame:
    """(group, recording, clips, seconds): clips in order are put together until a recording reaches `most` seconds; a last, shorter one stays.

    The open recording and its seconds depend on all clips before, so each group runs in order through one task, batch
    by batch; no group is held whole."""

    def numbered(batches):
        now, number, seconds = None, 0, 0.0
        for batch in batches:
            out = np.zeros(len(batch), np.int32)
            first = (batch[group].astype("string") != batch[group].astype("string").shift()).fillna(True).to_numpy(bool)
            for i, (key, d) in enumerate(zip(batch[group], batch[duration].astype(float), strict=True)):
                if first[i] and (now is None or key != now[0]):
                    now, number, seconds = (key,), 0, 0.0
                out[i] = number
                seconds += d
                if seconds >= most:
                    number, seconds = number + 1, 0.0
            yield batch.assign(recording=out)[[group, "recording", duration]]

    kind = f"{group} {df.schema[group].dataType.simpleString()}, recording int, {duration} double"
    rows = df.select(group, order, ident, F.col(duration).cast("double").alias(duration)).repartition(group).sortWithinPartitions(group, order, ident)
    return rows.mapInPandas(numbered, kind).groupBy(group, "recording").agg(F.count("*").alias("clips"), F.sum(duration).alias("seconds"))
