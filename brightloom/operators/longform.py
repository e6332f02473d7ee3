"""Long recordings put together from short clips, and benchmark groups by duration range.

The composition walks through the clips with one cursor, around the end if need be. What it can reach is bounded by
the hours asked for, so only that many clips (found by a distributed prefix sum) go to the driver, where the walk runs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling

GAP = 0.15


def walk(durations: np.ndarray, groups: list[tuple[str, list[float], float]]) -> list[tuple[str, int, float, int, int]]:
    """(group, number, target, first, clips) for each recording; `first` is the cursor, modulo the number of clips.

    groups: name, targets in seconds that are taken in turn, hours."""
    out, cursor, n = [], 0, len(durations)
    for name, targets, hours in groups:
        made, number = 0.0, 0
        while n and made < hours * 3600:
            target = targets[number % len(targets)]
            seconds, clips, gaps = 0.0, 0, 0.0
            while seconds + gaps < target and clips < n:
                seconds += float(durations[(cursor + clips) % n])
                gaps += GAP
                clips += 1
            out.append((name, number, target, cursor % n, clips))
            cursor += clips
            made += min(target, seconds + gaps)
            number += 1
    return out


def compose(df: DataFrame, order: list[str], groups: list[tuple[str, list[float], float]], ident: str, duration: str = "duration") -> DataFrame:
    """(group, number, place, ident, duration, target): the clips of each recording, in their order."""
    spark = df.sparkSession
    rows = df.where(F.col(duration) >= 1.0)
    asked = sum(hours * 3600 + max(targets) for _, targets, hours in groups)
    longest = rows.agg(F.max(duration)).first()[0] or 0.0
    # Each recording takes at most its target and one clip more.
    recordings = sum(int(np.ceil(hours * 3600 / min(targets))) + 1 for _, targets, hours in groups)
    reach = sampling.running(rows, order, duration, "_at").where(F.col("_at") <= asked + recordings * longest)
    clips = reach.orderBy(*order).select(ident, duration).toPandas()
    schema = f"`group` string, number int, place int, ident {rows.schema[ident].dataType.simpleString()}, duration double, target double"
    out, n = [], len(clips)
    ids, seconds = clips[ident].tolist(), clips[duration].to_numpy(float)
    for name, number, target, first, count in walk(seconds, groups):
        out += [(name, number, i, ids[(first + i) % n], float(seconds[(first + i) % n]), target) for i in range(count)]
    return spark.createDataFrame(out, schema)


def summary(composed: DataFrame) -> DataFrame:
    """Recordings, seconds and mean seconds of each group."""
    each = composed.groupBy("group", "number").agg(F.least(F.first("target"), F.sum("duration") + GAP * F.count("*")).alias("seconds"))
    return each.groupBy("group").agg(F.count("*").alias("recordings"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean"))


def benchmark_group(df: DataFrame, hours: float, seed: int, low: float, high: float, ident: str = "audio_path", speaker: str = "speaker_id", duration: str = "duration") -> DataFrame:
    """Clips of a duration range (all, if there are none), an even number of each speaker's shortest, in hash order until the hours are full."""
    inside = df.where(F.col(duration).between(low, high))
    rows = df if inside.isEmpty() else inside
    n, people = rows.agg(F.count("*"), F.greatest(F.lit(1), F.count_distinct(speaker))).first()
    key = F.col(ident).cast("string")
    head = sampling.head_per_group(rows.withColumn("_k", sampling.stable_key(seed, key)), speaker, [duration, "_k"], max(1, -(-n // people)))
    return sampling.budget(head.withColumn("_k", sampling.stable_key(seed + 11, key)), ["_k"], duration, hours * 3600).drop("_k")
