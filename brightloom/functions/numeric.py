"""Numeric functions on columns: buckets, clamps, bins, capacity formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_A_MONTH, SECONDS_AN_HOUR = 730, 3600


def bucket(duration: Column, resolution: float = 0.1) -> Column:
    """Nearest multiple of the resolution, halves to even."""
    return F.bround(duration / resolution).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def per_second(chars: Column, duration: Column) -> Column:
    """Characters a second; null unless the duration is positive."""
    return F.when(duration > 0, chars / duration)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def truth(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes")


def number(x: Column) -> Column:
    """A number from text; 0 where it is blank or no number."""
    return F.coalesce(F.try_cast(F.nullif(F.trim(x), F.lit("")), "double") if hasattr(F, "try_cast") else F.nullif(F.trim(x), F.lit("")).try_cast("double"), F.lit(0.0))


def bin_index(value: Column, boundaries: Column) -> Column:
    """How many boundaries lie below the value."""
    return F.size(F.filter(boundaries, lambda b: value > b))


def multiplier(*enabled: tuple[Column, float]) -> Column:
    """1 plus the factor of each enabled step."""
    total = F.lit(1.0)
    for flag, factor in enabled:
        total = total + F.when(flag, F.lit(factor)).otherwise(0.0)
    return total


def progress(step: Column, steps: Column, elapsed: Column) -> dict[str, Column]:
    """Percent done and seconds left at the pace so far."""
    return {"percent": 100.0 * step / F.greatest(steps, F.lit(1)), "eta_seconds": F.when(step > 0, elapsed / step * (steps - step))}


def capacity(streams: Column, speed: Column, utilization: Column, redundancy: Column, gpus_a_server: Column, hourly: Column) -> dict[str, Column]:
    """GPUs and servers for a number of streams, and what they cost."""
    each = F.greatest(speed * utilization, F.lit(1e-9))
    gpus = F.ceil(streams * redundancy / each)
    servers = F.ceil(gpus / gpus_a_server)
    monthly = gpus * hourly * HOURS_A_MONTH
    return {"streams_per_gpu": each, "gpus": gpus, "servers": servers, "monthly_cost": monthly, "annual_cost": monthly * 12, "cost_per_audio_hour": hourly / each}
