"""Statistics of waveforms held as array<float>, with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT_DB, TINY = -40.0, 1e-12


def _mean_square(x: Column) -> Column:
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return squares / F.size(x)


def decibels(rms: Column) -> Column:
    return 20.0 * F.log10(rms + TINY)


def rms(x: Column) -> Column:
    return F.sqrt(_mean_square(x) + TINY)


def rms_db(x: Column) -> Column:
    return decibels(rms(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def frames(x: Column, size: int) -> Column:
    """Whole frames of `size` samples; the tail is dropped."""
    n = F.floor(F.size(x) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(x, i * size + 1, size))


def silence_share(x: Column, size: int, below_db: float = SILENT_DB) -> Column:
    """Share of the frames that are silent; 1 without a whole frame."""
    parts = frames(x, size)
    silent = F.size(F.filter(parts, lambda f: rms_db(f) < below_db))
    return F.when(F.size(parts) > 0, silent / F.size(parts)).otherwise(1.0)


def snr_proxy(db: Column, silent_db: float = SILENT_DB) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(60.0), db - silent_db))


def mono(x: Column) -> Column:
    """NaN to 0; scaled to a peak of 1 if it is over 1."""
    clean = F.transform(x, lambda v: F.when(F.isnan(v), 0.0).otherwise(v))
    return F.when(peak(clean) > 1, F.transform(clean, lambda v: v / peak(clean))).otherwise(clean)


def pcm16(x: Column) -> Column:
    """Samples as little-endian 16-bit integers, in one binary value."""

    def coded(v: Column) -> Column:
        clipped = F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), F.when(F.isnan(v), F.lit(0).cast("float")).otherwise(v)))
        word = F.pmod((clipped * F.lit(32767.0).cast("float")).cast("int"), F.lit(65536))
        return F.concat(F.lpad(F.hex(word % 256), 2, "0"), F.lpad(F.hex(F.floor(word / 256)), 2, "0"))

    return F.unhex(F.array_join(F.transform(x, coded), ""))


def pcm_sha1(x: Column, rate: int, seconds: float | None = None) -> Column:
    part = x if seconds is None else F.slice(x, 1, int(rate * seconds))
    return F.sha1(F.concat(F.lit(str(rate)).cast("binary"), pcm16(part)))


def windows(duration: Column, length: float = 30.0) -> Column:
    """(start, end) of fixed windows over a duration."""
    n = F.greatest(F.ceil(duration / length), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * length).alias("start"), F.least((i + 1) * length, duration).alias("end")))


def chunks(x: Column, size: int, least: int) -> Column:
    """Consecutive pieces of `size` samples; a last one under `least` is dropped."""
    n = F.greatest(F.ceil(F.size(x) / size), F.lit(1)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * size + 1, size)), lambda c: F.size(c) >= least)


def joined(parts: Column, silence: int, most: int) -> Column:
    """Pieces with `silence` zero samples between them, cut at `most`, scaled to a peak of 1 if over it."""
    gap = F.array_repeat(F.lit(0.0).cast("float"), silence)
    line = F.aggregate(parts, F.array().cast("array<float>"), lambda acc, p: F.when(F.size(acc) == 0, p).otherwise(F.concat(acc, gap, p)))
    return mono(F.slice(line, 1, most))
