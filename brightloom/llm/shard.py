"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined, then one exchange.

Rows are ordered by a 63-bit key: 32 bits of the text's hash, then 31 bits of the row's hash. Equal texts
are neighbours in that order, and a group of copies of any size still has boundaries inside it. Round by
round the bytes and rows below candidate boundaries are counted exactly over all partitions; a bin that
holds more than the tolerance is cut into finer ones. Once no bin does (or its key is one value), the shard
boundaries are the bin edges nearest to equal shares, and the rows are exchanged once, by bin.

Defined cases: a null text has no bytes and size 1; nulls elsewhere only enter the row hash; wholly equal
rows share a key and are numbered in any order, which cannot be told apart; an empty table gives an empty
result; input columns with the names that are added are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

KEY_BITS = 63
FIRST_BITS = 12
STEP_BITS = 6
#: A bin over 1/PARTS of all bytes, or over MAX_BIN_ROWS rows, is refined.
PARTS = 2048
MAX_BIN_ROWS = 1 << 20


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with _size (UTF-8 bytes plus 1) and _key."""
    text = F.col(text_col)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    high = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    low = F.xxhash64(row, text).bitwiseAND(F.lit(0x7FFFFFFF))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return docs.withColumns({"_size": size, "_key": F.shiftleft(high, 31).bitwiseOR(low)})


def histogram(keys: DataFrame, parts: int = PARTS, max_rows: int = MAX_BIN_ROWS) -> pd.DataFrame:
    """Bins (start, bits, bytes, rows) in key order that cover all keys, none above the tolerance unless it is one key.

    The driver holds at most 2**FIRST_BITS + (heavy bins a round) * 2**STEP_BITS rows, whatever the input."""

    def counted(rows: DataFrame, bits: int) -> pd.DataFrame:
        step = F.lit(1 << (KEY_BITS - bits)).cast("long")
        start = F.shiftright("_key", KEY_BITS - bits) * step
        return rows.groupBy(start.alias("start")).agg(F.lit(bits).alias("bits"), F.sum("_size").alias("bytes"), F.count("*").alias("rows")).toPandas().astype("int64")

    bins = counted(keys, FIRST_BITS)
    total = bins["bytes"].sum()
    while True:
        heavy = bins[((bins["bytes"] * parts > total) | (bins["rows"] > max_rows)) & (bins["bits"] < KEY_BITS) & (bins["rows"] > 1)]
        if heavy.empty:
            return bins.sort_values("start", ignore_index=True)
        rounds = []
        for bits, group in heavy.groupby("bits"):
            finer = min(KEY_BITS, int(bits) + STEP_BITS)
            at = F.shiftright("_key", KEY_BITS - int(bits))
            wanted = keys.where(at.isin([int(s) >> (KEY_BITS - int(bits)) for s in group["start"]]))
            rounds.append(counted(wanted, finer))
        bins = pd.concat([bins.drop(heavy.index), *rounds], ignore_index=True)


def splitters(bins: pd.DataFrame, shards: int) -> np.ndarray:
    """For each bin its shard: the cuts are the bin edges nearest to equal shares of the bytes."""
    upto = np.concatenate([[0], np.cumsum(bins["bytes"].to_numpy(np.int64))])
    cuts = []
    for i in range(1, shards):
        want = upto[-1] * i / shards
        k = int(np.searchsorted(upto, want))
        cuts.append(k - 1 if k and want - upto[k - 1] <= upto[min(k, len(upto) - 1)] - want else k)
    return np.searchsorted(np.array(cuts, np.int64), np.arange(len(bins)), "right")


def placed(rows: DataFrame, shards: int, parts: int = PARTS) -> DataFrame:
    """`rows` (with _key and _size, as from `keyed`) with shard and slot; the one exchange is by bin, a range of keys."""
    bins = histogram(store.cut(rows.select("_key", "_size")), parts)
    shard = splitters(bins, shards)
    count = bins["rows"].to_numpy(np.int64)
    before = np.cumsum(count) - count
    first = before - before[np.searchsorted(shard, shard)] if len(bins) else before
    starts = bins["start"].to_numpy(np.int64)

    @F.pandas_udf("bin long, shard int, base long")
    def place(key: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(starts, key.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"bin": k, "shard": shard[k].astype("int32"), "base": first[k]})

    order = Window.partitionBy("_at.bin").orderBy("_key")
    slot = (F.col("_at.base") + F.row_number().over(order) - 1).cast("long")
    return rows.withColumn("_at", place("_key")).withColumn("_slot", slot).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_at.shard").alias("shard"), F.col("_slot").alias("slot"))


def sharded(docs: DataFrame, shards: int = 8, text_col: str = "text") -> DataFrame:
    """`docs` with size, shard (0 to shards-1, of near-equal bytes) and slot (the row's place in its shard, from 0)."""
    docs = docs.drop("_size", "_key", "_at", "_slot", "shard", "slot", "size")
    return placed(keyed(docs, text_col), shards).drop("_key").withColumnRenamed("_size", "size")
