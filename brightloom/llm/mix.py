"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due target / source size copies. The whole part is given to all; the
fractions are rounded in pairs: words are shifted at random between two documents, with the expectation of
each kept and the pair's sum of words kept exactly, until one of the two fractions is 0 or 1. The other
document stays open and meets the next one. Chunks of a source run apart; the one document that each leaves
open goes up a reduction tree until a source has a single open document, whose fraction is the chance that it is
taken. So every document's expected copies are target / source size, and a source misses its target by less than
that document's words; pairs are formed from the longest documents to the shortest, which tends to leave a short one.

Defined cases: a null text has no words; a null source is a source of its own and sorts last; documents
without words take none; repeated rows are drawn on their own; an empty table gives an empty result; other
columns of the input are left out of the digest, and kept by `repeated`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: About so many documents of a source are rounded in one task, and so many open ones at the next level.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    """Words of a text; null counts 0. Native: a word starts at each non-space after a space or the start."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with _place, the place of each source by code point (null last, from 0); no task sees more than a range of them."""
    order = F.col("source").asc_nulls_last()
    parts = store.cut(sources.repartitionByRange(store.partitions(sources.sparkSession), order).withColumn("_part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in parts.groupBy("_part").count().collect())
    before = {part: sum(n for p, n in counts if p < part) for part, _ in counts}
    base = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    return parts.withColumn("_place", base + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).drop("_part")


def targets(rows: DataFrame) -> DataFrame:
    """One row for each source of rows(source, size): size, weight and target, by repeated water-filling.

    Works on one row a source throughout; a round only brings two sums to the driver."""
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_place") % len(WEIGHTS) + 1).cast("int"))
    table = store.cut(sources.withColumn("weight", weight.cast("double")).withColumn("most", (MOST_COPIES * F.col("source_size")).cast("double")))
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:  # each round caps at least one more source, or ends
        full = F.col("most") <= F.col("weight") * level
        capped, free = table.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - capped) / free if free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return table.withColumn("target", F.least("most", F.col("weight") * level))


def round_pairs(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fractions with at most one left strictly between 0 and 1; sum(size * part) stays, and so does each one's expectation."""
    p = part.astype(float).tolist()
    words = size.astype(float).tolist()
    draws = rng.random(len(p)).tolist()
    near = 1e-9
    held = -1
    for i in range(len(p)):
        if not near < p[i] < 1 - near:
            p[i] = float(round(p[i]))
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * words[a], p[b] * words[b])  # words that a can take from b
        down = min(p[a] * words[a], (1 - p[b]) * words[b])  # and give to it
        moved = up if draws[i] * (up + down) < down else -down
        p[a] += moved / words[a]
        p[b] -= moved / words[b]
        left = [j for j in (a, b) if near < p[j] < 1 - near]
        for j in (a, b):
            if j not in left:
                p[j] = float(round(p[j]))
        held = left[0] if left else -1
    return np.array(p)


def rounded(rows: DataFrame, seed: int = 7) -> DataFrame:
    """rows(source, size, part, whole, key, ...) with taken (copies): whole plus the rounded part."""
    spark = rows.sparkSession
    store.bounded_batches(spark)
    schema = rows.schema

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["level"].iloc[0]), int(pdf["chunk"].iloc[0]) & 0x7FFFFFFF, int(pdf["key"].iloc[0]) & 0x7FFFFFFF])
        return pdf.assign(part=round_pairs(pdf["size"].to_numpy(), pdf["part"].to_numpy(), rng))

    done = rows.where("NOT (part > 0 AND part < 1)")
    open_rows = rows.where("part > 0 AND part < 1")
    most = rows.agg(F.max("chunks")).first()[0] or 1
    level = 0
    while True:
        step = store.cut(open_rows.groupBy("source", "chunk").applyInPandas(chunk, schema))
        done = done.unionByName(step.where("NOT (part > 0 AND part < 1)"))
        rest = step.where("part > 0 AND part < 1")
        if most <= 1:
            chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) / (1 << 52)
            return done.unionByName(rest.withColumn("part", (chance < F.col("part")).cast("double")))
        most = -(-most // CHUNK)
        level += 1
        finer = F.floor(F.col("chunk") / CHUNK)
        open_rows = rest.withColumns({"chunk": finer.cast("long"), "level": F.lit(level)})


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """One row for each document: its id, size, source, source_size, target, copies, taken and the row's hash."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("key"))
    sizes = store.cut(sizes)
    by = targets(sizes).select(F.col("source").alias("_source"), "source_size", "source_rows", "target")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(by, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("due", F.when(F.col("size") > 0, due).otherwise(0.0)).withColumn("whole", F.floor(F.col("due") + 1e-12).cast("long"))
    chunks = F.ceil(F.col("source_rows") / CHUNK)
    rows = rows.withColumns({"part": F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)), "chunks": chunks, "chunk": F.pmod(F.xxhash64("key"), chunks), "level": F.lit(0)})
    rows = store.cut(rows.select("doc_id", "source", "size", "key", "source_size", "target", "whole", "part", "chunks", "chunk", "level"))
    copies = (F.col("whole") + F.col("part")).cast("long")
    return rounded(rows, seed).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("whole", "part", "chunks", "chunk", "level")


def repeated(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with its own columns.

    Rows of one id and text share their copies as evenly as possible."""
    twins = mixed(docs).groupBy(F.col("doc_id").alias("_i"), F.col("key").alias("_k")).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_key"))
    own = own.join(twins.where("_sum > 0"), F.col("_key").eqNullSafe(F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")))
    rank = F.row_number().over(Window.partitionBy("_i", "_k").orderBy(F.xxhash64("_row")))
    many = F.floor(F.col("_sum") / F.col("_rows")) + (rank <= F.col("_sum") % F.col("_rows")).cast("long")
    return own.withColumn("_many", many).where("_many > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_many").cast("int")))).select("_row.*")
