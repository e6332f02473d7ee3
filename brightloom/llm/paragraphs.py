"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of LEAST words and more and, since a passage can be embedded in a longer line or run over several,
also windows of LENGTH words of the whole text, whatever its lines and punctuation: one begins at each place where the
hash of SEED words is the least of some WINDOW such places, so that a passage of 50 words holds a window
that is the same in every text. The bands of a paragraph's MinHash are tuned for recall: as many of ROWS rows as let a pair at the threshold
collide with the target probability. Each block of texts sends its band keys as packed arrays, dealt by key, and hears
which of them other rows have; only paragraphs that collide go on. Paragraphs of equal digest have similarity 1; different ones that
collide are verified by exact Jaccard similarity of their word shingles, bucket by bucket, and clustered by connected
components of the verified pairs. Found paragraphs that follow each other in a row, at most GAP words apart, make a
span, and spans of MIN_WORDS found words are reported, wherever they occur; the first occurrence of each cluster (by row)
is the one to keep.

Defined cases: lines of fewer than LEAST words and texts of fewer than LENGTH have no such paragraphs; a null or empty text
has none; a paragraph that only repeats within its own row is not reported; a null id is reported as null; repeated rows
are separate occurrences; an empty table gives an empty result; other columns are not used. A row's text is held whole
by the task that reads it. Digests and keys have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, jaccard, store, suffixes, tokens

LEAST, GAP, MIN_WORDS = 8, 12, 22
#: A passage of WINDOW - 1 + LENGTH = 50 words holds a whole window.
SEED, WINDOW, LENGTH = 3, 24, 27
THRESHOLD, TARGET_RECALL, MOST_KEYS = 0.8, 0.99, 48


def tuned(threshold: float = THRESHOLD, target: float = TARGET_RECALL, most: int = MOST_KEYS) -> tuple[int, int]:
    """(bands, rows): the most rows, at least 3, for which as few bands as reach the target need at most `most` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - target) / np.log(miss))) if miss > 0 else 1
        if bands * rows > most or rows > 3:
            break
        best = (bands, rows)
    return best


BANDS, ROWS = tuned()
_seeds = (tokens.mix(np.arange(1001, 1001 + 2 * BANDS * ROWS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
FLIP, TIMES = _seeds[::2], _seeds[1::2] | np.uint32(1)
#: Words whose MinHashes are taken at once: their arrays stay in a core's cache.
STRIDE = 1 << 15


def digests(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of words, from their word hashes."""
    up, down = tokens.powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return tokens.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of the shingles that start at each word, with places to spare at the end."""
    out = np.zeros(max(len(h) - jaccard.SHINGLE + 1, 0), np.uint64)
    for i in range(jaccard.SHINGLE):
        out = out * tokens.BASE + h[i : i + len(out)]
    return np.concatenate([(tokens.mix(out) >> np.uint64(32)).astype(np.uint32), np.zeros(2 * LENGTH, np.uint32)])


def banded(least: np.ndarray, out: np.ndarray, k: int) -> None:
    """Take the k-th MinHash of some paragraphs into the key of its band."""
    out[:, k // ROWS] = tokens.mix(out[:, k // ROWS] * tokens.BASE + least + np.uint64(k + 1))


def line_keys(sh: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each line, from the least of its shingles (a repeated one changes nothing); lines ascend."""
    out, lo = np.zeros((len(starts), BANDS), np.uint64), 0
    last = ends - jaccard.SHINGLE + 1
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(last, starts[lo] + STRIDE)))
        a = int(starts[lo])
        x = sh[a : int(last[hi - 1]) + 1]
        at = np.stack([starts[lo:hi] - a, last[lo:hi] - a], 1).ravel()
        for k in range(BANDS * ROWS):
            banded(np.minimum.reduceat((x ^ FLIP[k]) * TIMES[k], at)[::2], out[lo:hi], k)
        lo = hi
    return out


def window_keys(sh: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same for windows of LENGTH words, which ascend; minima over their shingles by doubling."""
    size = LENGTH - jaccard.SHINGLE + 1
    out, lo = np.zeros((len(starts), BANDS), np.uint64), 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = int(np.searchsorted(starts, a + STRIDE))
        x, at = sh[a : int(starts[hi - 1]) + size], starts[lo:hi] - a
        for k in range(BANDS * ROWS):
            least, step = (x ^ FLIP[k]) * TIMES[k], 1
            while 2 * step <= size:
                least, step = np.minimum(least[:-step], least[step:]), 2 * step
            banded(np.minimum(least[at], least[at + size - step]), out[lo:hi], k)
        lo = hi
    return out


def window_starts(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """First words of the windows: the last of equal least seeds in each stretch of WINDOW places of a text."""
    seed, at = tokens.windows(h, ptr, SEED)
    m = len(seed) - WINDOW + 1
    if m <= 0:
        return at[:0]
    place = np.uint64((1 << 24) - 1)
    least, step = (seed & ~place) | (place - (np.arange(len(seed), dtype=np.uint64) & place)), 1
    while 2 * step <= WINDOW:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    least = np.minimum(least[:m], least[WINDOW - step : WINDOW - step + m])
    text = np.searchsorted(ptr, at, "right") - 1
    inside = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
    back = (place - (least[inside] & place)).astype(np.int64)
    chosen = np.unique(inside + (back - inside) % (1 << 24))
    return at[chosen][at[chosen] + LENGTH <= ptr[text[chosen] + 1]]


@dataclass
class Paragraphs:
    """Of a batch of texts: each paragraph's text, first and last word (exclusive) and band keys."""

    batch: tokens.Batch
    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    keys: np.ndarray


def paragraphs(texts: list[bytes | None]) -> Paragraphs:
    b = tokens.read(texts)
    h = b.hashes()
    line = np.cumsum(b.buf == 10)[b.starts] if len(h) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), line[1:] != line[:-1]]))
    last = np.append(first[1:], len(h))[: len(first)]
    fits = last - first >= LEAST
    sh, starts = shingles(h), window_starts(h, b.ptr)
    start, end = np.concatenate([first[fits], starts]), np.concatenate([last[fits], starts + LENGTH])
    text = np.searchsorted(b.ptr, start, "right") - 1
    order = np.argsort(text, kind="stable")
    keys = np.concatenate([line_keys(sh, first[fits], last[fits]), window_keys(sh, starts)])
    return Paragraphs(b, h, text[order], start[order], end[order], keys[order])


ASKED = "block long, part int, keys binary, flags binary, prints binary"


def tally(keys: np.ndarray, row: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; flags: 1 if several rows have the key, plus 2 if different paragraphs do; and one paragraph's print."""
    order = np.argsort(keys, kind="stable")
    k, r, p = keys[order], row[order], print_[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    if not len(first):
        return k, np.zeros(0, np.uint8), p
    differ = lambda x: np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)
    return k[first], (differ(r) + 2 * differ(p)).astype(np.uint8), p[first]


def answered(table: pa.Table) -> pa.Table:
    """For each block's keys, in the order asked, the flags of the whole corpus."""
    asked = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
    flags, prints = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]]) for c, kind in (("flags", np.uint8), ("prints", np.uint32)))
    every = np.concatenate(asked)
    order = np.argsort(every, kind="stable")
    k, f, p = every[order], flags[order], prints[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.append(first, len(k)))
    says = np.bitwise_or.reduceat(f, first) | (count > 1) | (2 * (np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first))).astype(np.uint8)
    out = np.empty(len(every), np.uint8)
    out[order] = np.repeat(says, count)
    replies = [x.tobytes() for x in np.split(out, np.cumsum([len(a) for a in asked])[:-1])]
    return pa.table({"block": table["block"], "part": table["part"], "reply": pa.array(replies, pa.binary())})


def collided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The paragraphs one of whose keys another row has: doc_id, uid (row), start, end and digest; and, where a different paragraph
    has one of the keys, at the digest's first place in the block, the keys and the words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = max(store.partitions(spark), rows.rdd.getNumPartitions())
    blocks = store.written(suffixes.blocked(rows, parts, seeded=False).select("block", "ids", "uids", "lengths", "text", "size"), "snappy")

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = paragraphs(suffixes._texts(row))
                prints = (digests(p.hashes, p.start, p.end) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                keys, flags, prints = tally(p.keys.ravel(), np.repeat(p.text, BANDS), np.repeat(prints, BANDS))
                sent = [(row["block"], i, keys[x].tobytes(), flags[x].tobytes(), prints[x].tobytes()) for i, x in enumerate(suffixes.split(keys, parts)) if len(x)]
                if sent:
                    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent, strict=True), kinds, strict=True)], ["block", "part", "keys", "flags", "prints"])

    path = store.tables[-1]
    known = store.cut(suffixes.replied(blocks.select("block", "lengths", "text", "size").mapInArrow(store.lean(ask), ASKED), answered, "replies"))
    store.freed(spark)

    def take(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = paragraphs(suffixes._texts(row))
                keys, at = np.unique(p.keys.ravel(), return_inverse=True)
                says = np.bitwise_or.reduce(suffixes.gathered(row["replies"] or [], keys, parts, np.uint8)[at].reshape(p.keys.shape), 1)
                hit = says % 2 > 0
                text, start, end, keys, near = p.text[hit], p.start[hit], p.end[hit], p.keys[hit].view(np.int64), says[hit] > 1
                digest, b = digests(p.hashes, start, end).view(np.int64), p.batch
                new = np.zeros(len(text), bool)
                new[np.unique(digest, return_index=True)[1]] = True
                raw, ids, uids = b.buf.tobytes(), pa.array(row["ids"], batch.schema.field("ids").type.value_type), np.array(row["uids"])
                for lo in range(0, len(text), store.BATCH_ROWS):
                    x = slice(lo, lo + store.BATCH_ROWS)
                    full = (new & near)[x]
                    words = [raw[b.starts[i] : b.ends[j - 1]] if y else None for i, j, y in zip(start[x], end[x], full, strict=True)]
                    each = [k if y else None for k, y in zip(keys[x], full, strict=True)]
                    numbers = [pa.array(c, pa.int64()) for c in (uids[text[x]], start[x] - b.ptr[text[x]], end[x] - b.ptr[text[x]], digest[x])]
                    columns = [ids.take(pa.array(text[x])), *numbers, pa.array(each, pa.list_(pa.int64())), pa.array(words, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "start", "end", "digest", "keys", "words"])

    schema = f"doc_id {kind}, uid long, start long, end long, digest long, keys array<long>, words binary"
    found = store.written(blocks.join(known, "block").select("ids", "uids", "lengths", "text", "size", "replies").mapInArrow(store.lean(take), schema))
    store.delete(spark, path)
    del known
    store.freed(spark)
    return found


def clusters(found: DataFrame, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """(digest, cluster) of the paragraphs that are similar to a different one. Each step's table is deleted once the next is written, `found` too where its path is given."""
    spark = found.sparkSession
    facts = [F.first(F.col("end") - F.col("start")).alias("n_shingles"), F.first("keys").alias("keys"), F.first("words").alias("text")]
    texts = store.written(found.where("keys IS NOT NULL").groupBy(F.col("digest").alias("class")).agg(*facts))
    old = [store.tables[-1]]
    if path:
        store.delete(spark, path)
    store.freed(spark)
    met, packs = jaccard.colliding(texts.select("class", "n_shingles", F.array_distinct("keys").alias("keys")))
    met = store.written(met)
    old.append(store.tables[-1])
    store.freed(spark)
    rows = store.written(texts.withColumn("rows", F.lit(1).cast("long")).join(met, "class").drop("n_shingles"))
    for table in old:
        store.delete(spark, table)
    old = store.tables[-1]
    del texts, met
    store.freed(spark)
    linked = store.cut(jaccard.verified(rows, packs, threshold))
    store.delete(spark, old)
    store.freed(spark)
    return graph.components(linked.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("_digest"), F.col("root").alias("cluster"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Spans that occur in several rows: doc_id, from_word, to_word, repeated_words (found words in it), removed_words
    (those that are not the first occurrence of their cluster) and the least cluster in it."""
    store.bounded_batches(docs.sparkSession)
    found = collided(docs, id_col, text_col)
    path = store.tables[-1]
    marked = store.written(found.select("doc_id", "uid", "start", "end", "digest"))
    linked = store.cut(clusters(found, path=path))
    store.freed(docs.sparkSession)
    marked = marked.join(store.small(linked), F.col("digest") == F.col("_digest"), "left").withColumn("cluster", F.coalesce("cluster", "digest"))
    marked = marked.select("doc_id", "uid", "start", "end", "cluster")
    groups = marked.groupBy("cluster").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).where("first <> last").select(F.col("cluster").alias("_cluster"), "first")
    hits = store.cut(marked.join(store.cut(groups), F.col("cluster") == F.col("_cluster")).drop("_cluster"))
    order = Window.partitionBy("uid").orderBy("start", "end", "cluster")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("_upto", F.coalesce(upto, F.lit(-1 << 40)))
    hits = hits.withColumn("_span", F.sum((F.col("start") > F.col("_upto") + GAP).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = F.greatest(F.col("end") - F.greatest("start", "_upto"), F.lit(0))
    spans = hits.groupBy("uid", "_span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("from_word"), F.max("end").alias("to_word"), F.sum(new).cast("long").alias("repeated_words"),
        F.sum(F.when(F.col("uid") != F.col("first"), new).otherwise(0)).cast("long").alias("removed_words"), F.min("cluster").alias("cluster"),
    )
    return spans.where(F.col("repeated_words") >= min_words).drop("uid", "_span")
