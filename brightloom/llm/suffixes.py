"""Substring dedup with sparse suffix arrays.

Of all suffixes (a suffix starts at a word) only those at content-selected positions are kept: where the hash of SEED
words is the least in some window of WINDOW such positions. A passage of MIN_WORDS = WINDOW + SEED - 1 words has one
of them whatever surrounds it, so it keeps the same suffixes in every document. Passages around suffixes whose seed
occurs in no other row cannot match and are dropped after an exact count of the seeds. Of all others the whole
content is matched, by a 64-bit digest of its MIN_WORDS words, instead of neighbours in a sorted order: each block of
texts sends its distinct passages once, dealt by digest, and gets back for each whether another row has it and
whether an earlier block has it. So every copy of a passage is found, and all but that of the first row are marked,
however many copies there are, whatever surrounds them and however often a row repeats them. Passages that overlap
or touch are merged to spans within each row.

Defined cases: words are as in `tokens` and compared by their hash; texts of fewer than MIN_WORDS words, empty
or null, have no spans; in a run of one repeated seed every WINDOW // 2-th suffix stays, which keeps its seed;
repeats within one row are not reported; a null id is reported as null; repeated rows are separate
occurrences; an empty table gives an empty result; other columns are not used. A row's text is held whole by the task
that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens

SEED, WINDOW = 8, 43
MIN_WORDS = SEED + WINDOW - 1
BLOCK_BYTES = 4 << 20


def minima(seed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least seed of each window of WINDOW positions, by minima from both sides of its blocks; and whether the window lies in one text."""
    n = len(seed)
    padded = np.full(-(-n // WINDOW) * WINDOW + WINDOW, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = seed
    grid = padded.reshape(-1, WINDOW)
    left, right = np.minimum.accumulate(grid, 1).ravel(), np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    m = max(n - WINDOW + 1, 0)
    return np.minimum(right[:m], left[WINDOW - 1 : WINDOW - 1 + m]), text[:m] == text[WINDOW - 1 : WINDOW - 1 + m]


def selected(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (word index) and hashes of the seeds that are least in some window of their text."""
    seed, at = tokens.windows(h, ptr, SEED)
    if not len(seed):
        return at, seed
    text = np.searchsorted(ptr, at, "right") - 1
    n = len(seed)
    least, inside = minima(seed, text)
    m = len(least)
    least = np.where(inside, least, 0)
    # A position is selected if some window that covers it has its hash as the least: the greatest of the windows' minima is its own.
    span = np.zeros(-(-n // WINDOW) * WINDOW + 2 * WINDOW, np.uint64)
    span[WINDOW - 1 : WINDOW - 1 + m] = least
    grid = span.reshape(-1, WINDOW)
    left, right = np.maximum.accumulate(grid, 1).ravel(), np.maximum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    most = np.maximum(right[:n], left[WINDOW - 1 : WINDOW - 1 + n])
    keep = np.flatnonzero(most == seed)
    # Runs of one seed are thinned.
    order = keep[np.lexsort((keep, seed[keep], text[keep]))]
    new = np.ones(len(order), bool)
    new[1:] = (seed[order][1:] != seed[order][:-1]) | (text[order][1:] != text[order][:-1]) | (np.diff(order) >= WINDOW)
    start = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    bucket = (order - start) // (WINDOW // 2)
    first = new.copy()
    first[1:] |= bucket[1:] != bucket[:-1]
    keep = np.sort(order[first])
    return at[keep], seed[keep]


def passages(h: np.ndarray, ptr: np.ndarray, keys: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and digests of the passages of MIN_WORDS words whose least seed is one of the (sorted) keys that are shared."""
    seed, at = tokens.windows(h, ptr, SEED)
    least, inside = minima(seed, np.searchsorted(ptr, at, "right") - 1)
    if not len(keys):
        return at[:0], seed[:0]
    place = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
    at = at[: len(least)][inside & (keys[place] == least) & shared[place]]
    up, down = tokens.powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return at, tokens.mix((sums[at + MIN_WORDS] - sums[at]) * down[at])


def tally(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and in how many texts each is (2 for more); texts ascend."""
    order = np.argsort(keys, kind="stable")
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= t[1:] != t[:-1]
    times = np.add.reduceat(other.astype(np.int64), first) if len(first) else first
    return k[first], np.minimum(times, 2).astype(np.uint8)


def _texts(row: dict) -> list[bytes]:
    whole = pa.decompress(row["text"], row["size"], "zstd", asbytes=True)
    cuts = np.cumsum([0, *row["lengths"]])
    return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def split(keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """Places of the keys dealt to each part."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.cumsum(np.bincount(part, minlength=parts))[:-1])


ASKED = "block long, part int, seeds binary, times binary"


def asked(block: int, keys: np.ndarray, times: np.ndarray, parts: int) -> pa.RecordBatch | None:
    """A row for each part that has some of the block's keys."""
    rows = [(block, p, keys[places].tobytes(), times[places].tobytes()) for p, places in enumerate(split(keys, parts)) if len(places)]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", "seeds", "times"]) if rows else None


def replied(asked: DataFrame, answer, name: str) -> DataFrame:
    """For each block the answers to what it asked."""
    replies = asked.groupBy("part").applyInArrow(store.lean_group(answer), "block long, part int, reply binary")
    return replies.groupBy("block").agg(F.collect_list(F.struct("part", "reply")).alias(name))


def blocked(rows: DataFrame, parts: int, seeded: bool = True) -> DataFrame:
    """rows(doc_id, text): blocks of texts (part -1), and, if wanted, each block's distinct seeds with 1, or 2 if several rows have it."""
    kind_name = rows.schema["doc_id"].dataType.simpleString()

    def flush(number, block, kind):
        me = (TaskContext.get().partitionId() << 32) + number
        ids, uids, texts = zip(*block, strict=True)
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        if seeded:
            b = tokens.read(list(texts))
            at, seed = selected(b.hashes(), b.ptr)
            keys, times = tally(seed, np.searchsorted(b.ptr, at, "right") - 1)
        whole = b"".join(texts)
        rows = [(me, -1, ids, uids, [len(t) for t in texts], pa.compress(whole, "zstd", asbytes=True), len(whole), None, None)]
        for p, places in enumerate(split(keys, parts)):
            if len(places):
                rows.append((me, p, None, None, None, None, None, keys[places].tobytes(), times[places].tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", "ids", "uids", "lengths", "text", "size", "seeds", "times"])

    def pack(batches: Iterator[pa.RecordBatch]):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        kind, number, held, block = head.schema.field("doc_id").type, 0, 0, []
        uid = (TaskContext.get().partitionId() << 40) - 1
        for batch in chain([head], batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                uid += 1
                block.append((doc, uid, text or b""))
                held += len(text or b"")
                if held >= BLOCK_BYTES:
                    yield flush(number, block, kind)
                    number, held, block = number + 1, 0, []
        if block:
            yield flush(number, block, kind)

    return rows.mapInArrow(store.lean(pack), f"block long, part int, ids array<{kind_name}>, uids array<long>, lengths array<long>, text binary, size long, seeds binary, times binary")


def answered(table: pa.Table) -> pa.Table:
    """For each block's seeds, in the order asked, whether several rows of the corpus have them."""
    asked = [np.frombuffer(x.as_py(), np.uint64) for x in table["seeds"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["times"]]), len(keys))
    replies = [x.tobytes() for x in np.split(total[at] > 1, np.cumsum([len(a) for a in asked])[:-1])]
    return pa.table({"block": table["block"], "part": table["part"], "reply": pa.array(replies, pa.binary())})


def placed(table: pa.Table) -> pa.Table:
    """For each block's passages, in the order asked: 1 if several rows of the corpus have them, and 2 more if an earlier block has."""
    table = table.sort_by("block")
    asked = [np.frombuffer(x.as_py(), np.uint64) for x in table["seeds"]]
    of = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    keys, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["times"]]), len(keys))
    says = ((total > 1)[at] + 2 * (of[first][at] < of)).astype(np.uint8)
    replies = [x.tobytes() for x in np.split(says, np.cumsum([len(a) for a in asked])[:-1])]
    return pa.table({"block": table["block"], "part": table["part"], "reply": pa.array(replies, pa.binary())})


def gathered(replies: list[dict], keys: np.ndarray, parts: int, kind: type) -> np.ndarray:
    """The replies to a block, in the order of its keys."""
    out, places = np.zeros(len(keys), kind), split(keys, parts)
    for reply in replies:
        out[places[reply["part"]]] = np.frombuffer(reply["reply"], kind)
    return out


def merged(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last word (exclusive) of the unions of the passages at these words, which ascend."""
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (np.diff(at) > MIN_WORDS)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return text[first], at[first], at[last] + MIN_WORDS


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, from_word, to_word and removed: the spans of MIN_WORDS or more words that other rows share (removed false),
    and those of them that an earlier row has (removed true)."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = max(store.partitions(spark), rows.rdd.getNumPartitions())
    blocks = store.written(blocked(rows, parts), "snappy")

    known = store.cut(replied(blocks.where("part >= 0").select("block", "part", "seeds", "times"), answered, "replies"))
    store.freed(spark)
    texts = blocks.where("part < 0").select("block", "ids", "uids", "lengths", "text", "size").join(known, "block")

    def found(row: dict) -> tuple[tokens.Batch, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block's passages that can repeat: their texts, first words and digests."""
        b = tokens.read(_texts(row))
        h = b.hashes()
        keys = np.unique(selected(h, b.ptr)[1])
        at, digest = passages(h, b.ptr, keys, gathered(row["replies"], keys, parts, bool))
        return b, np.searchsorted(b.ptr, at, "right") - 1, at, digest

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, text, _, digest = found(row)
                keys, times = tally(digest, text)
                sent = asked(row["block"], keys, times, parts)
                if sent:
                    yield sent

    sent = texts.select("block", "lengths", "text", "size", "replies").mapInArrow(store.lean(ask), ASKED)
    says = store.cut(replied(sent, placed, "says"))
    store.freed(spark)
    texts = texts.join(says, "block")

    def spans(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b, text, at, digest = found(row)
                keys, first, place = np.unique(digest, return_index=True, return_inverse=True)
                says = gathered(row["says"], keys, parts, np.uint8)[place]
                early = (says > 1) | (text[first][place] < text)
                ids = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
                for removed, keep in ((False, says % 2 > 0), (True, early)):
                    of, start, end = merged(text[keep], at[keep])
                    if len(of):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(start - b.ptr[of]), pa.array(end - b.ptr[of]), pa.array(np.full(len(of), removed))], ["doc_id", "from_word", "to_word", "removed"])

    return texts.select("ids", "lengths", "text", "size", "replies", "says").mapInArrow(store.lean(spans), f"doc_id {kind}, from_word long, to_word long, removed boolean")
