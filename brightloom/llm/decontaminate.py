"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows. A stretch of text within `k` edits of a window of length L
shares at least L - Q + 1 - k * Q of its character q-grams, on diagonals that span no more than k: these are
counted in diagonal bands that overlap by half, and a region is verified by banded alignment only if a
band meets that bound. Texts and items are folded first: letters to lower case, anything but letters and
digits to one space; spans count code points of the text as it was.

The benchmark is taken in blocks of bounded size, each broadcast against all documents; equal windows are searched
once. Counting goes over slices of a text that overlap by more than a match can span, each with at most PAIRS
(text gram, item gram) pairs unless a single gram has more, so that memory is bounded on repetitive texts too.

Defined cases: null and empty texts and items match nothing; an item of fewer than Q folded characters has no
q-gram: it is found in the texts that equal it once folded (one window, no edits); a short item allows fewer edits, so
that the bound stays positive; equal items each report; item ids may have any type; repeated rows report alike; very
long texts are scanned in overlapping pieces; an empty table on either side gives no hits; `clean` keeps the columns
of the documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import store

Q = 8
WINDOW, STRIDE = 100, 50
EDIT_SHARE = 0.1
#: Characters of the benchmark in one broadcast block, and of text scanned at once (with the overlap of a long text's pieces).
BLOCK_CHARS = 4 << 20
PIECE, OVERLAP = 1 << 20, 1 << 12
#: Gram pairs counted at once, how far slices of a text overlap (over WINDOW and two bands), and regions aligned at once.
PAIRS, MARGIN, REGIONS = 1 << 21, 256, 1 << 14

FOLD = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    _s = chr(_c).lower()
    FOLD[_c] = ord(_s) if len(_s) == 1 and _s.isalnum() else 32 if not chr(_c).isalnum() else _c
EDGE = np.uint32(0xFFFFFFFF)
BASE = 0x9E3779B97F4A7C15


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and the place of each in the text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(cp < 1 << 16, FOLD[np.minimum(cp, (1 << 16) - 1)], cp)
    blank = cp == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[:1] &= ~blank[:1]
    at = np.flatnonzero(keep)
    return cp[at], at


def trimmed(s: np.ndarray) -> np.ndarray:
    """Folded code points without a space at the end."""
    return s[:-1] if len(s) and s[-1] == 32 else s


def grams(s: np.ndarray) -> np.ndarray:
    """Hashes of all Q-grams (Q = 8), by doubling."""
    h = s.astype(np.uint64)
    for step in (1, 2, 4):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + h[step:]
    return h * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """The windows of a block of items, and their q-grams."""

    def __init__(self, items: list[tuple[object, str]]):
        owners: dict[bytes, list] = {}
        self.short: dict[bytes, list] = {}
        for key, text in items:
            s = trimmed(fold(text or "")[0])
            if 0 < len(s) < Q:
                self.short.setdefault(s.tobytes(), []).append(key)
            starts = [*range(0, max(1, len(s) - WINDOW), STRIDE)] + [len(s) - WINDOW] * (len(s) > WINDOW)
            for a in dict.fromkeys(starts):
                if len(s[a : a + WINDOW]) >= Q:
                    owners.setdefault(s[a : a + WINDOW].tobytes(), []).append(key)
        self.items = [list(dict.fromkeys(x)) for x in owners.values()]
        patterns = [np.frombuffer(p, np.uint32) for p in owners]
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.budget = np.minimum((self.length * EDIT_SHARE).astype(np.int64), (self.length - Q) // Q)
        self.least = self.length - Q + 1 - self.budget * Q
        self.rows = np.full((len(patterns), WINDOW), EDGE, np.uint32)
        for w, p in enumerate(patterns):
            self.rows[w, : len(p)] = p
        n = self.length - Q + 1
        g = np.concatenate([grams(p) for p in patterns]) if patterns else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.window = np.repeat(np.arange(len(patterns), dtype=np.int32), n)[order]
        self.offset = (np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int16)[order]
        self.gram, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.bits = max(16, int(len(self.gram)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.gram >> np.uint64(64 - self.bits)] = True

    def search(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur in s within their budget: window, end in s (exclusive) and edits."""
        none = (np.zeros(0, np.int64),) * 3
        h = grams(s)
        if not len(self.gram) or not len(h):
            return none
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)])
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        same = self.gram[k] == h[at]
        at, k = at[same], k[same]
        passed, upto, lo = [], np.concatenate([[0], np.cumsum(self.count[k])]), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
            hi = max(hi, int(np.searchsorted(at, at[lo] + 2 * MARGIN)))
            passed.append(self.counted(at[lo:hi], k[lo:hi]))
            lo = max(lo + 1, int(np.searchsorted(at, at[hi - 1] + 1 - MARGIN))) if hi < len(at) else hi
        key = np.unique(np.concatenate(passed)) if passed else np.zeros(0, np.int64)
        out = []
        for i in range(0, len(key), REGIONS):
            w, band = key[i : i + REGIONS] >> 40, key[i : i + REGIONS] & ((1 << 40) - 1)
            width = np.maximum(self.budget[w], 1)
            ends, edits = self.align(s, w, band * width - WINDOW - width)
            good = edits <= self.budget[w]
            out.append((w[good], ends[good], edits[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none

    def counted(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """(window << 40 | band) for the bands in which enough of the grams at these places meet."""
        n = self.count[k]
        entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        w = self.window[entry].astype(np.int64)
        band = (np.repeat(at, n) - self.offset[entry] + WINDOW) // np.maximum(self.budget[w], 1)
        key, hits = np.unique((w << 40) | band, return_counts=True)
        both = hits.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, hits[1:], 0)
        return key[both >= self.least[key >> 40]]

    def align(self, s: np.ndarray, w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edit distance of each window to the nearest stretch of s within its band, and where that ends."""
        width = int(4 * self.budget[w].max() + 5)
        ramp = np.arange(width)
        d = np.zeros((len(w), width), np.int64)
        best, ends = np.full(len(w), 1 << 30), np.zeros(len(w), np.int64)
        for i in range(int(self.length[w].max())):
            place = start[:, None] + i + ramp
            char = np.where((place >= 0) & (place < len(s)), s[np.clip(place, 0, len(s) - 1)], EDGE)
            new = d + (char != self.rows[w, i][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            d = np.minimum.accumulate(new - ramp, 1) + ramp
            over = self.length[w] == i + 1
            if over.any():
                b = d[over].argmin(1)
                best[over] = d[over][np.arange(len(b)), b]
                ends[over] = start[over] + i + b + 1
        return ends, best


def scan(index: Index, texts: list[str | None]) -> dict[tuple[int, object], list[int]]:
    """(text number, item) -> start, end, edits of the nearest window, windows found."""
    found: dict[tuple[int, object], list[int]] = {}

    def flush(pieces: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        s = np.concatenate([x for p in pieces for x in (p[2], [EDGE])]).astype(np.uint32)
        base = np.cumsum([0, *(len(p[2]) + 1 for p in pieces)])
        for w, end, edits in zip(*index.search(s), strict=True):
            p = min(int(np.searchsorted(base, end - 1, "right")), len(pieces)) - 1  # an alignment may end past the text
            number, shift, chars, at = pieces[p]
            last = min(int(end - 1 - base[p]), len(chars) - 1)
            span = [shift + int(at[max(0, last + 1 - int(index.length[w]))]), shift + int(at[last]) + 1]
            for item in index.items[w]:
                old = found.get((number, item))
                found[number, item] = [min(old[0], span[0]), max(old[1], span[1]), min(old[2], int(edits)), old[3] + 1] if old else [*span, int(edits), 1]

    pieces, held = [], 0
    for number, text in enumerate(texts):
        for shift in range(0, max(1, len(text or "") - OVERLAP), PIECE - OVERLAP):
            chars, at = fold((text or "")[shift : shift + PIECE])
            if len(chars) <= Q and index.short and not shift:
                for item in index.short.get(trimmed(chars).tobytes(), ()):
                    found[number, item] = [int(at[0]), int(at[len(trimmed(chars)) - 1]) + 1, 0, 1]
            if len(chars) < Q:
                continue
            pieces.append((number, shift, chars, at))
            held += len(chars)
            if held >= PIECE:
                flush(pieces)
                pieces, held = [], 0
    if pieces:
        flush(pieces)
    return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's index, block by block; only one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toArrow()
        yield Index(sorted(zip(part["i"].to_pylist(), part["t"].to_pylist(), strict=True), key=repr))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each document and item found in it: ids, span (from, to), fewest edits and windows found."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}"
    schema = f"{kinds}, span_from long, span_to long, edits long, windows long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = spark.createDataFrame([], schema)
    for index in blocks(benchmark, item_col, "text"):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id")
                found = scan(shared.value, batch.column("text").to_pylist())
                at = pa.array([number for number, _ in found], pa.int64())
                item = pa.array([item for _, item in found], item_type)
                numbers = [pa.array([v[i] for v in found.values()], pa.int64()) for i in range(4)]
                if len(at):
                    yield pa.RecordBatch.from_arrays([ids.take(at), item, *numbers], ["doc_id", "item_id", "span_from", "span_to", "edits", "windows"])

        out = out.unionByName(rows.mapInArrow(store.lean(search), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents in which no item is found."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    for index in blocks(benchmark, item_col, "text"):
        shared = spark.sparkContext.broadcast(index)

        def drop(batches, shared=shared):
            for batch in batches:
                bad = {number for number, _ in scan(shared.value, batch.column(text_col).to_pylist())}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(store.lean(drop), docs.schema)
    return docs
