"""Quality rules: gradient-boosted trees over document statistics.

`train` fits logistic gradient boosting on a bounded sample of labelled documents, on the driver, with
monotonic constraints on chosen statistics; `score` flattens the trees into numpy node arrays and passes
every document through them, one Arrow batch at a time and without a shuffle.

Defined cases: a null or empty text has zero words, fails the base rules and is not kept; nulls in other
columns pass through; repeated rows are judged alike; an empty table gives an empty result; if there are
no labels of both classes, the base rules alone decide; ids may have any type; of several documents with a
labelled id the one of least text hash is fitted on; extra columns pass through `score`, and the
statistics it adds replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, tokens

#: At most so many labelled rows are used for fitting: those of lowest hash of their id.
MAX_TRAIN_ROWS = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Document statistics and the direction in which each may change the probability of low quality (0: free).
FEATURES: dict[str, int] = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": 1, "dup_line_share": 1, "repeat_word_share": 1,
    "upper_share": 1, "digit_share": 0, "bang_per_word": 1, "pipe_per_word": 1, "stops_per_word": 0,
    "commas_per_word": 0, "distinct_word_share": 0, "words_per_line": 0, "lone_mark_share": 1, "non_ascii_share": 0,
}


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, UPPER, DIGIT = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
BANG, PIPE, STOP, COMMA = _flags(b"!"), _flags(b"|"), _flags(b".?"), _flags(b",;:")
LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def statistics(texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS (exact integers) and the matrix of FEATURES, a row for each text."""
    b = tokens.read(texts)
    buf, n = b.buf, b.n_words
    text_of = np.repeat(np.arange(len(n)), n)
    inside = ~tokens.SPACE[buf]
    lead = (buf & 0xC0) != 0x80
    word_chars = b.sums(inside & lead)
    h = b.hashes()

    keys, at = tokens.windows(h, b.ptr, WINDOW)
    twice = at[tokens.counts_repeated(keys ^ tokens.mix(text_of[at].astype(np.uint64) + np.uint64(1)))]
    edge = np.zeros(len(h) + WINDOW + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(h)] > 0)])
    n_repeat = covered[b.ptr[1:]] - covered[b.ptr[:-1]]

    breaks = np.flatnonzero(buf == 10)
    line_start, line_end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(buf)]])
    has = np.searchsorted(b.starts, line_end) > np.searchsorted(b.starts, line_start)
    line_start, line_end = line_start[has], line_end[has]
    line_text = np.searchsorted(b.begin, line_start, "right") - 1
    line_key = tokens.span_hashes(buf, line_start, line_end) ^ tokens.mix(line_text.astype(np.uint64) + np.uint64(1))
    first = np.unique(line_key, return_index=True)[1]
    n_lines = np.bincount(line_text, minlength=len(n))
    n_dup = n_lines - np.bincount(line_text[first], minlength=len(n))

    word_key = h ^ tokens.mix(text_of.astype(np.uint64) + np.uint64(1))
    distinct = np.bincount(text_of[np.unique(word_key, return_index=True)[1]], minlength=len(n))
    letters = np.concatenate([[0], np.cumsum(LETTER[buf])])
    lone = np.bincount(text_of[letters[b.ends] == letters[b.starts]], minlength=len(n))
    counts = {"n_words": n, "word_chars": word_chars, "n_symbols": b.sums(SYMBOL[buf]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    words, chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    columns = (
        np.log1p(n), word_chars / words, counts["n_symbols"] / words, n_dup / np.maximum(n_lines, 1), n_repeat / words,
        b.sums(UPPER[buf]) / chars, b.sums(DIGIT[buf]) / chars, b.sums(BANG[buf]) / words, b.sums(PIPE[buf]) / words, b.sums(STOP[buf]) / words,
        b.sums(COMMA[buf]) / words, distinct / words, n / np.maximum(n_lines, 1), lone / words, b.sums(buf >= 192) / chars,
    )
    return {k: np.asarray(v, np.int64) for k, v in counts.items()}, np.stack(columns, 1)


@dataclass
class Forest:
    """All trees in flat arrays: node i tests feature[i] <= threshold[i]; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Forest:
    """Logistic gradient boosting on quantile bins. signs: +1, -1 or 0, the direction allowed for each feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, w: np.ndarray, level: int, low: float, high: float) -> int:
        me, G, H = len(nodes), g[rows].sum(), w[rows].sum()
        value = float(np.clip(-G / (H + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, j]
                gl, hl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(c, w[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(G - gl) / (H - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                gain[(nl < least) | (len(rows) - nl < least) | (signs[j] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[1] >= 0:
            _, j, k, vl, vr = best
            goes = codes[rows, j] <= k
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high),) * 2}[signs[j]]
            left = grow(rows[goes], g, w, level + 1, *bounds[0])
            right = grow(rows[~goes], g, w, level + 1, *bounds[1])
            nodes[me] = [j, float(edges[j][k]), left, right, 0.0]
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), q - y, q * (1 - q), 0, -8.0, 8.0))
        f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
        margin += Forest(f, t, left, right, v, np.array(roots[-1:]), depth, 0.0).margin(x)
    return Forest(f, t, left, right, v, np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Forest | None:
    """Fit P(low quality) on at most `max_rows` labelled documents; None if a class is missing."""
    store.bounded_batches(docs.sparkSession)
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # a bounded table: safe to broadcast
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("k")).join(F.broadcast(sample), "_id")

    def features(batches):
        for batch in batches:
            _, x = statistics(batch.column("_text").to_pylist())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("i", "k", "y")), lists], ["i", "k", "y", "x"])

    rows = rows.select(F.xxhash64("_id").alias("i"), "k", (F.col("_y") > 0).cast("long").alias("y"), "_text")
    rows = rows.mapInArrow(store.lean(features), "i long, k long, y long, x array<double>")
    got = rows.groupBy("i").agg(F.min_by(F.struct("y", "x"), "k").alias("_r")).select("i", "_r.*").toArrow()
    if not len(got):
        return None
    x, y, i = np.array(got["x"].to_pylist()), np.asarray(got["y"]), np.asarray(got["i"])
    order = np.argsort(i)
    x, y = x[order], 1.0 - y[order]
    return boost(x, y, list(FEATURES.values())) if 0 < y.sum() < len(y) else None


def score(docs: DataFrame, model: Forest | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of `docs`, then COUNTS, base_failed, p_low and kept."""
    store.bounded_batches(docs.sparkSession)
    added = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("p_low", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    rest = docs.drop(*(f.name for f in added if f.name != text_col))
    schema = T.StructType([*rest.schema.fields, *added.fields])

    def judged(batches):
        for batch in batches:
            counts, x = statistics(batch.column(text_col).cast(pa.large_binary()).to_pylist())
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            low = 1 / (1 + np.exp(-model.margin(x))) if model else np.zeros(len(x))
            columns = [*(counts[c] for c in COUNTS), failed, low, ~failed & (low < threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], names=[f.name for f in schema])

    return rest.mapInArrow(store.lean(judged), schema)


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    kept = score(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), train(docs, labels), "_text")
    return kept.where("kept").select("_row.*")
