"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w.x - threshold[k]): the weights are shared, only the ordered thresholds differ.
x has log(1 + count) for each known word. Labels say only whether a document is toxic, so the grades for
fitting come from them: 0 for documents that are not, and 1 to 3 for thirds of the toxic ones by the share
of their words that tell toxic from other labelled documents. The expected severity is the sum over k of
P(grade > k), between 0 and 3. A word is a feature if its document counts in the two classes differ by at least
SIGNIFICANT in the squared Wald statistic of its log odds ratio (each count plus a half); there is no other cut of
the vocabulary. Only features leave the executors. Fitting runs on the driver over the sample, bounded by MAX_TRAIN_ROWS
rows and MAX_CELLS (row, feature) pairs; scoring passes every whole text through the weights batch by batch, without a shuffle.

Defined cases: words are runs of letters and digits, A-Z lower-cased; a null or empty text has no words and
gets the score of none; without labels of both classes every severity is 0; if no word is a feature all documents get
the classes' shares; null ids and labels are not fitted on; ids may have any type; of several documents with a labelled
id the one of least text hash is fitted on; repeated rows score alike; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, tokens

#: Labelled rows used for fitting at most (lowest hash of the id first), and (row, feature) pairs in them.
MAX_TRAIN_ROWS, MAX_CELLS = 20_000, 8_000_000
GRADES = 4
SIGNIFICANT = 8.0

#: Lower-cases A-Z and turns every other ASCII byte but letters and digits into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word hash, count), sorted by text."""
    b = tokens.read([(t or b"").translate(WORD_BYTES) for t in texts])
    h = b.hashes()
    text = np.repeat(np.arange(len(texts)), b.n_words)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
    return text[new], h[new], np.diff(np.append(new, len(h)))


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > k), a row for each text."""
        text, h, n = words(texts)
        margin = np.zeros(len(texts))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            value = np.where(self.known[at] == h, self.weights[at], 0.0) * np.log1p(n)
            margin = np.bincount(text, value, len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin[:, None], -50, 50)))


def graded(row: np.ndarray, word: np.ndarray, count: np.ndarray, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Grades 0 to 3 of the labelled documents: thirds of the toxic ones by their share of telling words."""
    bad = toxic[row] > 0
    a = np.bincount(word[bad], minlength=n_words) + 0.5
    b = np.bincount(word[~bad], minlength=n_words) + 0.5
    odds = np.log(a / (toxic.sum() + 1)) - np.log(b / ((1 - toxic).sum() + 1))
    telling = (odds > np.log(8)) & (a >= 0.02 * toxic.sum())
    share = np.bincount(row, telling[word] * count, len(toxic)) / np.maximum(np.bincount(row, count, len(toxic)), 1)
    cuts = np.quantile(share[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, share, "left"), 0)


def fit(row: np.ndarray, word: np.ndarray, count: np.ndarray, grade: np.ndarray, n_words: int, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood of the cumulative-link model."""
    x = np.log1p(count)
    w = np.zeros(n_words)
    above = [np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(GRADES - 1)]
    theta = np.log((1 - np.array(above)) / above)
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])  # first threshold, then log gaps
    params = np.concatenate([w, raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    each = np.arange(len(grade))
    for t in range(1, rounds + 1):
        w, raw = params[:n_words], params[n_words:]
        theta = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        margin = np.bincount(row, w[word] * x, len(grade))
        p = 1 / (1 + np.exp(np.clip(theta - margin[:, None], -50, 50)))  # P(grade > k)
        edges = np.concatenate([np.ones((len(grade), 1)), p, np.zeros((len(grade), 1))], 1)
        own = np.maximum(edges[each, grade] - edges[each, grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(grade), 1)), p * (1 - p), np.zeros((len(grade), 1))], 1)
        high, low = slope[each, grade] / own, slope[each, grade + 1] / own
        d_margin = -(high - low) / len(grade)
        d_theta = np.array([(high[grade == k + 1].sum() - low[grade == k].sum()) / len(grade) for k in range(GRADES - 1)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(word, d_margin[row] * x, n_words) + ridge * w, tail[:1], tail[1:] * np.exp(raw[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:n_words], params[n_words] + np.concatenate([[0], np.cumsum(np.exp(params[n_words + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """None if a class is missing."""
    store.bounded_batches(docs.sparkSession)
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # a bounded table: safe to broadcast
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("k")).join(F.broadcast(sample), "_id")

    def features(batches):
        for batch in batches:
            text, h, n = words(batch.column("_text").to_pylist())
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            lists = [pa.LargeListArray.from_arrays(cut, pa.array(x)).cast(pa.list_(pa.int64())) for x in (h.view(np.int64), n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("i", "k", "y")] + lists, ["i", "k", "y", "h", "n"])

    rows = rows.select(F.xxhash64("_id").alias("i"), "k", (F.col("_y") > 0).cast("long").alias("y"), "_text")
    rows = rows.mapInArrow(store.lean(features), "i long, k long, y long, h array<long>, n array<long>")
    rows = store.cut(rows.groupBy("i").agg(F.min_by(F.struct("y", "h", "n"), "k").alias("_r")).select("i", "_r.*"))
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < bad < total:
        return None
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = F.lit(bad + 0.5) - F.col("a"), F.lit(total - bad + 0.5) - F.col("b")
    wald = F.pow(F.log(a * d / (b * c)), 2) / (1 / a + 1 / b + 1 / c + 1 / d)
    known = rows.select("y", F.explode("h").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(wald >= SIGNIFICANT).select("w")
    known = np.sort(np.asarray(known.toArrow()["w"]).astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def kept(batches):
        for batch in batches:
            out = {"i": batch.column("i"), "y": batch.column("y"), "w": [], "n": []}
            for h, n in zip(batch.column("h"), batch.column("n"), strict=True):
                h, n = (np.asarray(x.values, np.int64) for x in (h, n))
                at = np.minimum(np.searchsorted(shared.value, h), max(len(shared.value) - 1, 0))
                keep = shared.value[at] == h if len(shared.value) else np.zeros(len(h), bool)
                out["w"].append(at[keep].astype(np.int32))
                out["n"].append(n[keep])
            lists = [pa.array(out["w"], pa.list_(pa.int32())), pa.array(out["n"], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([out["i"], out["y"], *lists], ["i", "y", "w", "n"])

    rows = store.cut(rows.mapInArrow(store.lean(kept), "i long, y long, w array<int>, n array<long>"))
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # MAX_TRAIN_ROWS rows of numbers at most
    cells = rows.select("i", F.sum(F.size("w")).over(upto).alias("_cells")).where(F.col("_cells") <= MAX_CELLS).select("i")
    got = rows.join(F.broadcast(cells), "i").toArrow().sort_by("i").combine_chunks()
    shared.destroy()
    toxic = np.asarray(got["y"]).astype(float)
    word, count = (np.asarray(got[c].combine_chunks().flatten()) for c in ("w", "n"))
    row = np.repeat(np.arange(len(toxic)), np.asarray(got["w"].combine_chunks().value_lengths()))
    if not 0 < toxic.sum() < len(toxic):
        return None
    count = count.astype(float)
    w, theta = fit(row, word, count, graded(row, word, count, toxic, len(known)), len(known))
    known = known.view(np.uint64)
    order = np.argsort(known)
    return Model(known[order], w[order], theta)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the expected severity (0 to 3), the likeliest grade and whether P(grade > 0) is at least a half."""
    store.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def score(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            above = model.above(texts) if model else np.zeros((len(texts), GRADES - 1))
            grade = np.argmax(np.concatenate([np.ones((len(texts), 1)), above], 1) - np.concatenate([above, np.zeros((len(texts), 1))], 1), 1)
            columns = [batch.column("doc_id"), pa.array(above.sum(1)), pa.array(grade, pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return rows.mapInArrow(store.lean(score), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, severity double, grade int, p_toxic double, toxic boolean")
