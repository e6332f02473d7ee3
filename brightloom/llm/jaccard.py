"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Equal texts form one class. Each class has TREES signatures of LONGEST one-byte MinHash labels: its paths in that many
prefix tries. The matched prefix is shortened class by class, from LONGEST labels on, until a partner meets it in some
trie with the target probability, whatever the partner's similarity: sets of m shingles have only certain similarities
of the threshold or more, and for small sets the least of these is well above it (for 7 shingles 6/7), so that longer
prefixes do. Two classes meet at the shorter of what either needs, no shorter, and a class enters the levels of its
possible partners. A node of a trie (level, tree, prefix) is a bucket; only equality of prefixes counts, so nodes are
grouped by hash rather than in sorted order. Buckets with the same classes are verified once, large ones block against
block. Exact Jaccard similarities are taken as matrix products; a pair counts in the first of the buckets that it
shares, and only counts and a spanning forest of the links leave a task, never the pairs. Components are those of
verified links. So work grows with the pairs that collide, not with the components that they would form.

Defined cases: words are as in `tokens`; a text of one to four words has one shingle, all its words; a null
text or one without words is a class by itself and links to nothing; rows with a null id take part and
are counted; repeated rows are copies of each other; an empty table gives an empty result; input columns
other than the id and the text are not used. Classes are numbered by a 64-bit hash of the text, so two different texts
of one hash would count as copies: of 2e10 texts about 10 pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, store, tokens

SHINGLE = 5
THRESHOLD = 0.8
TREES, LONGEST, LABEL_BITS = 20, 8, 8
TARGET_RECALL = 0.997
#: Classes and shingles that a block holds at most (about: classes are dealt to blocks by hash).
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 18
#: Sets of more shingles are given the prefix that the threshold itself needs.
FEW = 64

_seeds = tokens.mix(np.arange(1, 2 * TREES * LONGEST + 1, dtype=np.uint64))
FLIP = (_seeds[: TREES * LONGEST] >> np.uint64(32)).astype(np.uint32)[:, None]
TIMES = ((_seeds[TREES * LONGEST :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def prefix_length(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix for which a pair at the threshold meets in one of the trees with the target probability."""
    for k in range(longest, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    return 1


def least_similarity(m: int, n: int, threshold: float) -> float | None:
    """The least Jaccard similarity not below the threshold that sets of m and n shingles can have."""
    both = math.ceil(threshold * (m + n) / (1 + threshold) - 1e-9)
    return both / (m + n - both) if both <= min(m, n) else None


@functools.cache
def descent(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[tuple[int, ...], ...]:
    """For each number of shingles up to FEW, and for more in place 0, the lengths of the prefixes that a class enters with, shortest first."""
    base = prefix_length(threshold, target)
    partners = {m: {n: x for n in range(1, 2 * FEW) if (x := least_similarity(m, n, threshold))} for m in range(1, FEW + 1)}
    depth = {m: prefix_length(min(p.values()), target) for m, p in partners.items()}
    return ((base,), *(tuple(sorted({max(depth[m], depth.get(n, base)) for n in partners[m]})) for m in range(1, FEW + 1)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES longs; in each the LONGEST labels, first label in the top bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * LONGEST, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, ((x[i : i + 2048] ^ FLIP) * TIMES).min(1), out=least)
    labels = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return labels.reshape(TREES, LONGEST).copy().view(">u8").ravel().astype(np.uint64)


def nodes(shingles: np.ndarray, lengths: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Hashes of the nodes (level, tree, prefix) on a class's paths, at the levels it enters."""
    path, tree = signature(shingles), np.arange(TREES, dtype=np.uint64)
    levels = lengths[len(shingles) if len(shingles) < len(lengths) else 0]
    each = [tokens.mix((path >> np.uint64(LABEL_BITS * (LONGEST - k))) * tokens.BASE + tree + np.uint64(k * TREES)) for k in levels]
    return np.concatenate(each).view(np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class, n_shingles, keys); class is null for texts without words."""
    spark, lengths = docs.sparkSession, descent(threshold)
    store.bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("class"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            b = tokens.read(batch.column("text").to_pylist())
            sh, ptr = tokens.shingles(b.hashes(), b.ptr, SHINGLE)
            n = np.diff(ptr)
            keys = [nodes(sh[ptr[i] : ptr[i + 1]], lengths) if n[i] else None for i in range(len(n))]
            cls = pa.array(np.asarray(batch.column("class")), mask=n == 0)
            columns = [batch.column("doc_id"), cls, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "n_shingles", "keys"])

    return rows.mapInArrow(store.lean(sign), f"doc_id {kind}, class long, n_shingles long, keys array<long>")


def colliding(classes: DataFrame) -> tuple[DataFrame, int]:
    """classes(class, n_shingles, keys) that meet others: class and its buckets (key, blocks); and how many packs the one-block buckets fill.

    Of buckets with the same classes the one of least key stays, so the least key that two classes share always does."""
    own = classes.select("class", "n_shingles", F.explode("keys").alias("key"))
    full = own.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n_shingles").alias("s"), F.min("class").alias("first"), F.max("class").alias("last"),
        F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(5))).alias("y"),
    )
    full = full.where("first <> last").groupBy("m", "s", "first", "last", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("s") / BLOCK_SHINGLES)).cast("int")
    full = store.cut(full.select("key", "m", "s", blocks.alias("blocks")))
    small = full.where("blocks = 1").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    packs = max(1, -(-small["s"] // BLOCK_SHINGLES), -(-small["m"] // (4 * BLOCK_ROWS)))
    met = own.select("class", "key").join(full.select("key", "blocks"), "key")
    return met.groupBy("class").agg(F.collect_list(F.struct("key", "blocks")).alias("buckets")), packs


def _shared(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many elements the sets numbered `first` and `second` share, as a matrix."""
    sizes = np.array([len(s) for s in sets])
    values, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(first), len(second)), np.float32)
    if not len(values):
        return both
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, member = (np.cumsum(shared) - 1)[column[keep]], member[keep]
    step = 8192
    bounds = np.searchsorted(column, np.arange(0, int(shared.sum()) + step, step))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = np.zeros((len(sets), int(column[hi - 1]) % step + 1 if hi > lo else 0), np.float32)
        part[member[lo:hi], column[lo:hi] % step] = 1
        both += part[first] @ part[second].T
    return both


def _common(sets: tuple[np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
    """For pairs of sets (values, offsets) how many elements they share, all at once; of those under `below` where given."""
    values, offsets = sets
    rows = np.concatenate([first, second])
    n = offsets[rows + 1] - offsets[rows]
    pair = np.repeat(np.tile(np.arange(len(first)), 2), n)
    x = values[np.repeat(offsets[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    if below is not None:
        keep = x < below[pair]
        x, pair = x[keep], pair[keep]
    x = tokens.mix(x.astype(np.uint64)) + tokens.mix(pair.astype(np.uint64))  # equal for two sets' shared element of one pair
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    return np.bincount(pair[order][1:][same], minlength=len(first))


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        out = {"class": [], "links": [], "classes": [], "root": []}
        cols = {k: np.asarray(table[k]) for k in ("key", "class", "rows", "block", "low", "high")}
        shingles = table["shingles"].cast(pa.large_binary()).combine_chunks()
        at = np.frombuffer(shingles.buffers()[1], np.int64)[shingles.offset : shingles.offset + len(shingles) + 1]
        bag = np.frombuffer(shingles.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.uint64), (at - at[0]) // 8
        lists = table["keys"].combine_chunks()
        known = np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
        texts, keys = table["shingles"], table["keys"]
        order = np.lexsort((cols["class"], cols["high"], cols["low"], cols["key"]))
        same = np.ones(len(order), bool)
        for k in ("key", "low", "high"):
            same[1:] &= cols[k][order][1:] == cols[k][order][:-1]
        starts = np.flatnonzero(~same | (np.arange(len(order)) == 0))
        ends = np.append(starts[1:], len(order))
        # Most groups are two classes: these are verified all at once.
        two = (ends - starts == 2) & (cols["low"][order[starts]] == cols["high"][order[starts]])
        a, b = order[starts[two]], order[ends[two] - 1]
        two[two] = cols["class"][a] != cols["class"][b]
        a, b = order[starts[two]], order[ends[two] - 1]
        if len(a):
            both, sizes = _common(bag, a, b), np.diff(bag[1])
            good = (both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9) & (_common(known, a, b, cols["key"][a]) == 0)
            a, b = a[good], b[good]
            out["class"] += [cols["class"][a], cols["class"][b]]
            out["links"] += [cols["rows"][b], cols["rows"][a]]
            out["classes"] += [np.ones(2 * len(a), np.int64)]
            out["root"] += [np.tile(np.minimum(cols["class"][a], cols["class"][b]), 2)]
        for lo, hi in zip(starts[~two], ends[~two], strict=True):
            rows = order[lo:hi]
            cls, at = np.unique(cols["class"][rows], return_index=True)  # a repeated row of one class counts once
            rows = rows[at]
            weight, block, low, high = cols["rows"][rows], cols["block"][rows], cols["low"][rows[0]], cols["high"][rows[0]]
            first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if not len(first) or not len(second) or len(rows) < 2:
                continue
            sets = [np.frombuffer(texts[int(i)].as_py(), np.uint64) for i in rows]
            sizes = np.array([len(s) for s in sets])
            both = _shared(sets, first, second)
            found = both >= threshold * (sizes[first][:, None] + sizes[second][None, :] - both) - 1e-9
            own = [np.asarray(keys[int(i)].values) for i in rows]
            own = [k[k < cols["key"][rows[0]]] for k in own]
            found &= _shared(own, first, second) == 0  # else they have met in an earlier bucket
            link = np.zeros((len(rows), len(rows)), bool)
            link[np.ix_(first, second)] = found
            link |= link.T
            np.fill_diagonal(link, False)
            root = np.arange(len(rows))
            while True:
                near = np.where(link, root[None, :], len(rows)).min(1)
                new = np.minimum(root, near)
                new = np.minimum(new, new[new])
                if (new == root).all():
                    break
                root = new
            has = link.any(1)
            out["class"].append(cls[has])
            out["links"].append((link @ weight)[has])
            out["classes"].append(link.sum(1)[has])
            out["root"].append(cls[root][has])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    return verify


def verified(rows: DataFrame, packs: int, threshold: float = THRESHOLD) -> DataFrame:
    """rows(class, rows, keys, buckets, text) to (class, links, classes, root), a row for each class and block pair with links.

    links: the `rows` of the classes linked to it there; classes: their number; root: least class it is connected to there."""

    def shingled(batches):
        for batch in batches:
            b = tokens.read(batch.column("text").to_pylist())
            sh, ptr = tokens.shingles(b.hashes(), b.ptr, SHINGLE)
            sets = pa.array([sh[ptr[i] : ptr[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], ["class", "rows", "keys", "buckets", "shingles"])

    kinds = "class long, rows long, keys array<long>, buckets array<struct<key:long,blocks:int>>, shingles binary"
    rows = rows.select("class", "rows", "keys", "buckets", "text").mapInArrow(store.lean(shingled), kinds)
    rows = rows.select("class", "rows", "keys", "shingles", F.inline("buckets"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class", F.lit(3)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.xxhash64("key", "low", "high"))
    rows = rows.select("class", "rows", "keys", "shingles", "key", "block", "low", "high", pack.alias("pack"))
    return rows.groupBy("pack").applyInArrow(store.lean_group(_verify(threshold)), "class long, links long, classes long, root long")


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`verified` for the colliding classes, whose texts are read from their representatives."""
    met, packs = colliding(classes)
    members = store.cut(met.join(classes.select("class", "rep", "rows", "keys"), "class"))
    texts = docs.select(F.xxhash64(text_col).alias("_class"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))
    reps = store.small(members.select(F.col("class").alias("_c"), "rep"))  # ids of some bytes
    texts = texts.join(reps, (F.col("_class") == F.col("_c")) & F.col("_id").eqNullSafe(F.col("rep"))).select(F.col("_class").alias("class"), "text")
    facts = store.small(members.drop("rep"), 64 + 8 * 3 * TREES + 16 * 3 * TREES)
    return verified(texts.join(facts, "class"), packs, threshold)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, class (of equal texts), class_id (least id in it), group_id (least id
    connected to it by links), n_links (other documents linked to it, copies too), n_class_links (different texts linked)."""
    rows = store.cut(signed(docs, id_col, text_col, threshold))
    worded = rows.where("class IS NOT NULL")
    facts = [F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")]
    classes = store.cut(worded.groupBy("class").agg(*facts))
    linked = store.cut(links(docs, classes, threshold, id_col, text_col))
    store.freed(docs.sparkSession)
    roots = graph.components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("class").agg(F.sum("links").alias("links"), F.sum("classes").alias("n_class_links"))
    facts = classes.select("class", "rep", "rows").join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    facts = store.cut(facts.withColumn("root", F.coalesce("root", "class")))
    heads = store.cut(facts.groupBy("root").agg(F.min("rep").alias("group_id")))  # a hot root's join can then be split
    facts = facts.join(heads, "root").select("class", F.col("rep").alias("class_id"), "group_id", "root", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"))
    out = rows.select("doc_id", "class").join(store.cut(facts), "class", "left")
    return out.select("doc_id", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"), "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group (that of least id; a null id comes last), with its own columns; texts without words all stay."""
    rows = store.cut(joined(docs, id_col, text_col).where("class IS NOT NULL"))  # so that a hot class does not stay in its join's task
    own = rows.groupBy("root", "doc_id", "class").agg(F.count("*").alias("_same"))
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "class", "_same")).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.class").alias("_cls"), F.col("w._same").alias("_same"))
    first = store.cut(first)
    text = F.col(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_d"), F.xxhash64(text).alias("_c"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_worded"))
    kept = packed.where("_worded").join(first, (F.col("_c") == F.col("_cls")) & F.col("_d").eqNullSafe(F.col("_id")))
    out = kept.where("_same = 1").select("_row")
    if not first.where("_same > 1").isEmpty():  # repeated rows of one id and text: one of them
        order = Window.partitionBy("_cls", "_id").orderBy(F.xxhash64("_row"))
        out = out.unionByName(kept.where("_same > 1").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row"))
    return out.unionByName(packed.where("NOT _worded").select("_row")).select("_row.*")
