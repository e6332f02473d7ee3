"""LM scoring with a probabilistic suffix tree over words, beside a unigram base.

A text's symbols are its words (A-Z lower-cased) and one end. A state is a context: the last one to DEPTH words before a
symbol. The root's distribution is the base, (c + 0.1) / (N + 0.1 * (V + 1)), which leaves one share to all words not
seen. Every context that occurs twice in training is tested for divergence: the log-likelihood of the symbols
after it under its own smoothed counts, each symbol left out of the counts that predict it, must exceed their
log-likelihood after its suffix by GAIN nats. A context that passes is retained; where a suffix of it does not pass, that suffix
hands on the distribution of its own suffix. Distributions are smoothed by interpolation (n the count, T the
different symbols seen after the context s): P(w | s) = (n(s, w) + T(s) * P(w | suffix of s)) / (n(s) + T(s)). Each
symbol is scored by its longest retained suffix state, symbols not seen in training included, and a text's score is the
sum of log10 P over its symbols. What is gathered has no bound but the corpus: counts are absolute and of all texts.

Counting: each task packs blocks of texts. A block sends its distinct words, then its distinct (context, symbol) pairs
level by level, dealt by context, with their counts as packed arrays, and gets back the counts of the corpus and
whether the context is retained. A pair's code has 32 bits for the context (within its part) and 24 for the symbol, and
the suffix's log-probability enters the test rounded to 1 / GRAIN nat. A context with SPREAD occurrences or more is dealt
over several parts by its symbols. Its test is the same: each part sends how many of the symbols have each count and
log-probability, and these are summed by context. There are at most N / SPREAD of these contexts, and for each the number of its symbols, or
0, is all that meets on the driver. Where HOT is set, contexts of so many occurrences are retained without a test; by default none are.

Defined cases: a null text is empty: only the end is scored; a null id trains; ids may have any type and repeat
freely, each row is scored; a very long text is cut at spaces into segments that are summed, contexts reaching over
the cut; without training texts every symbol has the root's share and the base is 0; an empty table gives an empty
result; other columns are not used.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens

DEPTH = 2
GAIN = 3.0
GRAIN = 8
SPREAD, HOT = 1 << 22, float("inf")
BLOCK_BYTES = 4 << 20
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = np.uint64(0x5851F42D4C957F2D)

BLOCKS = (
    "block long, ids array<{id}>, uids array<long>, held array<boolean>, last array<boolean>, "
    "skips array<long>, sizes array<long>, words binary, stream binary"
)
ASKED = "block long, part int, codes binary, counts binary, suffix binary"
REPLY = "block long, part int, n binary, kinds binary"


def shrunk(x: np.ndarray) -> bytes:
    """An array, its bytes regrouped by significance and compressed, after their number."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def grown_back(x: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def differences(codes: np.ndarray) -> bytes:
    """Sorted codes as differences."""
    return shrunk(np.diff(codes, prepend=np.zeros(1, codes.dtype)))


def split(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """Places of each part's entries, in their order."""
    return np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))[:-1])


def batch_of(rows: list[tuple], schema: str, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


KINDS = {
    "block": pa.int64(), "part": pa.int32(), **dict.fromkeys(("uids", "skips", "sizes"), pa.list_(pa.int64())),
    **dict.fromkeys(("held", "last"), pa.list_(pa.bool_())), **dict.fromkeys(("words", "stream", "codes", "counts", "suffix", "n", "kinds"), pa.binary()),
}


def segments(text: bytes, most: int) -> list[tuple[bytes, bytes]]:
    """A text cut at the first space after each `most` bytes: for each piece the last DEPTH words before it, and the piece."""
    out, a, before = [], 0, []
    while True:
        b = text.find(b" ", a + most) if len(text) - a > most else -1
        piece = text[a:] if b < 0 else text[a:b]
        out.append((b" ".join(before), piece))
        if b < 0:
            return out
        before = [*before, *piece.split()][-DEPTH:] if DEPTH else []
        a = b


def packed(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, held) as blocks: each has its distinct words and its texts as numbers of them."""
    schema = BLOCKS.format(id=rows.schema["doc_id"].dataType.simpleString())

    def flush(number, block, kind):
        ids, uids, held, last, before, texts = map(list, zip(*block, strict=True))
        b = tokens.read([x + b" " + y if x else y for x, y in zip(before, texts, strict=True)])
        ends = np.array(last, np.int64)
        sizes = b.n_words + ends
        h = np.full(int(sizes.sum()), END, np.uint64)
        h[np.arange(len(b.starts)) + np.repeat(np.cumsum(ends) - ends, b.n_words)] = b.hashes()
        words, index = np.unique(h, return_inverse=True)
        me = (TaskContext.get().partitionId() << 32) + number
        row = (me, ids, uids, held, last, [len(x.split()) for x in before], sizes.tolist(), words.tobytes(), shrunk(index.astype(np.int32)))
        return batch_of([row], BLOCKS, KINDS | {"ids": pa.list_(kind)})

    def pack(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        kind, number, size, block = head.schema.field("doc_id").type, 0, 0, []
        uid = (TaskContext.get().partitionId() << 40) - 1
        for batch in chain([head], batches):
            for doc, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                uid += 1
                pieces = segments((text or b"").translate(FOLD), BLOCK_BYTES)
                for k, (before, piece) in enumerate(pieces):
                    block.append((doc, uid, held, k == len(pieces) - 1, before, piece))
                    size += len(piece) + 16
                    if size >= BLOCK_BYTES:
                        yield flush(number, block, kind)
                        number, size, block = number + 1, 0, []
        if block:
            yield flush(number, block, kind)

    return rows.mapInArrow(store.lean(pack), schema)


class Block:
    """A block's tokens, and what is known so far: of level k, the pairs of a context of k words and the symbol after it."""

    def __init__(self, row: dict, parts: int, most: int):
        """most: occurrences from which a context is hot."""
        self.number, self.parts, self.most = row["block"], parts, most
        self.words = np.frombuffer(row["words"], np.uint64)
        self.at = grown_back(row["stream"], np.int32).astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.at)) - (np.cumsum(self.sizes) - self.sizes)[self.of]
        self.scored = self.place >= np.array(row["skips"], np.int64)[self.of]
        self.trains = self.scored & ~np.array(row["held"], bool)[self.of]
        # Of the words that end at each token (one more each level): number of the distinct one, or -1, its hash and its count.
        self.gram, self.hash, self.level = self.at, self.words, 0

    def word_part(self) -> np.ndarray:
        return (self.words % np.uint64(self.parts)).astype(np.int64)

    def learn_words(self, replies: list[dict], n: int, v: int) -> None:
        self.n = np.zeros(len(self.words), np.int64)
        places = split(self.word_part(), self.parts)
        for reply in replies or ():
            self.n[places[reply["part"]]] = grown_back(reply["n"], np.int64)
        share = (self.n + 0.1) / (n + 0.1 * (v + 1))
        self.base = np.log10(share)
        self.p = share[self.at]

    def deepen(self) -> None:
        """The pairs of the next level: their context (a pair of this level) occurs twice or more in training."""
        self.level += 1
        before = np.concatenate([[-1], self.gram[:-1]])
        fits = (self.place >= self.level) & (before >= 0)
        fits[fits] = self.n[before[fits]] >= 2
        where = np.flatnonzero(fits)
        key, self.first, inverse = np.unique(before[where] << 32 | self.at[where], return_index=True, return_inverse=True)
        self.where, self.inverse, self.first = where, inverse, where[self.first]
        self.context, word = key >> 32, self.words[key & 0xFFFFFFFF]
        self.occurs = self.n[self.context]
        salts = self.occurs // self.most + 1
        self.hot = salts > 1
        spread = np.where(self.hot, tokens.mix(word) % salts.astype(np.uint64), 0).astype(np.uint64)
        own = self.hash[self.context]
        part = (tokens.mix(own + spread * tokens.BASE) % np.uint64(self.parts)).astype(np.int64)
        code = (own >> np.uint64(32) << np.uint64(24)) | (word >> np.uint64(40)) | (self.hot.astype(np.uint64) << np.uint64(63))
        self.code = code
        self.order = np.lexsort((code, part))
        self.bounds = np.searchsorted(part[self.order], np.arange(self.parts + 1))
        self.gram = np.full(len(self.at), -1, np.int64)
        self.gram[where] = inverse
        self.hash = tokens.mix(own * tokens.BASE + word)

    def asks(self) -> list[tuple]:
        """A row for each part that has pairs of this level."""
        count = np.bincount(self.inverse, self.trains[self.where], len(self.code)).astype(np.int64)
        low = np.minimum(np.rint(-np.log(self.p[self.first]) * GRAIN), 255).astype(np.uint8)
        out = []
        for part in np.flatnonzero(np.diff(self.bounds)):
            mine = self.order[self.bounds[part] : self.bounds[part + 1]]
            out.append((self.number, int(part), differences(self.code[mine]), shrunk(count[mine]), shrunk(low[mine])))
        return out

    def learn(self, replies: list[dict], hot: dict[int, int]) -> None:
        """Counts of the pairs and the symbols seen after their contexts (0: not retained); the tokens' probabilities with this level."""
        self.n, kinds = np.zeros(len(self.code), np.int64), np.zeros(len(self.code), np.int64)
        for reply in replies or ():
            mine = self.order[self.bounds[reply["part"]] : self.bounds[reply["part"] + 1]]
            self.n[mine], kinds[mine] = grown_back(reply["n"], np.int64), grown_back(reply["kinds"], np.int64)
        for i in np.flatnonzero(self.hot):
            kinds[i] = hot.get(int(self.code[i] >> np.uint64(24)), 0)
        own = self.p[self.first]
        own = np.where(kinds > 0, (self.n + kinds * own) / np.maximum(self.occurs + kinds, 1), own)
        self.p = self.p.copy()
        self.p[self.where] = own[self.inverse]

    def known(self, row: dict, level: int, n: int, v: int, hot: tuple[dict[int, int], ...]) -> Block:
        """With what the levels before have learnt, and the pairs of this one."""
        self.learn_words(row["r0"], n, v)
        for k in range(1, level):
            self.deepen()
            self.learn(row[f"r{k}"], hot[k - 1])
        self.deepen()
        return self


def answer_words(table: pa.Table) -> pa.Table:
    """The training counts of each block's words, in the order asked; and one row of totals (block -1): types and tokens."""
    asked = [np.frombuffer(x.as_py(), np.uint64) for x in table["codes"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, np.concatenate([grown_back(x.as_py(), np.int64) for x in table["counts"]]), len(keys)).astype(np.int64)
    part = table["part"][0].as_py()
    rows = [(b.as_py(), part, shrunk(x), None) for b, x in zip(table["block"], np.split(total[at], np.cumsum([len(a) for a in asked])[:-1]), strict=True)]
    rows.append((-1, part, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes(), None))
    return pa.Table.from_batches([batch_of(rows, REPLY, KINDS)])


def tested(keys: np.ndarray, n: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted pair codes: the context's number of symbols, 0 if it is not retained; and where contexts begin.

    low: minus the log-probability of the symbol after the context's suffix, times GRAIN."""
    context = keys >> np.uint64(24)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    occurs, kinds = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first)
    p, others = np.exp(-low.astype(float) / GRAIN), kinds[of] - (n == 1)
    own = (np.maximum(n - 1, 0) + others * p) / np.maximum(occurs[of] - 1 + others, 1)
    counts = (n > 0) & (occurs[of] > 1)
    gain = np.bincount(of[counts], n[counts] * np.log(own[counts] / p[counts]), len(first))
    return np.where((occurs > 1) & (gain > GAIN), kinds, 0)[of], first


def answer_pairs(table: pa.Table) -> pa.Table:
    """For each block's pairs, in the order asked, their counts and `tested`; and one row (block -1) of the trained pairs of hot contexts
    that this part has: context, count, log-probability and how many pairs have these."""
    asked = [np.cumsum(grown_back(x.as_py(), np.uint64)) for x in table["codes"]]
    keys, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    n = np.bincount(at, np.concatenate([grown_back(x.as_py(), np.int64) for x in table["counts"]]), len(keys)).astype(np.int64)
    low = np.concatenate([grown_back(x.as_py(), np.uint8) for x in table["suffix"]])[first]
    kinds, _ = tested(keys, n, low)
    cuts, part = np.cumsum([len(a) for a in asked])[:-1], table["part"][0].as_py()
    replies = zip(table["block"], np.split(n[at], cuts), np.split(kinds[at], cuts), strict=True)
    rows = [(b.as_py(), part, shrunk(x), shrunk(y)) for b, x, y in replies]
    hot = np.flatnonzero((keys >> np.uint64(63) > 0) & (n > 0))
    if len(hot):
        facts, times = np.unique(np.stack([(keys[hot] >> np.uint64(24)).astype(np.int64), n[hot], low[hot].astype(np.int64)]), axis=1, return_counts=True)
        rows.append((-1, part, facts.tobytes(), times.astype(np.int64).tobytes()))
    return pa.Table.from_batches([batch_of(rows, REPLY, KINDS)])


def hot_kinds(replies: DataFrame, least: float) -> dict[int, int]:
    """`tested` for the contexts that are dealt over several parts: their numbers of symbols, 0 if not retained. least: occurrences from which all are."""

    def told(batches):
        for batch in batches:
            for row in batch.to_pylist():
                context, n, low = np.frombuffer(row["n"], np.int64).reshape(3, -1)
                columns = [pa.array(x) for x in (context, n, low, np.frombuffer(row["kinds"], np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["context", "n", "low", "pairs"])

    facts = replies.where("block < 0").select("n", "kinds").mapInArrow(told, "context long, n long, low long, pairs long")
    facts = store.cut(facts.groupBy("context", "n", "low").agg(F.sum("pairs").alias("pairs")))
    totals = store.cut(facts.groupBy("context").agg(F.sum(F.col("n") * F.col("pairs")).alias("occurs"), F.sum("pairs").alias("symbols")))
    c = F.col
    p, others = F.exp(-c("low") / float(GRAIN)), c("symbols") - (c("n") == 1).cast("long")
    own = (c("n") - 1 + others * p) / F.greatest(c("occurs") - 1 + others, F.lit(1))
    gain = F.when(c("occurs") > 1, c("pairs") * c("n") * F.ln(own / p)).otherwise(0.0)
    gains = facts.join(totals, "context").groupBy("context").agg(F.sum(gain).alias("gain"), F.first("occurs").alias("occurs"), F.first("symbols").alias("symbols"))
    kept = ((c("occurs") > 1) & (c("gain") > GAIN)) | (c("occurs") >= F.lit(least))
    rows = gains.select("context", F.when(kept, c("symbols")).otherwise(0).alias("kinds"))
    return {r["context"]: r["kinds"] for r in rows.toLocalIterator()}


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of `docs`.

    Rows whose crc32 of the id as text is divisible by 10 are held out; all others train."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), F.col(text_col).cast("binary").alias("text"))
    parts, most = max(store.partitions(spark), rows.rdd.getNumPartitions()), int(min(SPREAD, HOT))
    blocks = store.written(packed(rows), "uncompressed")

    def replied(asked: DataFrame, answer) -> DataFrame:
        replies = store.cut(asked.groupBy("part").applyInArrow(store.lean_group(answer), REPLY))
        store.freed(spark)
        return replies

    def listed(replies: DataFrame, name: str) -> DataFrame:
        return replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "n", "kinds")).alias(name))

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, parts, most)
                count = np.bincount(b.at, b.trains, len(b.words)).astype(np.int64)
                places = [(p, x) for p, x in enumerate(split(b.word_part(), parts)) if len(x)]
                asked = [(b.number, p, b.words[x].tobytes(), shrunk(count[x]), None) for p, x in places]
                if asked:
                    yield batch_of(asked, ASKED, KINDS)

    replies = replied(blocks.mapInArrow(store.lean(ask_words), ASKED), answer_words)
    totals = [np.frombuffer(r["n"], np.int64) for r in replies.where("block < 0").select("n").toLocalIterator()]
    n, v = (int(x) for x in np.sum(totals, 0)) if totals else (0, 0)
    joined, hot = blocks.join(listed(replies, "r0"), "block", "left"), []
    for level in range(1, DEPTH + 1):

        def ask(batches, level=level, hot=tuple(hot)):
            for batch in batches:
                for row in batch.to_pylist():
                    asked = Block(row, parts, most).known(row, level, n, v, hot).asks()
                    if asked:
                        yield batch_of(asked, ASKED, KINDS)

        replies = replied(joined.mapInArrow(store.lean(ask), ASKED), answer_pairs)
        hot.append({} if replies.where("block < 0").isEmpty() else hot_kinds(replies, HOT))
        joined = joined.join(listed(replies, f"r{level}"), "block", "left")

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, parts, most)
                b.learn_words(row["r0"], n, v)
                of, count = b.of[b.scored], len(b.sizes)
                total = lambda x: np.bincount(of, x[b.scored], count)  # noqa: B023, E731
                columns = [total(np.ones(len(b.at))).astype(np.int64), total(b.n[b.at] > 0).astype(np.int64), total(b.base[b.at])]
                for k in range(1, DEPTH + 1):
                    b.deepen()
                    b.learn(row[f"r{k}"], hot[k - 1])
                columns.append(total(np.log10(b.p)))
                ids = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
                facts = [ids, pa.array(row["uids"], pa.int64()), pa.array(row["held"], pa.bool_()), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(facts, ["doc_id", "uid", "held", "n_tokens", "n_known", "base", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(store.lean(score), f"doc_id {kind}, uid long, held boolean, n_tokens long, n_known long, base double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")]
    out = out.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), *sums)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
