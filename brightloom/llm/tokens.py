"""Vectorised word, line and shingle hashing of a batch of texts (numpy, no per-word Python).

Words are runs of bytes other than space and 0x09-0x0D, as in `[^\\x20\\x09-\\x0D]+`.
A word's 64-bit hash is a polynomial over its bytes, so it depends on the word alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes hashed at once; bounds the scratch arrays (a longer single word extends it).
WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.full(n, base, U)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] for sorted, disjoint spans."""
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + WINDOW, "right")))
        b = int(ends[hi - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(BYTE[buf[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        lo = hi
    return out


@dataclass
class Batch:
    """A batch of texts: joined bytes, offsets of each text, words and where each text's words begin."""

    buf: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each text, the sum of a per-byte array."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.end] - total[self.begin]


def read(texts: list[bytes | None]) -> Batch:
    """Nulls count as empty texts."""
    texts = [x or b"" for x in texts]
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    edge = np.diff((~SPACE[buf]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ptr = np.searchsorted(starts, np.concatenate([begin, end[-1:] + 1]) if len(texts) else np.zeros(1, np.int64))
    return Batch(buf, begin, end, starts, ends, ptr)


def windows(hashes: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words that lie within one text, and their first word's index."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for i in range(size):
        h = h * BASE + hashes[i : i + n]
    ends = np.repeat(ptr[1:], np.diff(ptr))[:n]
    at = np.flatnonzero(np.arange(size, size + n) <= ends)
    return mix(h[at]), at


def shingles(hashes: np.ndarray, ptr: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text the distinct hashes of its `size`-word windows, sorted, and their offsets.

    A text of fewer words (but at least one) has one shingle: all its words."""
    h, at = windows(hashes, ptr, size)
    text = np.searchsorted(ptr, at, "right") - 1
    short = np.flatnonzero((np.diff(ptr) > 0) & (np.diff(ptr) < size))
    if len(short):
        extra = np.zeros(len(short), U)
        for i in range(size - 1):
            has = ptr[short] + i < ptr[short + 1]
            word = hashes[np.minimum(ptr[short] + i, len(hashes) - 1)]
            extra = np.where(has, extra * BASE + word, extra)
        h, text = np.concatenate([h, mix(extra + U(1))]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(ptr)))


def counts_repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(k), bool)
    out[order] = twice
    return out
