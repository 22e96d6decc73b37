"""Word shingles of many texts at once, as 64-bit hashes, for Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 18
_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES * 2, 1 << n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        for_base = np.full(size, _BASE, U64)
        for_base[0] = 1
        back = np.full(size, pow(_BASE, -1, 1 << 64), U64)
        back[0] = 1
        _POWERS[size] = (np.cumprod(for_base, dtype=U64), np.cumprod(back, dtype=U64))
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a column of texts that together hold about SLICE_BYTES, and the texts there; null is empty."""
    raw = column.cast(pa.large_binary())
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
        if size and size + n > SLICE_BYTES:
            yield at, i, [t or b"" for t in raw.slice(at, i - at).to_pylist()]
            at, size = i, 0
        size += n + 1
    if at < len(raw):
        yield at, len(raw), [t or b"" for t in raw.slice(at).to_pylist()]


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of `width` words, A-Z lower-cased; of a shorter text, the whole sequence as one.

    In the order of the texts.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, U64)
    power, back = _powers(len(buf))
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    word = mixed((total[end] - total[start]) * back[start] + (end - start).astype(U64) * U64(_STEP))
    doc = np.searchsorted(ends, start, side="right")
    n = len(word)
    out_doc, out = [], []
    if n >= width:
        h = word[: n - width + 1].copy()
        for i in range(1, width):
            h = h * U64(_STEP) + word[i : n - width + 1 + i]
        inside = doc[: n - width + 1] == doc[width - 1 :]
        out_doc.append(doc[: n - width + 1][inside])
        out.append(h[inside])
    count = np.bincount(doc, minlength=len(texts))
    first = np.searchsorted(doc, np.flatnonzero((count > 0) & (count < width)))
    for f in first.tolist():
        h = U64(0)
        with np.errstate(over="ignore"):
            for i in range(count[doc[f]]):
                h = h * U64(_STEP) + word[f + i]
            h = h + U64(int(count[doc[f]]))
        out_doc.append(doc[f : f + 1])
        out.append(np.array([h], U64))
    if not out:
        return np.empty(0, np.int64), np.empty(0, U64)
    docs, h = np.concatenate(out_doc), mixed(np.concatenate(out))
    if len(first):
        order = np.argsort(docs, kind="stable")
        docs, h = docs[order], h[order]
    return docs, h


class Late:
    """Shingles that come last in the global order, by rank; all others come first, by hash."""

    BITS = 22

    def __init__(self, least_first: np.ndarray) -> None:
        """The late shingles, in their order."""
        order = np.argsort(least_first)
        self.tokens, self.rank = least_first[order], order
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self.tokens >> U64(64 - self.BITS)] = True

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted set's early shingles, and its late ones in their order."""
        at = np.flatnonzero(self.maybe[s >> U64(64 - self.BITS)])
        if not len(at):
            return s, s[:0]
        place = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
        hit = self.tokens[place] == s[at]
        at, place = at[hit], place[hit]
        early = np.ones(len(s), bool)
        early[at] = False
        return s[early], s[at[np.argsort(self.rank[place])]]


def sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    doc, h = shingles(texts, width)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    out = []
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        s = h[i:j]
        s.sort()
        if j - i > 1:
            new = np.empty(j - i, bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        out.append(s)
    return out


def parities(own: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set, whether the number of its shingles in each of `bits` buckets is odd; as rows of 64-bit integers.

    Two sets differ in at least as many shingles as their parities differ in buckets.
    """
    row = np.repeat(np.arange(len(own)), [len(s) for s in own])
    at = np.concatenate(own) & U64(bits - 1) if own else np.empty(0, U64)
    odd = np.bincount(row * bits + at.astype(np.int64), minlength=len(own) * bits).reshape(len(own), bits) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.int64).reshape(len(own), bits // 64)
