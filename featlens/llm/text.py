"""Tokens of many texts at once: numpy over the bytes of an Arrow column, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Maps bytes to themselves (A-Z to a-z if lower), separators to 0."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators) + [0]] = 0
    return t


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most limit bytes, or one row. Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(kept: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within each text."""
    before = np.empty(len(kept), bool)
    before[:1] = False
    before[1:] = kept[:-1]
    after = np.empty(len(kept), bool)
    after[-1:] = False
    after[:-1] = kept[1:]
    cut = offs[(offs > 0) & (offs < len(kept))]
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after) + 1


class Tokens:
    """start, end: bytes of each token; of_doc: index of the first token of each text, and of the end; hash: 64 bits of its mapped bytes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.mapped = table[buf]
        self.start, self.end = runs(self.mapped != 0, offs)
        self.of_doc = np.searchsorted(self.start, offs)
        self.offs = offs

    def first(self) -> np.ndarray:
        """Whether each token is the first of its text."""
        f = np.zeros(len(self.start), bool)
        at = self.of_doc[:-1]
        f[at[at < self.of_doc[1:]]] = True
        return f

    @property
    def hash(self) -> np.ndarray:
        return hashes(self.mapped, self.start, self.end)


_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return h ^ (h >> np.uint64(31))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(start))
    pos = start.copy()
    while len(at):
        h[at] = mix(h[at] ^ (words[pos] & _TAIL[np.minimum(left, 8)]))
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    return h


def hash_of(word: bytes) -> int:
    b = np.frombuffer(word, np.uint8)
    return int(hashes(b, np.array([0]), np.array([len(b)]))[0])


class Lookup:
    """Positions of 64-bit hashes in a sorted set of them, and 0 for others; a small table of bits answers most misses."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(np.asarray(known, np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.known >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.known):
            at = np.flatnonzero(self.bits[h >> np.uint64(44)])
            p = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
            out[at] = np.where(self.known[p] == h[at], p + 1, 0)
        return out


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted byte positions of one text, the number of code points before each."""
    lead = (buf & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(lead)])
    return sums[at]
