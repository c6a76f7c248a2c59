"""Words, hashes and lookup tables as numpy arrays over the buffers of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  A word's hash is a polynomial in a random byte table modulo 2^64,
read off prefix sums and then mixed, so the cost per byte is a few vector operations and no Python object is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 18
SLICE_BYTES = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED_BYTES = _BYTES[FOLD]


@lru_cache(maxsize=None)
def _powers(base: int) -> np.ndarray:
    out = np.full(WINDOW + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(32)
    return h


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of an ordered pair of hashes."""
    return mix(left * U64(0xC2B2AE3D27D4EB4F) + (right ^ U64(0x165667B19E3779F9)))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    if len(text) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return buf, off


class Words(NamedTuple):
    """The words of a string column: positions in ``buf``, the row each is in, and a 64-bit hash."""

    buf: np.ndarray
    rows: int
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.docs, minlength=self.rows).astype(np.int64)


def words(text: pa.Array) -> Words:
    """Find and hash all words.  Works in windows, so memory beyond the result is bounded; a word may span windows."""
    buf, off = buffers(text)
    starts, ends, hashes = [], [], []
    power, inverse = _powers(_BASE), _powers(_INVERSE)
    begin, end = int(off[0]), int(off[-1])
    open_word = False
    for lo in range(begin, end, WINDOW):
        hi = min(lo + WINDOW, end)
        b = buf[lo:hi]
        solid = ~SPACE[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo] = True
        before = np.empty(len(b), bool)
        before[0], before[1:] = True, ~solid[:-1]
        after = np.empty(len(b), bool)
        after[-1], after[:-1] = True, ~solid[1:]
        s = np.flatnonzero(solid & (before | edge[:-1]))
        e = np.flatnonzero(solid & (after | edge[1:])) + 1
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_FOLDED_BYTES[b] * power[: len(b)], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        s, e = s + lo, e + lo
        if open_word and len(s) and s[0] == lo and not edge[0]:
            length = int(ends[-1][-1] - starts[-1][-1])
            joined = (int(hashes[-1][-1]) + pow(_BASE, length, 1 << 64) * int(h[0])) % (1 << 64)
            hashes[-1][-1], ends[-1][-1] = U64(joined), e[0]
            s, e, h = s[1:], e[1:], h[1:]
        open_word = bool(solid[-1])
        if len(s):
            starts.append(s)
            ends.append(e)
            hashes.append(h)
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(buf, len(off) - 1, none, none, none, np.zeros(0, np.uint64))
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return Words(buf, len(off) - 1, s, e, np.searchsorted(off, s, side="right") - 1, mix(h))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    _, off = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``buf[starts[i] : starts[i] + lengths[i]]``."""
    total = int(lengths.sum())
    if not total:
        return buf[:0]
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return buf[np.repeat(shift, lengths) + np.arange(total)]


def buckets(lengths: np.ndarray, cells: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    """Group rows by padded length: each length up to 16 alone, then to the next power of two; few cells at a time."""
    padded = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    order = np.argsort(padded, kind="stable")
    edges = np.flatnonzero(np.diff(padded[order])) + 1
    for rows in np.split(order, edges):
        if len(rows):
            width = int(padded[rows[0]])
            step = max(1, cells // max(width, 1))
            for k in range(0, len(rows), step):
                yield width, rows[k : k + step]


class HashTable:
    """Open addressing from distinct 64-bit keys to 32-bit values; a lookup of many keys runs in a few vector steps."""

    EMPTY = U64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY)
        self.values = np.full(1 << bits, -1, np.int32)
        keys = keys.astype(np.uint64)
        owner = np.full(1 << bits, -1, np.int64)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = owner[at] < 0
            owner[at[free]] = left[free]
            left = left[owner[at] != left]
            slot[left] = (slot[left] + 1) & self.mask
        used = owner >= 0
        self.keys[used], self.values[used] = keys[owner[used]], values[owner[used]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values by key, -1 where a key is missing."""
        slot = self._home(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], np.int32(-1))
        left = np.flatnonzero(~hit & (found != self.EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != self.EMPTY)]
        return out
