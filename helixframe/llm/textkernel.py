"""Vectorised word and window hashing over the bytes of an Arrow string column.

Texts come in blocks of a MB, for which hashing takes some 50 MB, so memory follows
the block (or the longest single text), never the partition. Words are maximal runs of bytes other than
space and \\t \\n \\v \\f \\r; as no UTF-8 continuation byte is one of these,
splitting bytes is splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 2**64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ U64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


def _letters(lower: bool, seed: int) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64), 77 + seed)
    if lower:
        t[65:91] = t[97:123]
    t[_SPACE] = 0
    return t


_TABLES = {(lower, seed): _letters(lower, seed) for lower in (False, True) for seed in (0, 1)}
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = -(-n // BLOCK_BYTES) * BLOCK_BYTES
        with np.errstate(over="ignore"):
            for i, m in enumerate((_MULT, _INVERSE)):
                p = np.full(size, U64(m))
                p[0] = 1
                _POWERS[i] = np.cumprod(p, dtype=U64)
    return _POWERS[0], _POWERS[1]


class Block:
    """Words of some rows: byte starts and ends, the row of each, and the first word of each row."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        self.batch, self.n = batch, len(column)
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + self.n + 1].astype(np.int64) if offsets is not None and self.n else np.zeros(self.n + 1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        word = self.mark = self._mark()
        before, after = np.empty_like(word), np.empty_like(word)
        if len(word):
            before[1:], before[0] = word[:-1], False
            after[:-1], after[-1] = word[1:], False
            inner = self.at[(self.at > 0) & (self.at < len(word))]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.row = np.repeat(np.arange(self.n), np.diff(self.first))

    def _mark(self) -> np.ndarray:
        """Which bytes are of words."""
        return ~_SPACE[self.bytes]

    def word_hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        up, down = _powers(len(self.bytes))
        with np.errstate(over="ignore"):
            each = _TABLES[lower, seed][self.bytes] * up[: len(self.bytes)]
            each[~self.mark] = 0
            h = np.add.reduceat(each, self.start)
            h *= down[self.start]
        return mix(h, seed)

    def windows(self, size: int) -> np.ndarray:
        """Start words of the windows of so many words within one row."""
        n = len(self.row) - size + 1
        return np.flatnonzero(self.row[:n] == self.row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of so many words; position p holds that of words p to p + size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(mix(np.array([size], U64), seed)[0]))
    with np.errstate(over="ignore"):
        for j in range(size):
            h ^= words[j : j + n]
            h *= U64(0xBF58476D1CE4E5B9)
            h ^= h >> U64(31)
    return mix(h, seed)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows in order, each of so many bytes or a single row."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
        yield low, high
        low = high


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null: none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, kind: type[Block] = Block) -> Iterator[Block]:
    """Arrow batches, cut so that a block holds so many bytes of text or a single row."""
    for batch in batches:
        for low, high in cuts(lengths(batch.column(batch.schema.get_field_index(text))), most):
            yield kind(batch.slice(low, high - low), text)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
