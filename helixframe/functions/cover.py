"""Scores of whole sequences against a block of query k-mers, worked out where a sequence lies: no posting leaves its task.

Only rows that reach their query's threshold come out, so nothing is shuffled
but candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixframe.functions import kmers

#: Pairs of k-mers and queries that are in memory at a time, at least those of one sequence.
PAIRS = 1 << 22
#: k-mers up to this number are looked up in a table of all of them; more, by a bitmap of as many hashes and a search.
DIRECT = 1 << 22


class Block:
    """Query k-mers of one template: for each k-mer the keys (query and strand, by number) that have it, and at how many places.

    If a place stands for several k-mers, which a cover counts once, places are kept instead.
    """

    def __init__(self, key: np.ndarray, q_pos: np.ndarray, kmer: np.ndarray, at: list[int], expand: int, matches: bool):
        self.at, self.expand, self.matches = at, expand, matches
        rows = np.stack([kmer, key, q_pos], axis=1).astype(np.int64)
        if not matches:
            rows = np.unique(rows, axis=0)
        places = np.unique(rows[:, 1:], axis=0)
        self.by_place = not matches and len(places) < len(rows)
        if self.by_place:
            _, place = np.unique(rows[:, 1:], axis=0, return_inverse=True)
            self.key_of, self.n = places[:, 0], np.ones(len(rows), np.int64)
            self.owner = place.reshape(-1)
            order = np.argsort(rows[:, 0], kind="stable")
            kmer, self.owner = rows[order, 0], self.owner[order]
        else:
            pairs, self.n = np.unique(rows[:, :2], axis=0, return_counts=True)
            kmer, self.owner = pairs[:, 0], pairs[:, 1]
        self.kmer, first = np.unique(kmer, return_index=True)
        self.first = np.append(first, len(kmer))

    def table(self):
        """A function from k-mers to (places of those that a query has, their numbers)."""
        if 4 ** len(self.at) <= DIRECT:
            number = np.full(4 ** len(self.at), -1, np.int32)
            number[self.kmer] = np.arange(len(self.kmer))

            def find(value):
                found = number[value]
                hit = np.flatnonzero(found >= 0)
                return hit, found[hit].astype(np.int64)

            return find
        slot = lambda v: (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
        bits = np.zeros(DIRECT, bool)
        bits[slot(self.kmer)] = True

        def search(value):
            hit = np.flatnonzero(bits[slot(value)])
            found = np.minimum(np.searchsorted(self.kmer, value[hit]), len(self.kmer) - 1)
            same = self.kmer[found] == value[hit]
            return hit[same], found[same]

        return search

    def codes(self, data: np.ndarray, row: np.ndarray, find, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row and k-mer as one number, ascending; how often, 1 for a cover)."""
        start, value = kmers._windows(data, self.at, self.expand)
        ok = row[start] == row[start + self.at[-1]]
        if not ok.all():
            start, value = start[ok], value[ok]
        hit, u = find(value)
        code = row[start[hit]] * len(self.kmer) + u
        return self.distinct(code, np.ones(len(code), np.int64), n)

    def distinct(self, code: np.ndarray, often: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.matches:
            code, where = np.unique(code, return_inverse=True)
            return code, np.bincount(where.reshape(-1), often, len(code)).astype(np.int64)
        if n * len(self.kmer) <= 1 << 25:
            flags = np.zeros(n * len(self.kmer), bool)
            flags[code] = True
            code = np.flatnonzero(flags)
        else:
            code = np.unique(code)
        return code, np.ones(len(code), np.int64)

    def cells(self, code: np.ndarray, often: np.ndarray, keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row and key as one number, what it scores), whole rows at a time."""
        row, u = np.divmod(code, len(self.kmer))
        take = self.first[u + 1] - self.first[u]
        total, low = np.cumsum(take), 0
        while low < len(row):
            high = int(np.searchsorted(total, total[low] - take[low] + PAIRS, "right"))
            if high < len(row):
                high = int(np.searchsorted(row, row[high]))
            if high <= low:
                high = int(np.searchsorted(row, row[low], "right"))
            t, r = take[low:high], np.repeat(row[low:high], take[low:high])
            at = np.repeat(self.first[u[low:high]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            if self.by_place:
                r, place = np.divmod(np.unique(r * len(self.key_of) + self.owner[at]), len(self.key_of))
                yield r * keys + self.key_of[place], np.ones(len(r), np.int64)
            else:
                yield r * keys + self.owner[at], self.n[at] * np.repeat(often[low:high], t)
            low = high


def _reached(blocks: list[Block], codes: list, n: int, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, score) of n rows where the scores of all templates together reach the key's threshold."""
    keys = len(threshold)
    cells = (c for b, found in zip(blocks, codes, strict=True) for c in b.cells(*found, keys))
    if n * keys <= 1 << 23:
        score = np.zeros(n * keys, np.int64)
        for cell, s in cells:
            score += np.bincount(cell, s, len(score)).astype(np.int64)
        cell = np.flatnonzero(score.reshape(n, keys) >= threshold)
        score = score[cell]
    else:
        cell, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for more, s in cells:
            cell, where = np.unique(np.concatenate([cell, more]), return_inverse=True)
            score = np.bincount(where.reshape(-1), np.concatenate([score, s]), len(cell)).astype(np.int64)
        ok = score >= threshold[cell % keys]
        cell, score = cell[ok], score[ok]
    return cell // keys, cell % keys, score


def scorer(shared, names: list[str]):
    """The Arrow function (volume, oid, seq) -> rows of `names`. shared: a broadcast (blocks of one width, columns of the keys, thresholds above 0 by key)."""

    def run(batches):
        blocks, columns, threshold = shared.value
        columns, finds = [pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], [b.table() for b in blocks]
        width = blocks[0].at[-1] + 1

        def out(batch, row, key, score):
            row, key = pa.array(row), pa.array(key)
            return pa.RecordBatch.from_arrays([*[c.take(key) for c in columns], batch.column(0).take(row), batch.column(1).take(row), pa.array(score)], names=names)

        for batch in batches:
            sizes, parts = pc.binary_length(batch.column(2)), [[] for _ in blocks]
            for data, row, _, first in kmers._pieces(batch, 2, width):
                if not len(data):
                    continue
                base = int(row[0])
                row = row - base
                n = int(row[-1]) + 1
                codes = [b.codes(data, row, find, n) for b, find in zip(blocks, finds, strict=True)]
                size = sizes[base].as_py()
                if size > kmers._SLICE:  # a part of a long row: its k-mers count together
                    codes = parts = [b.distinct(*(np.concatenate(x) for x in zip(c, p, strict=True)), 1) if p else c for b, c, p in zip(blocks, codes, parts, strict=True)]
                    if first + kmers._SLICE < size - width + 1:
                        continue
                    parts = [[] for _ in blocks]
                found = _reached(blocks, codes, n, threshold)
                if len(found[0]):
                    yield out(batch, found[0] + base, *found[1:])

    return run
