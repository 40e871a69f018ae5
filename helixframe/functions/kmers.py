"""k-mers of sequences as rows: one Arrow function, vectorised over a batch's bytes.

A window of a sequence gives a row for each plain k-mer that its selected
letters stand for, if these are no more than `expand`; windows with letters
outside IUPAC at selected places, or beyond that number, give none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.alphabet import IUPAC

_SLICE = 1 << 20
_SET = np.zeros(256, np.uint8)
for _c, _bases in IUPAC.items():
    for _x in (_c, _c.lower()):
        _SET[ord(_x)] = sum(1 << "ACGT".index(b) for b in _bases)
_COUNT = np.array([bin(i).count("1") for i in range(16)], np.uint8)[_SET]
_VALUE = np.zeros(256, np.int64)
for _i, _c in enumerate("ACGT"):
    _VALUE[ord(_c)] = _VALUE[ord(_c.lower())] = _i


def _windows(data: np.ndarray, at: list[int], expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and k-mers over some bytes."""
    n = len(data) - at[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count, base = _COUNT[data], _VALUE[data]
    if len(at) <= 15:
        base = base.astype(np.int32)
    value = base[at[0] : at[0] + n].copy()
    for o in at[1:]:
        value <<= 2
        value |= base[o : o + n]
    value = value.astype(np.int64)
    if (count == 1).all():  # plain letters only
        return np.arange(n), value
    limit, count, ways = max(1, expand) + 1, count.astype(np.int64), np.ones(n, np.int64)
    for o in at:
        np.minimum(ways * count[o : o + n], limit, out=ways)
    plain = np.flatnonzero(ways == 1)
    start, kmer = [plain], [value[plain]]
    for p in np.flatnonzero((ways > 1) & (ways < limit)):
        sets = [[b for b in range(4) if _SET[data[p + o]] >> b & 1] for o in at]
        each = [sum(b << 2 * (len(at) - 1 - i) for i, b in enumerate(c)) for c in itertools.product(*sets)]
        start.append(np.full(len(each), p))
        kmer.append(np.array(each, np.int64))
    return np.concatenate(start), np.concatenate(kmer)


def scan(seq: bytes, at: list[int], expand: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-mers of one sequence, by position."""
    pos, kmer = _windows(np.frombuffer(seq, np.uint8), at, expand)
    order = np.lexsort((kmer, pos))
    return pos[order], kmer[order]


def skips(seq: bytes, at: list[int], expand: int) -> bool:
    """Whether a window of IUPAC letters stands for more k-mers than are expanded."""
    data = np.frombuffer(seq, np.uint8)
    n = len(data) - at[-1]
    if n <= 0:
        return False
    ways = np.ones(n, np.int64)
    for o in at:
        ways = np.minimum(ways * _COUNT[data][o : o + n], 1 << 20)
    return bool((ways > max(1, expand)).any())


def _pieces(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes of neighbouring rows, the row of each byte, where rows begin, and the first position: about _SLICE bytes each, long rows in overlapping parts."""
    rows, parts, size = [], [], 0
    for r, value in enumerate(batch.column(column)):
        data = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
        if len(data) > _SLICE:
            for low in range(0, len(data) - width + 1, _SLICE):
                part = data[low : low + _SLICE + width - 1]
                yield part, np.full(len(part), r), np.zeros(len(part), np.int64), low
            continue
        rows.append(r), parts.append(data)
        size += len(data)
        if size >= _SLICE:
            yield _joined(rows, parts)
            rows, parts, size = [], [], 0
    if rows:
        yield _joined(rows, parts)


def _joined(rows: list[int], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    sizes = [len(p) for p in parts]
    return np.concatenate(parts), np.repeat(rows, sizes), np.repeat(np.cumsum([0, *sizes[:-1]]), sizes), 0


def kmers(df: DataFrame, keys: list[str], seq: str, at: list[int], expand: int = 0, pos: str = "pos", kmer: str = "kmer") -> DataFrame:
    """df(keys..., seq) -> (keys..., pos int, kmer long), 0-based window starts. Null and short sequences give no rows."""
    df = df.select(*keys, seq)
    width = at[-1] + 1

    def run(batches):
        for batch in batches:
            for data, row, begin, first in _pieces(batch, len(keys), width):
                start, value = _windows(data, at, expand)
                ok = row[start] == row[start + width - 1]
                start, value = start[ok], value[ok]
                if len(start):
                    take = pa.array(row[start])
                    columns = [batch.column(i).take(take) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((start - begin[start] + first).astype(np.int32)), pa.array(value)], names=[*keys, pos, kmer])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keys)])
    return df.mapInArrow(run, f"{fields}, {pos} int, {kmer} long")


def counts(df: DataFrame, seq: str, at: list[int], expand: int = 0) -> DataFrame:
    """df(seq) -> (kmer, n): occurrences, added up within each piece before a row leaves Python."""
    df = df.select(seq)
    width = at[-1] + 1

    def run(batches):
        for batch in batches:
            for data, row, _, _ in _pieces(batch, 0, width):
                start, value = _windows(data, at, expand)
                kmer, n = np.unique(value[row[start] == row[start + width - 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(n.astype(np.int64))], names=["kmer", "n"])

    return df.mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
