"""Packed sequences: four bases a byte, first base in the highest bits, and runs of degenerate letters laid over them.

Runs come as big-endian words: a count, then an entry each. Without the top bit
of the count, an entry is one word of 4 bits of letter, 4 of length less one, 24
of place; with it, two words, of which the first has 4 bits of letter and 12 of
length less one, the second the place, and the count is of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.alphabet import IUPAC

#: Letter of each set of bases: A 1, C 2, G 4, T 8.
_LETTER = {sum(1 << "ACGT".index(b) for b in bases): c for c, bases in IUPAC.items()}


def runs(data: bytes) -> list[tuple[int, int, str]]:
    """(place, length, letter) by place; data that is cut off has none."""
    words = np.frombuffer(data[: len(data) // 4 * 4], ">u4").astype(np.int64)
    if not len(words):
        return []
    count, wide = int(words[0] & 0x7FFFFFFF), bool(words[0] >> 31)
    entries = words[1:]
    if wide:
        count = count // 2 * 2
    if len(entries) < count:
        return []
    entries = entries[:count]
    if wide:
        head, place = entries[::2], entries[1::2]
        size = (head >> 16 & 0xFFF) + 1
    else:
        head, place = entries, entries & 0xFFFFFF
        size = (head >> 24 & 0xF) + 1
    letters = [_LETTER.get(int(x), "N") for x in head >> 28]
    return sorted(zip(place.tolist(), size.tolist(), letters, strict=True))


def unpack(packed: bytes, length: int, ambiguity: bytes = b"") -> str:
    two = np.frombuffer(packed, np.uint8)
    codes = np.stack([two >> 6, two >> 4 & 3, two >> 2 & 3, two & 3], axis=1).reshape(-1)[:length]
    seq = np.frombuffer(b"ACGT", np.uint8)[codes]
    for place, size, letter in runs(ambiguity):
        seq[place : place + size] = ord(letter)
    return seq.tobytes().decode()


def sequences(raw: DataFrame) -> DataFrame:
    """raw(volume, oid, accession, packed, length, ambiguity) -> (volume, oid, accession, seq)."""

    @F.pandas_udf("string")
    def read(packed: pd.Series, length: pd.Series, ambiguity: pd.Series) -> pd.Series:
        return pd.Series([unpack(p, int(n), a or b"") for p, n, a in zip(packed, length, ambiguity, strict=True)])

    return raw.select("volume", "oid", "accession", read("packed", "length", "ambiguity").alias("seq"))
