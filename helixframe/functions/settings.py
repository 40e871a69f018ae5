"""Scalar settings: sizes, contexts and frequency thresholds as users write them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: str) -> int:
    """Bytes of "8G", "512M", "100"."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([KMGT]?)B?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * _UNIT[m[2].upper()]


def format_size(n: int) -> str:
    for unit in "TGMK":
        if n >= _UNIT[unit]:
            return f"{n / _UNIT[unit]:.2f} {unit}B"
    return f"{n} B"


def parse_context(text: str | float) -> tuple[bool, float]:
    """(is a ratio of the query's length, value): a ratio if it is written with a point."""
    ratio = "." in str(text)
    value = float(text)
    if value < 0:
        raise ValueError("a context can't be negative")
    return ratio, value if ratio else int(value)


def context(qlen: Column, is_ratio: bool, value: float) -> Column:
    return F.floor(qlen * F.lit(float(value))).cast("long") if is_ratio else F.lit(int(value)).cast("long")


def build_threshold(x: float, sequences: int) -> int | None:
    """Occurrences beyond which a build leaves a k-mer out: 1 none, below 1 a share of the sequences, else a number."""
    if x <= 0:
        raise ValueError("max_freq_build must be above 0")
    if x == 1:
        return None
    return max(1, math.ceil(x * sequences)) if x < 1 else int(x)


def search_threshold(x: float, sequences: int, postings: int, k: int) -> int | None:
    """Occurrences beyond which a search leaves a k-mer out; 0 finds a number by the mean occurrence."""
    if x < 0:
        raise ValueError("max_freq can't be negative")
    if x == 0:
        return int(min(100_000, max(1000, 10.0 * postings / 4**k)))
    return build_threshold(x, sequences)


def primer_threshold(score: float, positions: list[tuple[int, int]]) -> tuple[float | None, int | None]:
    """Stage-1 threshold of primer searches as (share, number): a share up to 1, or a number from 2 that every pair can reach."""
    if 0 < score <= 1:
        return score, None
    if score < 2:
        raise ValueError("a primer score is a share up to 1 or a number from 2")
    if any(score > a + b for a, b in positions):
        raise ValueError("the primer score is above the number of positions of a pair")
    return None, int(score)


def primer_chain_minimum(add: int, positions: list[tuple[int, int]]) -> int:
    """Stage-2 minimum of primer searches: the least, over the pairs, of the longer primer's positions plus add."""
    if any(max(a, b) + add > a + b for a, b in positions):
        raise ValueError("the stage-2 threshold is above the number of positions of a pair")
    return min(max(a, b) + add for a, b in positions)
