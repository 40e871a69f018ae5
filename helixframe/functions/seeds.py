"""Seed templates: which bases of a window make up its k-mer."""

from __future__ import annotations

CODING, OPTIMAL, CONTIGUOUS = "cod", "opt", "con"

#: (k, span) -> masks of the coding and the optimal template. Fixed values.
MASKS = {
    (8, 13): (0x1B2D, 0x1CD3),
    (8, 15): (0x4B2D, 0x7493),
    (8, 18): (0x2492D, 0x32293),
    (9, 13): (0x1B6D, 0x1DD3),
    (9, 15): (0x4B6D, 0x74D3),
    (9, 18): (0x24B2D, 0x3A293),
    (11, 16): (0xDB6D, 0xE5B7),
    (11, 18): (0x2D96D, 0x3A597),
    (11, 21): (0x12CB2D, 0x1D2897),
    (12, 16): (0xFB6D, 0xEDB7),
    (12, 18): (0x2DB6D, 0x3ACB7),
    (12, 21): (0x12DB2D, 0x1D2C97),
}


def offsets(k: int, span: int = 0, template: str = CONTIGUOUS) -> list[int]:
    """Places within a window whose bases make up its k-mer, from left to right."""
    if not 5 <= k <= 16:
        raise ValueError(f"k must be 5 to 16, not {k}")
    if not span:
        return list(range(k))
    if (k, span) not in MASKS or template not in (CODING, OPTIMAL):
        raise ValueError(f"no {template} template of weight {k} and span {span}")
    mask = MASKS[k, span][template == OPTIMAL]
    return [i for i in range(span) if mask >> (span - 1 - i) & 1]


def templates(span: int, kind: str) -> list[str]:
    """The templates that a search or a build with this kind ("cod", "opt" or "both") goes through."""
    if not span:
        return [CONTIGUOUS]
    return [CODING, OPTIMAL] if kind == "both" else [kind]


def window(k: int, span: int = 0) -> int:
    return span or k


def table_size(k: int) -> int:
    return 4**k
