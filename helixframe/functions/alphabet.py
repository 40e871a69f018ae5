"""Nucleotide letters as column expressions: complements, degenerate codes, k-mer values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and the bases each stands for. Fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
DEGENERATE = "".join(c for c, bases in IUPAC.items() if len(bases) > 1)
#: What pairs with each letter: the code of the complements of its bases.
COMPLEMENT = {c: next(d for d, other in IUPAC.items() if set(other) == {"ACGT"[3 - "ACGT".index(b)] for b in bases}) for c, bases in IUPAC.items()}


def kmer_value(kmer: Column) -> Column:
    """A k-mer's number in base 4, A=0 C=1 G=2 T=3, first base most significant; upper-case ACGT only."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def reverse_complement(seq: Column, bases_only: bool = False) -> Column:
    """Reverse complement with case kept; letters outside IUPAC become N. bases_only: other letters than ACGT stay as they are."""
    letters = "ACGT" if bases_only else "".join(IUPAC)
    pairs = "".join(COMPLEMENT[c] for c in letters)
    if not bases_only:
        seq = F.regexp_replace(seq, f"[^{letters}{letters.lower()}]", "N")
    return F.reverse(F.translate(seq, letters + letters.lower(), pairs + pairs.lower()))


def is_degenerate(seq: Column) -> Column:
    return seq.rlike(f"[{DEGENERATE}{DEGENERATE.lower()}]")


def expansions(seq: Column) -> Column:
    """How many plain sequences a degenerate one stands for; letters outside IUPAC count as one."""
    total = F.lit(1.0)
    for n in (2, 3, 4):
        letters = "".join(c for c, bases in IUPAC.items() if len(bases) == n)
        total = total * F.pow(F.lit(float(n)), F.regexp_count(F.upper(seq), F.lit(f"[{letters}]")))
    return total.cast("long")


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Letters start to end, both counted from 0 and inclusive; end is clamped, and start beyond end gives nothing."""
    last = F.least(end, F.length(seq) - 1)
    return F.when(start <= last, F.substring(seq, start + 1, last - start + 1)).otherwise("")
