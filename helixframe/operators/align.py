"""Stage 3: semi-global alignment with affine gaps, row by row with array operations."""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.alphabet import reverse_complement, subsequence
from helixframe.functions.settings import context

#: Scores of the degenerate matrix between letters, and with anything else. Fixed values.
LETTERS = "ATGCSWRYKMBVHDN"
DEGMATCH = np.array(
    [
        [5, -4, -4, -4, -4, 3, 3, -4, -4, 3, -4, 2, 2, 2, 1],
        [-4, 5, -4, -4, -4, 3, -4, 3, 3, -4, 2, -4, 2, 2, 1],
        [-4, -4, 5, -4, 3, -4, 3, -4, 3, -4, 2, 2, -4, 2, 1],
        [-4, -4, -4, 5, 3, -4, -4, 3, -4, 3, 2, 2, 2, -4, 1],
        [-4, -4, 3, 3, 4, -4, 1, 1, 1, 1, 2, 2, 1, 1, 1],
        [3, 3, -4, -4, -4, 4, 1, 1, 1, 1, 1, 1, 2, 2, 1],
        [3, -4, 3, -4, 1, 1, 4, -4, 1, 1, 1, 2, 1, 2, 1],
        [-4, 3, -4, 3, 1, 1, -4, 4, 1, 1, 2, 1, 2, 1, 1],
        [-4, 3, 3, -4, 1, 1, 1, 1, 4, -4, 2, 1, 1, 2, 1],
        [3, -4, -4, 3, 1, 1, 1, 1, -4, 4, 1, 2, 2, 1, 1],
        [-4, 2, 2, 2, 2, 1, 1, 2, 2, 1, 3, 1, 1, 1, 1],
        [2, -4, 2, 2, 2, 1, 2, 1, 1, 2, 1, 3, 1, 1, 1],
        [2, 2, -4, 2, 1, 2, 1, 2, 1, 2, 1, 1, 3, 1, 1],
        [2, 2, 2, -4, 1, 2, 2, 1, 2, 1, 1, 1, 1, 3, 1],
        [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1],
    ]
)
#: The public NUC.4.4 scores, which are EDNAFULL's too, between the same letters. Fixed values.
NUC44 = np.array(
    [
        [5, -4, -4, -4, -4, 1, 1, -4, -4, 1, -4, -1, -1, -1, -2],
        [-4, 5, -4, -4, -4, 1, -4, 1, 1, -4, -1, -4, -1, -1, -2],
        [-4, -4, 5, -4, 1, -4, 1, -4, 1, -4, -1, -1, -4, -1, -2],
        [-4, -4, -4, 5, 1, -4, -4, 1, -4, 1, -1, -1, -1, -4, -2],
        [-4, -4, 1, 1, -1, -4, -2, -2, -2, -2, -1, -1, -3, -3, -1],
        [1, 1, -4, -4, -4, -1, -2, -2, -2, -2, -3, -3, -1, -1, -1],
        [1, -4, 1, -4, -2, -2, -1, -4, -2, -2, -3, -1, -3, -1, -1],
        [-4, 1, -4, 1, -2, -2, -4, -1, -2, -2, -1, -3, -1, -3, -1],
        [-4, 1, 1, -4, -2, -2, -2, -2, -1, -4, -1, -3, -3, -1, -1],
        [1, -4, -4, 1, -2, -2, -2, -2, -4, -1, -3, -1, -1, -3, -1],
        [-4, -1, -1, -1, -1, -3, -3, -1, -1, -3, -1, -2, -2, -2, -1],
        [-1, -4, -1, -1, -1, -3, -1, -3, -3, -1, -2, -1, -2, -2, -1],
        [-1, -1, -4, -1, -3, -1, -3, -1, -3, -1, -2, -2, -1, -2, -1],
        [-1, -1, -1, -4, -3, -1, -1, -3, -1, -3, -2, -2, -2, -1, -1],
        [-2, -2, -2, -2, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1],
    ]
)
OTHER = -4
MATRICES = {"degmatch": DEGMATCH, "dnafull": NUC44, "nuc44": NUC44}
#: Cells of moves that a traceback keeps at a time; beyond that it makes them again from rows kept on the way.
CELLS = 1 << 24


def _codes(seq: str) -> np.ndarray:
    table = np.full(256, len(LETTERS))
    for i, c in enumerate(LETTERS):
        table[ord(c)] = table[ord(c.lower())] = i
    return table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def _matrix(name: str) -> np.ndarray:
    m = np.full((len(LETTERS) + 1, len(LETTERS) + 1), OTHER, np.int64)
    m[:-1, :-1] = MATRICES[name]
    return m


def align(query: str, subject: str, gap_open: int = 10, gap_extend: int = 1, matrix: str = "degmatch", trace: bool = True, end_gaps: bool = True) -> dict:
    """The best alignment of whole sequences in which gaps at either end of either are free.

    A gap of n letters costs gap_open + (n - 1) * gap_extend. Of equal ends the
    one in the last row of the query comes first, then the smallest place; a
    pair is preferred to a gap. Ends are inclusive. end_gaps: whether the free
    gaps are written too, from the first letters on.
    """
    score = _matrix(matrix)
    q, s = _codes(query), _codes(subject)
    m, n = len(q), len(s)
    step = max(1, min(m, max(CELLS // (n + 1), math.isqrt(m))))
    low = np.int64(-(2**40))
    j = np.arange(n + 1, dtype=np.int64) * gap_extend

    def rows(first: int, end: int, h: np.ndarray, f: np.ndarray, move: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Rows first + 1 to end from row first. move: 1 pair, 2 gap in subject, 4 gap in query; 8, 16: these go on."""
        last = []
        for i in range(first + 1, end + 1):
            f_open, f_more = h - gap_open, f - gap_extend
            f = np.maximum(f_open, f_more)
            f[0] = low
            pair = np.full(n + 1, low)
            pair[1:] = h[:-1] + score[q[i - 1], s]
            best = np.maximum(pair, f)
            best[0] = 0
            run = np.maximum.accumulate(best + j)
            e = np.full(n + 1, low)
            e[1:] = run[:-1] - gap_open - j[1:] + gap_extend
            h = np.maximum(best, e)
            h[0] = 0
            last.append(int(h[n]))
            if move is not None:
                row = move[i - first]
                row[:] = np.where(h == pair, 1, np.where(h == f, 2, 4))
                row[f_more > f_open] |= 8
                row[1:][(e[1:] == e[:-1] - gap_extend) & (e[1:] > h[:-1] - gap_open)] |= 16
        return h, f, last

    h, f = np.zeros(n + 1, np.int64), np.full(n + 1, low)
    last, kept, move, base = [0], [], None, 0
    for first in range(0, m, step):
        kept.append((h, f))
        move, base = (np.zeros((min(step, m - first) + 1, n + 1), np.uint8) if trace else None), first
        h, f, more = rows(first, min(m, first + step), h, f, move)
        last += more
    if not m or not n:
        return {"alnscore": 0, "q_beg": 0, "q_end": m - 1, "s_beg": 0, "s_end": n - 1, "npositive": 0, "nnegative": 0, "cigar": "", "qseq": "", "sseq": "", "aln_len": 0}
    column = int(np.argmax(last))
    end = int(np.argmax(h))
    i, k = (m, end) if h[end] >= last[column] else (column, n)
    out = {"alnscore": int(max(h[end], last[column])), "q_end": i - 1, "s_end": k - 1}
    if not trace:
        return out
    ops = []
    tail = [("D", n - k)] if i == m else [("I", m - i)]
    kind = 1
    while i > 0 and k > 0:
        if i <= base or i > base + len(move) - 1:  # the row is of another part: make its moves again
            base = (i - 1) // step * step
            move = np.zeros((min(step, m - base) + 1, n + 1), np.uint8)
            rows(base, min(m, base + step), *kept[base // step], move)
        cell = move[i - base, k]
        if kind == 1:
            kind = cell & 7
        if kind == 1:
            i, k = i - 1, k - 1
            ops.append("=" if score[q[i], s[k]] > 0 else "X")
        elif kind == 2:
            kind = 2 if cell & 8 else 1
            i -= 1
            ops.append("I")
        else:
            kind = 4 if cell & 16 else 1
            k -= 1
            ops.append("D")
    head = [("I", i), ("D", k)]
    runs = [(x[0], len(x)) for x in re.findall(r"=+|X+|I+|D+", "".join(reversed(ops)))]
    begin = (i, k)
    if end_gaps:
        runs, begin = [r for r in (*head, *runs, *tail) if r[1]], (0, 0)
    a, b, p, r = [], [], *begin
    for op, size in runs:
        a.append(query[p : p + size] if op != "D" else "-" * size)
        b.append(subject[r : r + size] if op != "I" else "-" * size)
        p, r = p + size * (op != "D"), r + size * (op != "I")
    total = sum(size for _, size in runs)
    good, bad = (sum(size for op, size in runs if op == x) for x in "=X")
    return out | {"q_beg": begin[0], "s_beg": begin[1], "npositive": good, "nnegative": bad, "cigar": "".join(f"{size}{op}" for op, size in runs), "qseq": "".join(a), "sseq": "".join(b), "aln_len": total}


FIELDS = "alnscore int, q_beg int, q_end int, s_beg int, s_end int, npositive int, nnegative int, cigar string, qseq string, sseq string, aln_len int"


def align_function(gap_open: int = 10, gap_extend: int = 1, matrix: str = "degmatch", trace: bool = True, end_gaps: bool = True):
    """A column function (query, subject) -> struct of FIELDS."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def aligned(query: pd.Series, subject: pd.Series) -> pd.DataFrame:
        rows = [align(q or "", s or "", gap_open, gap_extend, matrix, trace, end_gaps) for q, s in zip(query, subject, strict=True)]
        return pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names)

    return aligned


def window_bounds(sstart: Column, send: Column, slen: Column, ctx: Column) -> tuple[Column, Column]:
    """First and last letter of a hit's surroundings, both inclusive."""
    return F.greatest(F.lit(0), sstart - ctx).cast("long"), F.least(send + ctx, slen - 1).cast("long")


#: Subjects up to this number are broadcast (two numbers each) to take them from the table of sequences.
FEW = 500_000


def of_hits(sequences: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """The sequences that hits name. If these are few, by their counted number, the others go in the scan, before any shuffle."""
    named = hits.select(*key).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    few = named.limit(FEW + 1).count() <= FEW
    return sequences.join(F.broadcast(named) if few else named, key, "left_semi")


def stage3(hits: DataFrame, queries: DataFrame, sequences: DataFrame, is_ratio: bool = True, ctx: float = 2.0, trace: bool = False, resolve: bool = True, min_ppositive: float = 0.0, min_npositive: int = 0, **how) -> DataFrame:
    """hits(qseqid, strand, volume, oid, ..., sstart, send) with alignments; sequences are joined on (volume, oid).

    Each hit is aligned with its query (reversed on the minus strand, whose
    query places are then those of the reversed query) in its surroundings.
    Hits of the same query, subject and strand that overlap are resolved (see
    `resolve_group`). Of queries with one id the greatest text counts.
    """
    q = queries.groupBy("qseqid").agg(F.max("seq").alias("_q"))
    s = of_hits(sequences, hits, ["volume", "oid"]).select("volume", "oid", F.col("seq").alias("_s"), F.col("slen").alias("_n"))
    df = hits.join(q, "qseqid").join(s, ["volume", "oid"])
    first, last = window_bounds(F.col("sstart"), F.col("send"), F.col("_n"), context(F.length("_q"), is_ratio, ctx))
    df = df.withColumn("_first", first).withColumn("_last", last).withColumn("_part", subsequence(F.col("_s"), F.col("_first"), F.col("_last"))).drop("_s")
    df = df.where(F.length("_part") > 0).withColumn("_q", F.when(F.col("strand") == "-", reverse_complement(F.col("_q"))).otherwise(F.col("_q")))
    df = df.withColumn("a", align_function(trace=trace, **how)("_q", "_part"))
    for name in ("alnscore", "npositive", "nnegative", "cigar", "qseq", "sseq"):
        df = df.withColumn(name, F.col(f"a.{name}"))
    df = df.withColumn("qend", F.col("a.q_end")).withColumn("send", (F.col("_first") + F.col("a.s_end")).cast("int"))
    if trace:
        df = df.withColumn("qstart", F.col("a.q_beg")).withColumn("sstart", (F.col("_first") + F.col("a.s_beg")).cast("int"))
    df = df.withColumn("ppositive", F.when(F.col("a.aln_len") > 0, 100.0 * F.col("npositive") / F.col("a.aln_len")).otherwise(F.lit(0.0)))
    columns = [*hits.columns, *[c for c in ("qstart", "qend", "alnscore", "npositive", "nnegative", "ppositive", "cigar", "qseq", "sseq") if c not in hits.columns]]
    if resolve and ctx > 0:
        df = _resolved(df, columns, trace, how)
    df = df.select(*columns)
    if trace:
        df = df.where((F.col("ppositive") >= min_ppositive) & (F.col("npositive") >= min_npositive))
    return df


def room(start: int, end: int, window: tuple[int, int], taken: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The part of a subject that is left to a hit from start to end beside the stretches taken (disjoint, by place); None if there is none.

    A hit that overlaps nothing keeps its place. One that begins on free ground has what lies between
    its neighbours there; one that begins within a taken stretch, but not with it, has what follows that stretch.
    """
    at = bisect.bisect_right(taken, (start, math.inf))
    before = taken[at - 1] if at else (-1, -1)
    after = taken[at][0] if at < len(taken) else math.inf
    if before[1] >= start:
        low, high = before[1] + 1, min(window[1], after - 1)
        return (low, int(high)) if before[0] < start and low < end and low < high else None
    if after > end:
        return start, end
    low = max(window[0], before[1] + 1)
    return (low, int(after) - 1) if low < after - 1 else None


def resolve_group(rows: list[dict], trace: bool, how: dict) -> list[dict]:
    """Hits of one query, subject and strand, made disjoint: the strongest takes its place first, and each further one
    is aligned again in the room that is left to it in its surroundings, or goes. rows hold _q, _part, _first and _last.
    """
    taken: list[tuple[int, int]] = []
    kept = []
    for r in sorted(rows, key=lambda r: (-r["chainscore"], r["sstart"], r["send"])):
        free = room(r["sstart"], r["send"], (r["_first"], r["_last"]), taken)
        if free is None:
            continue
        if free != (r["sstart"], r["send"]):
            low, high = free
            a = align(r["_q"], r["_part"][low - r["_first"] : high + 1 - r["_first"]], trace=trace, **how)
            r = r | {"alnscore": a["alnscore"], "qend": a["q_end"], "sstart": max(r["sstart"], low), "send": low + a["s_end"]}
            if trace:
                share = 100.0 * a["npositive"] / a["aln_len"] if a["aln_len"] else 0.0
                r |= {"qstart": a["q_beg"], "sstart": low + a["s_beg"], "ppositive": share, **{c: a[c] for c in ("npositive", "nnegative", "cigar", "qseq", "sseq")}}
            if r["send"] < r["sstart"]:
                continue
        bisect.insort(taken, (r["sstart"], r["send"]))
        kept.append(r)
    return sorted(kept, key=lambda r: r["sstart"])


def _resolved(df: DataFrame, columns: list[str], trace: bool, how: dict) -> DataFrame:
    """Only groups of several hits go through Python, with their surroundings; hits that are alone pass by."""
    group = ["qseqid", "volume", "oid", "strand"]
    df = df.withColumn("_size", F.count("*").over(Window.partitionBy(*group)))
    more = df.where("_size > 1").select(*columns, "_q", "_part", "_first", "_last")
    schema = more.select(*columns).schema

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = resolve_group(f.to_dict("records"), trace, how)
        return pd.DataFrame([[r[c] for c in columns] for r in rows], columns=columns).astype({c: f[c].dtype for c in columns})

    return df.where("_size = 1").select(*columns).unionByName(more.groupBy(*group).applyInPandas(run, schema))
