"""From query sequences to the k-mers that are searched, with a threshold for each query and strand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kmers, seeds
from helixframe.functions.alphabet import is_degenerate, reverse_complement

KEY = ["qseqid", "strand"]


def skip_degenerate(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries of plain letters, those that are skipped)."""
    return queries.where(~is_degenerate(F.col("seq"))), queries.where(is_degenerate(F.col("seq")))


def query_kmers(queries: DataFrame, k: int, span: int = 0, template: str = seeds.CONTIGUOUS, expand: int = 16, strand: int = 2) -> DataFrame:
    """queries(qseqid, seq) -> (qseqid, strand, q_pos, kmer), one row each.

    On the minus strand a window keeps its place in the query as given: its
    k-mer is that of the window's reverse complement.
    """
    if not 0 <= expand <= 256:
        raise ValueError("a search expands up to 256 k-mers a window")
    at, width = seeds.offsets(k, span, template), seeds.window(k, span)
    queries = queries.select("qseqid", F.upper("seq").alias("seq"))
    parts = []
    if strand >= 1:
        parts.append(kmers.kmers(queries, ["qseqid"], "seq", at, expand, pos="q_pos").select("qseqid", F.lit("+").alias("strand"), "q_pos", "kmer"))
    if strand in (-1, 2):
        turned = queries.select("qseqid", F.length("seq").alias("qlen"), reverse_complement(F.col("seq")).alias("seq"))
        turned = kmers.kmers(turned, ["qseqid", "qlen"], "seq", at, expand, pos="p")
        parts.append(turned.select("qseqid", F.lit("-").alias("strand"), (F.col("qlen") - F.col("p") - width).cast("int").alias("q_pos"), "kmer"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def skipped_windows(queries: DataFrame, k: int, span: int = 0, template: str = seeds.CONTIGUOUS, expand: int = 16) -> DataFrame:
    """(qseqid, has_multi_degen): whether a window of a query stands for too many k-mers to be searched."""
    at = seeds.offsets(k, span, template)

    @F.pandas_udf("boolean")
    def skips(seq: pd.Series) -> pd.Series:
        return seq.map(lambda s: kmers.skips((s or "").encode(), at, expand))

    return queries.select("qseqid", skips("seq").alias("has_multi_degen"))


def high_frequency(qk: DataFrame, counts: DataFrame, excluded: DataFrame, threshold: int | None) -> DataFrame:
    """Query k-mers that a search leaves out; none where filtering is off (no threshold), whatever the build left out."""
    if threshold is None:
        return qk.select("kmer").limit(0)
    out = counts.where(F.col("n") > threshold).select("kmer").union(excluded.select("kmer"))
    return out.join(qk.select("kmer").distinct(), "kmer", "left_semi").distinct()


def thresholds(qk: DataFrame, high: DataFrame, share: float | None, number: int, chain_minimum: int = 0) -> DataFrame:
    """(qseqid, strand, n_kmers, n_high, threshold, min_chain).

    n_kmers: places with a k-mer; n_high: places all of whose k-mers are left
    out. A share gives max(0, ceil(n_kmers * share) - n_high), and 0 drops the
    strand. Without a chain minimum the threshold is that too.
    """
    marked = qk.join(high.withColumn("high", F.lit(True)), "kmer", "left")
    places = marked.groupBy(*KEY, "q_pos").agg(F.min(F.coalesce("high", F.lit(False))).alias("high"))
    out = places.groupBy(*KEY).agg(F.count("*").alias("n_kmers"), F.count_if("high").alias("n_high"))
    if share:
        threshold = F.greatest(F.lit(0), F.ceil(F.col("n_kmers").cast("double") * F.lit(float(share))) - F.col("n_high"))
    else:
        threshold = F.lit(number)
    out = out.withColumn("threshold", threshold.cast("long"))
    return out.withColumn("min_chain", F.lit(chain_minimum).cast("long") if chain_minimum else F.col("threshold"))
