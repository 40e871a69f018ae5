"""Primer pairs as queries: the forward primer, N's for the insert, and the reverse complement of the reverse primer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kmers, seeds
from helixframe.functions.alphabet import reverse_complement


def pairs(primers: DataFrame, insert: int, k: int, span: int = 0, template: str = seeds.CONTIGUOUS) -> DataFrame:
    """primers(ord, id, seq), rows 2i and 2i + 1 a pair -> (pair, qseqid, seq, fwd_positions, rev_positions).

    Raises ValueError for an odd or empty table, an insert shorter than k, and primers shorter than k.
    """
    at = seeds.offsets(k, span, template)
    if insert < k:
        raise ValueError("the insert is shorter than k")
    n, short = primers.agg(F.count("*"), F.count_if(F.length("seq") < k)).first()
    if not n or n % 2:
        raise ValueError(f"primers come in pairs, not {n}")
    if short:
        raise ValueError(f"{short} primers are shorter than k")

    @F.pandas_udf("int")
    def places(seq: pd.Series) -> pd.Series:  # plain windows only, as searches do not count N's towards primers
        return seq.map(lambda s: len(set(kmers.scan(s.encode(), at)[0].tolist())))

    one = primers.select(F.expr("ord div 2").alias("pair"), (F.col("ord") % 2).alias("second"), "id", F.upper("seq").alias("seq"))
    pick = lambda c, second: F.max(F.when(F.col("second") == second, F.col(c)))
    both = one.groupBy("pair").agg(pick("id", 0).alias("f"), pick("seq", 0).alias("fs"), pick("id", 1).alias("r"), pick("seq", 1).alias("rs"))
    both = both.withColumn("rc", reverse_complement(F.col("rs")))
    return both.select("pair", F.concat_ws("__+__", "f", "r").alias("qseqid"), F.concat("fs", F.repeat(F.lit("N"), insert), "rc").alias("seq"), places("fs").alias("fwd_positions"), places("rc").alias("rev_positions"))
