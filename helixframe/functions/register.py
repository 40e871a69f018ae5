"""The engine's functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixframe.functions import kmers, seeds
from helixframe.operators.align import align_function
from helixframe.operators.stages import chain_function

_ROWS = "array<struct<pos:int,kmer:bigint>>"


def _rows(at: list[int], seq: str | None, expand: int) -> list[dict]:
    pos, kmer = kmers.scan((seq or "").encode(), at, expand)
    return [{"pos": int(p), "kmer": int(x)} for p, x in zip(pos, kmer, strict=True)]


def register(spark: SparkSession) -> None:
    """kmers(seq, k, expand), spaced_kmers(seq, k, span, template, expand), sg_align(query, subject), chain(hits, min_score) with a span of 11."""

    @F.pandas_udf(_ROWS)
    def plain(seq: pd.Series, k: pd.Series, expand: pd.Series) -> pd.Series:
        return pd.Series([_rows(seeds.offsets(int(n)), s, int(e)) for s, n, e in zip(seq, k, expand, strict=True)])

    @F.pandas_udf(_ROWS)
    def spaced(seq: pd.Series, k: pd.Series, span: pd.Series, template: pd.Series, expand: pd.Series) -> pd.Series:
        return pd.Series([_rows(seeds.offsets(int(n), int(w), t), s, int(e)) for s, n, w, t, e in zip(seq, k, span, template, expand, strict=True)])

    for name, f in (("kmers", plain), ("spaced_kmers", spaced), ("sg_align", align_function()), ("chain", chain_function(11))):
        spark.udf.register(name, f)
