"""Searches with primer pairs: what two primers frame is found as one chain across the insert."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from helixframe.functions import settings
from helixframe.operators import primers
from helixframe.operators.index import Index
from helixframe.plans.search import SearchConfig, search


def configured(pairs: DataFrame, insert: int, score: float = 0.5, add: int = 1, config: SearchConfig = SearchConfig(), max_gap: int | None = None) -> SearchConfig:
    """The settings of a search with pairs(fwd_positions, rev_positions): stage-1 threshold from score, chain minimum from the longer primer and add, gaps up to the insert unless given."""
    places = [(r.fwd_positions, r.rev_positions) for r in pairs.select("fwd_positions", "rev_positions").distinct().collect()]  # numbers up to the primers' length
    share, number = settings.primer_threshold(score, places)
    least = settings.primer_chain_minimum(add, places)
    return replace(config, min_score=number if share is None else share, every_place=share == 1, chain_minimum=least, max_gap=insert if max_gap is None else max_gap)


def search_primers(indexes: list[Index], primer_table: DataFrame, insert: int, score: float = 0.5, add: int = 1, config: SearchConfig = SearchConfig(), max_gap: int | None = None, accessions: DataFrame | None = None, exclude: bool = False) -> DataFrame:
    """primers(ord, id, seq), rows 2i and 2i + 1 a pair -> hits as `search` gives them, of queries named `forward__+__reverse`.

    Raises ValueError for primers that `operators.primers.pairs` refuses and thresholds that a pair cannot reach.
    """
    m = indexes[0].meta
    pairs = primers.pairs(primer_table, insert, m.k, m.span, m.template)
    queries = pairs.selectExpr("qseqid", "seq", "pair as ord")
    return search(indexes, queries, configured(pairs, insert, score, add, config, max_gap), accessions, exclude)
