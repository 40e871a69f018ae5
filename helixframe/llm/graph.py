"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import drop, save


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (id, component) for every id that has an edge; component is the smallest id reachable.

    Each round is two joins against minima that are combined map-side, so a hub
    with a third of all edges never meets in one task, and the edges of each
    round are a table in the shared folder. No edges: no rows.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = save(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, large.a == least.k)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("k", "m")).where("a <> b").distinct()
        before, edges = edges, save(small, "small")
        drop(before, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = now
