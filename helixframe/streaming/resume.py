"""Searches over query files as they arrive, with resumption.

Structured Streaming keeps which files are done; each micro-batch writes its hits
to a folder named by its id, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.index import Index, _text
from helixframe.plans.search import SearchConfig, search


def stream(spark: SparkSession, queries: str, indexes: list[Index], out: str, checkpoint: str, config: SearchConfig = SearchConfig(), files: int = 1):
    """Search Parquet files of (qseqid, seq) under `queries`, so many a batch; returns the started query.

    Each batch writes out/hits/batch=n and then out/done/batch=n, the ids it has searched, with hits or without.
    Raises ValueError where `out` was begun with other settings or other indexes.
    """
    begun = f"{out}/settings"
    settings = f"{config} {[i.meta for i in indexes]}"
    known = _text(spark, begun)
    if known not in (None, settings):
        raise ValueError(f"{out} was begun with {known}")
    if known is None:
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.text(begun)
    source = spark.readStream.schema("qseqid string, seq string").option("maxFilesPerTrigger", files).parquet(queries)

    def batch(df: DataFrame, number: int) -> None:
        search(indexes, df, config).write.mode("overwrite").parquet(f"{out}/hits/batch={number}")
        df.select("qseqid").distinct().write.mode("overwrite").parquet(f"{out}/done/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """Hits of the batches that are done."""
    done = spark.read.option("basePath", f"{out}/done").parquet(f"{out}/done").select("batch").distinct()
    return spark.read.parquet(f"{out}/hits").join(done, "batch", "left_semi").drop("batch")


def done(spark: SparkSession, out: str) -> DataFrame:
    """(qseqid) of all queries that have been searched."""
    return spark.read.parquet(f"{out}/done").select("qseqid").distinct()


def remaining(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries of which no batch has been written; done(qseqid) lists those searched, with hits or without."""
    return queries.join(done.select("qseqid").distinct(), "qseqid", "left_anti")


def signature(config: SearchConfig, queries: DataFrame) -> str:
    """What must be the same for a resumption: settings and queries."""
    sums = queries.agg(F.count("*"), F.bit_xor(F.xxhash64("qseqid", "seq"))).first()
    return f"{config}|{sums[0]}|{sums[1]}"
