"""A training-corpus pipeline over `documents`: each stage calls one operator of helixframe.llm.

Stages keep whole rows (all columns, whatever their names) and decide by doc_id
and text only. A null doc_id is a document like any other. Empty tables pass
through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import op08_langid
from helixframe.llm.common import alone, drop, ids, table, text_ids
from helixframe.llm.op01_minhash import grouped
from helixframe.llm.op02_decontam import contaminated_texts
from helixframe.llm.op07_mixing import default_weights, domain_of, mix
from helixframe.llm.op10_sharding import ring_shards

#: A text is of no learned language if the model has met less than this share of its n-grams in training.
MIN_KNOWN = 0.5


def _packed(docs: DataFrame, id: Column | None = None) -> DataFrame:
    """Whole rows beside what stages join by, so that no column of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (ids() if id is None else id).alias("id"), F.xxhash64("text").alias("sum"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no learned language: those of which less than MIN_KNOWN of the n-grams came in any training text.

    Texts that mix learned languages, which no single language fits, stay.
    """
    model = op08_langid.train(docs.select("doc_id", "text", "lang"), ~op08_langid.held_out())
    if model is None:  # nothing to learn from, nothing to reject by
        return docs
    judged = op08_langid.predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("known") >= MIN_KNOWN)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates, once; documents without words are no group. Texts without a doc_id come before all others."""
    gone = grouped(docs).where("not kept").select("id").distinct()
    kept = _packed(docs, text_ids()).join(gone, "id", "left_anti")
    # a repeated row has the same doc_id and text; rows are together by id already
    return kept.dropDuplicates(["id", "sum"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item or a long enough passage of one."""
    gone = contaminated_texts(docs, table(spark, sf_dir, "benchmark")).select("id", "sum").distinct()
    # a null text has another checksum in _packed, but holds nothing
    return _packed(docs).join(gone, ["id", "sum"], "left_anti").select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture does: not at all, once, or once more for each further epoch."""
    taken = mix(docs, domain_of(F.col("source")), default_weights()).where("copies > 0").groupBy(ids().alias("id"), "sum").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ids().alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("sum"))
    return rows.join(taken, ["id", "sum"]).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all that is left: doc_id, size, text_crc32, shard, slot."""
    return ring_shards(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("sharding", sharding)]
#: No SQL: a trained classifier and sketches decide. tests/llm holds each stage's kept rows against a plain version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before has written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, alone(spark, lambda f=stage, d=docs: f(spark, d, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
