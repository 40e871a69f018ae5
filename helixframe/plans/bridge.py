"""The driver's tables as sequences and queries: letters of texts become bases.

Letter number i (a = 0, case ignored) is base i modulo 4 of ACGT; all else goes.
The second bridge keeps four degenerate letters, for j, q, x and z.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[i % 4] for i in range(26))
CODES = "".join({"j": "R", "q": "Y", "x": "S", "z": "N"}.get(c, b) for c, b in zip(LETTERS, BASES, strict=True))


def dna(text: Column, codes: bool = False) -> Column:
    to = CODES if codes else BASES
    return F.regexp_replace(F.translate(text, LETTERS + LETTERS.upper(), to + to), "[^ACGTRYSN]" if codes else "[^ACGT]", "")


def dna_sql(text: str, codes: bool = False) -> str:
    to, keep = (CODES, "ACGTRYSN") if codes else (BASES, "ACGT")
    return f"regexp_replace(translate({text}, '{LETTERS + LETTERS.upper()}', '{to + to}'), '[^{keep}]', '', 'g')"


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table in fewer partitions than there are cores, such as one small file, dealt out; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def sequences(spark: SparkSession, sf_dir: str, codes: bool = False) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return d.select((F.col("doc_id") % 2).cast("int").alias("volume"), F.col("doc_id").alias("oid"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"), dna(F.col("text"), codes).alias("seq")).withColumn("slen", F.length("seq"))


def queries(spark: SparkSession, sf_dir: str, codes: bool = False) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("qseqid"), dna(F.col("text"), codes).alias("seq"))


def scratch(spark: SparkSession) -> str:
    """A new folder for a table that a query writes and reads again: in spark.checkpoint.dir, which all executors share, or in one process a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    return f"{named.rstrip('/')}/index-{uuid.uuid4().hex}"


SEQUENCES_SQL = f"s AS (SELECT (doc_id % 2)::INT AS volume, doc_id AS oid, 'D' || doc_id AS accession, {dna_sql('text')} AS seq FROM documents)"
QUERIES_SQL = f"q AS (SELECT item_id AS qseqid, {dna_sql('text')} AS seq FROM benchmark)"
