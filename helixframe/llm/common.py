"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that stands for a null doc_id inside an operator; it sorts before all others.
NULL_ID = -(2**63)
#: Characters that separate words: space and \t \n \v \f \r.
SPACES = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in one process (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


#: Folders that `save` has written and nothing has deleted.
_SAVED: list[str] = []


def drop(*tables: DataFrame | None) -> None:
    """Delete saved tables that nothing reads any more; others are left alone."""
    for t in tables:
        if getattr(t, "saved_at", None) in _SAVED:
            _delete(t.sparkSession, [t.saved_at])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _SAVED.remove(name)


def alone(spark: SparkSession, make, name: str) -> DataFrame:
    """save(make()), and then delete what make has saved on the way."""
    before = set(_SAVED)
    out = save(make(), name)
    _delete(spark, [p for p in _SAVED if p not in before and p != out.saved_at])
    return out


def ids(column: str = "doc_id") -> Column:
    """doc_id with a place for null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_ids() -> Column:
    """doc_id; for a null one a hash of the text, so that different texts are different documents.

    These hashes are below -2**62 and so sort before doc_ids, which are expected above.
    """
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**62 - 1))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID) + own)


def doc_id_of(column: Column) -> Column:
    """The doc_id that a value of text_ids() stands for."""
    return F.when(column >= -(2**62), column)


def real_id(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
