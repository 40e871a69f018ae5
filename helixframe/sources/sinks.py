"""Writers of hits: tab-separated, JSON grouped by query, SAM, BAM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.plans.search import columns

VERSION = "1"


def shape(hits: DataFrame) -> list[str]:
    """The public columns of a table of hits, in order."""
    matches = "matchscore" in hits.columns
    mode = 3 if "alnscore" in hits.columns else 2 if "chainscore" in hits.columns else 1
    return columns(mode, matches, "cigar" in hits.columns)


def tsv_rows(hits: DataFrame) -> DataFrame:
    return hits.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in shape(hits)]).alias("value"))


def _headed(rows: DataFrame, head: str) -> DataFrame:
    def headed(frames):
        yield pd.DataFrame({"value": [head]})
        yield from frames

    return rows.mapInPandas(headed, "value string")


def tsv(hits: DataFrame, path: str) -> None:
    """Text files, each with the header."""
    _headed(tsv_rows(hits), "# " + "\t".join(shape(hits))).write.mode("overwrite").text(path)


def json_rows(hits: DataFrame) -> DataFrame:
    """(qseqid, value): a JSON object for each query, its hits by rank of score, subject and place."""
    names = [c for c in shape(hits) if c != "qseqid"]
    order = [F.col(c) for c in ("volume", "sseqid", "sstrand") if c in hits.columns]
    best = next(c for c in ("alnscore", "chainscore", "coverscore", "matchscore") if c in hits.columns)
    ranked = F.struct((-F.col(best)).alias("r"), *order, F.struct(*names).alias("hit"))
    grouped = hits.groupBy("qseqid").agg(F.array_sort(F.collect_list(ranked)).alias("h"))
    return grouped.select("qseqid", F.to_json(F.struct("qseqid", F.transform("h", lambda x: x["hit"]).alias("hits"))).alias("value"))


def json(hits: DataFrame, path: str) -> None:
    """A JSON object a line, one for each query."""
    json_rows(hits).select("value").write.mode("overwrite").text(path)


def sam_header(hits: DataFrame) -> DataFrame:
    """Header lines: a sequence line for each subject, by name."""
    spark = hits.sparkSession
    first = spark.createDataFrame([(0, "", "@HD\tVN:1.6\tSO:unsorted"), (2, "", f"@PG\tID:helixframe\tVN:{VERSION}")], "part int, name string, value string")
    names = hits.groupBy("sseqid").agg(F.max("slen").alias("slen")).select(F.lit(1).alias("part"), F.col("sseqid").alias("name"), F.format_string("@SQ\tSN:%s\tLN:%d", "sseqid", "slen").alias("value"))
    return first.union(names)


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:i:"), value.cast("string"))


def sam_rows(hits: DataFrame) -> DataFrame:
    """Alignment lines; needs a traceback. Quality is unknown (255), and places count from 1."""
    if "cigar" not in hits.columns:
        raise ValueError("SAM needs alignments with a traceback")
    zero = F.lit(0)
    cover, match = (F.col(c) if c in hits.columns else zero for c in ("coverscore", "matchscore"))
    fields = [
        F.col("qseqid").cast("string"), F.when(F.col("sstrand") == "-", "16").otherwise("0"), F.col("sseqid"), (F.col("sstart") + 1).cast("string"), F.lit("255"), F.col("cigar"),
        F.lit("*"), F.lit("0"), F.lit("0"), F.regexp_replace("qseq", "-", ""), F.lit("*"),
        _tag("AS", F.col("alnscore")), _tag("NM", F.col("nnegative")), _tag("cs", F.col("chainscore")), _tag("cv", cover), _tag("ms", match),
    ]
    return hits.select(F.concat_ws("\t", *fields).alias("value"))


def sam(hits: DataFrame, path: str) -> None:
    """path/header and path/body, text; `merge_sam` joins such folders, and header then body is a SAM file."""
    sam_header(hits).orderBy("part", "name").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    sam_rows(hits).write.mode("overwrite").text(f"{path}/body")


def merge_sam(spark, paths: list[str], out: str) -> None:
    """Bodies one after another under the union of the headers."""
    head = spark.read.text([f"{p}/header" for p in paths]).distinct()
    rank = F.when(F.col("value").startswith("@HD"), 0).when(F.col("value").startswith("@SQ"), 1).otherwise(2)
    head.orderBy(rank, "value").coalesce(1).write.mode("overwrite").text(f"{out}/header")
    spark.read.text([f"{p}/body" for p in paths]).write.mode("overwrite").text(f"{out}/body")


def merge_tsv(spark, paths: list[str], out: str) -> None:
    """Rows of several tables under one header. Raises ValueError where headers differ."""
    lines = spark.read.text(paths)
    heads = [r.value for r in lines.where(F.col("value").startswith("# ")).distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("the tables have different headers")
    _headed(lines.where(~F.col("value").startswith("# ")), heads[0]).write.mode("overwrite").text(out) if heads else lines.write.mode("overwrite").text(out)


def merge_json(spark, paths: list[str], out: str) -> None:
    """Objects of several files, a line for each query."""
    spark.read.text(paths).write.mode("overwrite").text(out)


def merge(spark, paths: list[str], out: str, kind: str = "tab") -> None:
    if kind == "bam":
        raise ValueError("merge SAM files, or write the hits of all as one BAM file")
    check(kind)
    {"tab": merge_tsv, "json": merge_json, "sam": merge_sam}[kind](spark, paths, out)


def bam(hits: DataFrame, path: str) -> None:
    """path/alignments.bam."""
    from helixframe.sources import bam as packed

    packed.write(hits, path)


WRITERS = {"tab": tsv, "json": json, "sam": sam, "bam": bam}


def check(kind: str, mode: int = 3, trace: bool = True) -> None:
    """Whether a search of this mode can be written so, to be asked before it runs."""
    if kind not in WRITERS:
        raise ValueError(f"no format {kind!r}; there are {', '.join(WRITERS)}")
    if kind in ("sam", "bam") and (mode != 3 or not trace):
        raise ValueError(f"{kind.upper()} needs mode 3 with a traceback")


def write(hits: DataFrame, path: str, kind: str = "tab") -> None:
    check(kind, 3, "cigar" in hits.columns)
    WRITERS[kind](hits, path)
