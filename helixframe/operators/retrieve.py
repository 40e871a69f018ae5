"""Subsequences of hits, from a table of sequences or, as a plan of requests, from a remote service."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.alphabet import reverse_complement, subsequence
from helixframe.functions.settings import parse_context
from helixframe.operators.align import of_hits
from helixframe.sources.texts import accession, parse_fasta

GROUPS = 4096

#: A public service's address and parameters. Fixed values.
SERVICE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"


def local(hits: DataFrame, sequences: DataFrame, context: Column | int = 0, bases_only: bool = False) -> DataFrame:
    """hits(qseqid, sseqid, sstrand, sstart, send, ...) -> (sseqid, qseqid, sstrand, first, last, score, seq), ends inclusive.

    Of sequences with one accession the last (volume, oid) counts. Minus hits
    are reverse complemented; bases_only leaves other letters than ACGT there as they are.
    """
    if "sstart" not in hits.columns:
        raise ValueError("hits without starts can't be retrieved")
    ctx = context if isinstance(context, Column) else F.lit(context)
    named = of_hits(sequences.withColumnRenamed("accession", "sseqid"), hits, ["sseqid"])  # before any text is shuffled
    whole = named.groupBy("sseqid").agg(F.max_by("seq", F.struct("volume", "oid")).alias("_s"))
    df = hits.join(whole, "sseqid")
    first = F.greatest(F.lit(0), F.col("sstart") - ctx).cast("long")
    last = F.least(F.col("send") + ctx, F.length("_s") - 1).cast("long")
    part = subsequence(F.col("_s"), first, last)
    turned = F.when(F.col("sstrand") == "-", reverse_complement(part, bases_only)).otherwise(part)
    score = F.col("chainscore") if "chainscore" in hits.columns else F.lit(0)
    return df.where(first <= last).select("sseqid", "qseqid", "sstrand", first.alias("first"), last.alias("last"), score.alias("score"), turned.alias("seq"))


def missing(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    return hits.select("sseqid").distinct().join(sequences.select(F.col("accession").alias("sseqid")), "sseqid", "left_anti")


def fasta(parts: DataFrame) -> DataFrame:
    """Retrieved rows as FASTA text, a record a row, lines of 70 letters."""
    head = F.concat(F.lit(">"), "sseqid", F.lit(" query="), "qseqid", F.lit(" strand="), "sstrand", F.lit(" range="), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(" score="), F.col("score").cast("string"))
    return parts.select(F.concat(head, F.lit("\n"), F.regexp_replace("seq", "(.{70})(?=.)", "$1\n")).alias("value"))


def remote_context(hits: DataFrame, text: str) -> int:
    """The surroundings that a remote plan asks for: as given, or that ratio of the longest query among the hits."""
    is_ratio, value = parse_context(text)
    return int((hits.agg(F.max("qlen")).first()[0] or 0) * value) if is_ratio else int(value)


def remote_plan(hits: DataFrame, context: int = 0, batch: int = 100, threshold: int = 100_000, key: str = "") -> DataFrame:
    """(url, accessions): batches of whole sequences, and a range for each hit of those whose last end is beyond the threshold.

    All batches but one are full. Accessions are numbered by GROUPS hash groups, so that no task ranks them all.
    """
    seen = hits.groupBy("sseqid").agg((F.max("send") + 1 > threshold).alias("long"))
    tail = f"&api_key={key}" if key else ""
    base = F.lit(f"{SERVICE}?db=nuccore&rettype=fasta&retmode=text&id=")
    short = seen.where("not long").withColumn("g", (F.conv(F.substring(F.md5("sseqid"), 1, 4), 16, 10).cast("int") % GROUPS))
    sizes = short.groupBy("g").agg(F.count("*").alias("n"))
    before = sizes.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))  # GROUPS rows at most
    rank = F.row_number().over(Window.partitionBy("g").orderBy("sseqid")) - 1
    short = short.withColumn("rank", rank).join(F.broadcast(before), "g").withColumn("b", F.floor((F.col("before") + F.col("rank")) / batch))
    batches = short.groupBy("b").agg(F.array_sort(F.collect_list("sseqid")).alias("accessions")).select(F.concat(base, F.concat_ws(",", "accessions"), F.lit(tail)).alias("url"), "accessions")
    ranged = hits.join(seen.where("long").select("sseqid"), "sseqid", "left_semi")
    first, last = F.greatest(F.lit(0), F.col("sstart") - context) + 1, F.col("send") + context + 1
    ranges = ranged.select(F.concat(base, "sseqid", F.lit("&seq_start="), first.cast("long").cast("string"), F.lit("&seq_stop="), last.cast("long").cast("string"), F.lit(tail)).alias("url"), F.array("sseqid").alias("accessions")).distinct()
    return batches.unionByName(ranges)


def fetch(plan: DataFrame, get, retries: int = 3, wait: float = 0.334, timeout: int = 30) -> DataFrame:
    """(url, accessions) -> (url, body, error): each request sent by one task, so many seconds apart; get(url, timeout) -> (status, text).

    A request that raises, or is answered with 429 or a status from 500, is sent again, each
    time twice as long after; other statuses than 200 are errors at once. A request that
    fails has a null body and says why, and the others go on.
    """

    def run(frames):
        due = 0.0
        for f in frames:
            out = []
            for url in f["url"]:
                body, error = None, None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + wait * 2**attempt
                    try:
                        status, text = get(url, timeout)
                    except OSError as e:
                        error = str(e)
                        continue
                    body, error = (text, None) if status == 200 else (None, f"status {status}")
                    if status != 429 and status < 500:
                        break
                out.append((url, body, error))
            yield pd.DataFrame(out, columns=["url", "body", "error"])

    return plan.select("url").coalesce(1).mapInPandas(run, "url string, body string, error string")


def over_http(url: str, timeout: int) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


def records(fetched: DataFrame) -> DataFrame:
    """(url, body) of FASTA answers -> (accession, seq)."""
    parts = fetched.where("body is not null").select(F.explode(F.split(F.concat(F.lit("\n"), "body"), "\n>")).alias("value")).where("trim(value) <> ''").withColumn("ord", F.lit(0))
    return parse_fasta(parts).select(accession(F.col("id")).alias("accession"), "seq")
