"""Readers of text formats: FASTA, lists of sequence ids, hit tables, fetched sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.search import columns


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, seq): records in file order, id the first word, sequence in upper case; lines from `;` are comments.

    A record begins with a `>` at the start of a line; what stands before the first is left out, and so are records without an id.
    """
    read = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("ord", F.monotonically_increasing_id())
    heads = read.where("block = 0").groupBy("file").agg(F.min("ord").alias("head"))  # a row for each file
    read = read.join(heads.withColumnRenamed("file", "of"), F.col("file") == F.col("of"), "left")
    head = F.col("ord") == F.col("head")
    read = read.where(~F.coalesce(head, F.lit(False)) | F.col("value").startswith(">"))
    return parse_fasta(read.select("ord", F.when(head, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("value")))


def parse_fasta(records: DataFrame) -> DataFrame:
    """records(ord, value: what stands behind a header's `>` up to the next) -> (ord, id, seq)."""
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    ident = F.regexp_extract(lines[0], r"^\s*(\S+)", 1)
    body = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith(";"))
    return records.select("ord", ident.alias("id"), F.upper(F.regexp_replace(F.concat_ws("", body), r"\s", "")).alias("seq")).where("id <> ''")


def numbered(records: DataFrame) -> DataFrame:
    """Records with ord 0, 1, 2 ...; for query and primer files, which are small."""
    schema = "ord long, id string, seq string"

    def number(batches):
        n = 0
        for f in batches:
            f["ord"] = range(n, n + len(f))
            n += len(f)
            yield f

    return records.coalesce(1).sortWithinPartitions("ord").mapInPandas(number, schema)


def accession(ident: Column) -> Column:
    """The accession of a sequence id, up to its first point: of `gi|..|db|ACC.V|` the fourth part, else the first word."""
    first = F.regexp_extract(ident, r"^\s*>?(\S+)", 1)
    bar = F.regexp_extract(first, r"^gi\|[^|]*\|[^|]*\|([^|]+)", 1)
    return F.regexp_replace(F.when(bar != "", bar).otherwise(first), r"\..*$", "")


def fetched(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark, path).select(accession(F.col("id")).alias("accession"), "seq")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(accession): the first word of each line, without a leading `>`; blank lines and comments (#) are skipped."""
    return parse_id_list(spark.read.text(path))


def parse_id_list(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("value", r"[\r\t]", " "))
    return lines.where((text != "") & ~text.startswith("#")).select(F.regexp_extract(text, r"^>?\s*(\S+)", 1).alias("accession")).where("accession <> ''")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), ORDER)


ORDER = "little"


def parse_binary_ids(data: bytes) -> list[str]:
    """Ids of a binary list, version 5.

    A zero byte, 8 bytes of file size, 8 of the number of ids; a title (4 bytes
    of length) and a date (1); 8 bytes of the database's length and, unless that
    is 0, its date (1) and volume names (4); then ids, each a length byte (255:
    4 bytes of length follow) and text. A list that is cut off gives the ids before that.
    """
    if not data or data[0]:
        raise ValueError("not a binary id list")
    r, out = _Reader(data), []
    try:
        r.take(9)
        n = r.number(8)
        r.take(r.number(4))
        r.take(r.number(1))
        if r.number(8):
            r.take(r.number(1))
            r.take(r.number(4))
        for _ in range(n):
            size = r.number(1)
            out.append(r.take(r.number(4) if size == 255 else size).decode())
    except EOFError:
        pass
    return out


def binary_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(accession) of binary lists; a file is one task."""

    @F.pandas_udf("array<string>")
    def ids(content: pd.Series) -> pd.Series:
        return content.map(parse_binary_ids)

    return spark.read.format("binaryFile").load(path).select(F.explode(ids("content")).alias("accession"))


def _positional(n: int) -> list[str]:
    """Columns of a table without a header, by its number of fields; more than 13 need 20, of which the last is not read."""
    full = columns(3, trace=True)
    if n >= 20:
        return full
    if n >= 13:
        return [*full[:12], "volume"]
    return columns(2) if n == 12 else columns(1)


_WHOLE = {"qstart", "qend", "qlen", "sstart", "send", "slen", "coverscore", "matchscore", "chainscore", "alnscore", "npositive", "nnegative", "volume"}


def hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table as written by `sinks.tsv`: columns by its `# ` header, or by their number. Lines with fewer fields, or with letters in number fields, are left out."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("# ")).select(F.substring("value", 3, 10_000).alias("h")).distinct().limit(2).collect()
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    if len(head) > 1:
        raise ValueError("the files have different headers")
    if head:
        names = head[0].h.rstrip("\r").split("\t")
    else:
        first = rows.select(F.size("f").alias("n")).first()
        names = _positional(first.n if first else 12)
    rows = rows.where(F.size("f") >= len(names))
    typed = []
    for i, c in enumerate(names):
        value = F.regexp_replace(F.col("f")[i], "\r$", "")
        kind = "int" if c in _WHOLE else "double" if c == "ppositive" else None
        typed.append((value.try_cast(kind) if kind else value).alias(c))
    rows = rows.select(*typed)
    for c in names:
        if c in _WHOLE or c == "ppositive":
            rows = rows.where(F.col(c).isNotNull())
    return rows
