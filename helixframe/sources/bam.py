"""Alignments in the BAM format, of the SAM specification (public): a file of BGZF blocks.

Records are packed and compressed by the tasks that hold the hits and are saved as
blocks of bytes. As a BAM file is one file, the driver then copies the blocks
into it, one partition at a time, and holds no more than that.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources import sinks

#: Fixed values of the format: letters of operations and of bases by number, the end of a file, and what a block may hold.
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65280
#: The most operations that a record has room for; more go to the tag CG.
MANY = 65535
TAGS = {"AS": "alnscore", "NM": "nnegative", "cs": "chainscore", "cv": "coverscore", "ms": "matchscore"}


def block(data: bytes) -> bytes:
    """One BGZF block: a gzip member that names its own length."""
    for level in (6, 0):  # bytes that grow under compression are stored
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        if len(body) + 26 <= 1 << 16:
            break
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))


def interval_bin(start: int, end: int) -> int:
    """The smallest bin that holds [start, end): of 16 kb at level 5, each level above eight times as large."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if start >> shift == (end - 1) >> shift:
            return (8**level - 1) // 7 + (start >> shift)
    return 0


def record(name: str, ref: int, start: int, reverse: bool, cigar: str, bases: str, tags: dict[str, int]) -> bytes:
    """One alignment; start counts from 0. Raises ValueError for a name of more than 254 bytes."""
    label = name.encode() + b"\0"
    if len(label) > 255:
        raise ValueError(f"BAM has no room for the name {name!r}")
    steps = [(int(n), c) for n, c in re.findall(rf"(\d+)([{OPERATIONS}])", cigar)]
    spanned = sum(n for n, c in steps if c in "MDN=X")
    packed = [n << 4 | OPERATIONS.index(c) for n, c in steps]
    extra = b""
    if len(packed) > MANY:
        extra = b"CGBI" + struct.pack(f"<I{len(packed)}I", len(packed), *packed)
        packed = [len(bases) << 4 | OPERATIONS.index("S"), spanned << 4 | OPERATIONS.index("N")]
    codes = [max(BASES.find(c), 0) if c in BASES else 15 for c in bases.upper()] + [0]
    letters = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(bases), 2))
    values = b"".join(t.encode() + b"i" + struct.pack("<i", v) for t, v in tags.items())
    head = struct.pack("<2i2B3HI3i", ref, start, len(label), 255, interval_bin(start, start + max(spanned, 1)), len(packed), 16 * reverse, len(bases), -1, -1, 0)
    body = head + label + struct.pack(f"<{len(packed)}I", *packed) + letters + b"\xff" * len(bases) + values + extra
    return struct.pack("<I", len(body)) + body


def _packed(frames):
    held = bytearray()
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            held += record(r.name, r.ref, r.sstart, r.reverse, r.cigar, r.bases, {t: getattr(r, t) for t in TAGS})
            if len(held) >= BLOCK:
                whole = len(held) // BLOCK * BLOCK
                out.append(blocks(bytes(held[:whole])))
                del held[:whole]
        yield pd.DataFrame({"data": out})
    yield pd.DataFrame({"data": [blocks(bytes(held))] if held else []})


def _references(hits: DataFrame, path: str) -> DataFrame:
    """(ref, sseqid, slen): subjects by name, numbered from 0, saved at path as the numbers depend on the partitions of one run."""
    spark = hits.sparkSession
    names = hits.groupBy("sseqid").agg(F.max("slen").cast("int").alias("slen")).repartitionByRange("sseqid").sortWithinPartitions("sseqid")
    names.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    names = spark.read.parquet(path).select(F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND(F.lit(2**33 - 1)).alias("at"), "sseqid", "slen")
    before, firsts = 0, []
    for r in names.groupBy("part").count().orderBy("part").collect():  # a row a partition
        firsts.append((r.part, before))
        before += r["count"]
    firsts = spark.createDataFrame(firsts, "part int, before long")
    return names.join(F.broadcast(firsts), "part").select((F.col("before") + F.col("at")).cast("int").alias("ref"), "sseqid", "slen")


def _header(names: DataFrame):
    """The bytes before the records, piece by piece: the text and the list of references, each read through once."""
    first, last = "@HD\tVN:1.6\tSO:unsorted\n", f"@PG\tID:helixframe\tVN:{sinks.VERSION}\n"
    line = F.format_string("@SQ\tSN:%s\tLN:%d\n", "sseqid", "slen")
    n, size = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0))).first()
    yield b"BAM\1" + struct.pack("<I", len(first) + size + len(last)) + first.encode()
    names = names.orderBy("ref")
    for r in names.select(line.alias("line")).toLocalIterator():
        yield r.line.encode()
    yield last.encode() + struct.pack("<I", n)
    for r in names.toLocalIterator():
        label = r.sseqid.encode() + b"\0"
        yield struct.pack("<I", len(label)) + label + struct.pack("<I", r.slen)


def write(hits: DataFrame, path: str) -> None:
    """The file path/alignments.bam, in place of one that is there; needs a traceback. Without hits it has a header only.

    path/work-... holds what the tasks have packed and goes when the file is whole.
    """
    if "cigar" not in hits.columns:
        raise ValueError("BAM needs alignments with a traceback")
    spark = hits.sparkSession
    work = f"{path}/work-{uuid.uuid4().hex}"
    hits.write.parquet(f"{work}/hits")  # read twice; a search would run twice
    hits = spark.read.schema(hits.schema).parquet(f"{work}/hits")
    names = _references(hits, f"{work}/names")
    score = lambda c: (F.coalesce(F.col(c), F.lit(0)) if c in hits.columns else F.lit(0)).cast("int")
    rows = hits.join(names.select("ref", "sseqid"), "sseqid").select(
        F.col("qseqid").cast("string").alias("name"), "ref", F.col("sstart").cast("int").alias("sstart"), (F.col("sstrand") == "-").alias("reverse"), "cigar",
        F.regexp_replace("qseq", "-", "").alias("bases"), *[score(c).alias(t) for t, c in TAGS.items()],
    )
    rows.mapInPandas(_packed, "data binary").write.parquet(f"{work}/body")

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{path}/alignments.bam")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(where, True)
    try:
        held = bytearray()
        for piece in _header(names):
            held += piece
            if len(held) >= BLOCK:
                out.write(block(bytes(held[:BLOCK])))
                del held[:BLOCK]
        out.write(blocks(bytes(held)))
        for r in spark.read.parquet(f"{work}/body").toLocalIterator():
            out.write(bytes(r.data))
        out.write(END)
    finally:
        out.close()
    files.delete(hadoop.Path(work), True)
