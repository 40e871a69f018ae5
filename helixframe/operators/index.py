"""The k-mer index: postings, their counts, and k-mers left out, as Parquet tables.

Written postings lie in folders by their first bases (`bin`), as many as their
number asks for, and are range-partitioned and sorted by k-mer: a search reads
only the folders that its query k-mers fall into, and neighbours compress well.
Mode-1 indexes keep no positions.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import kmers, seeds, settings

VERSION = 1


@dataclass(frozen=True)
class Meta:
    k: int
    span: int = 0
    template: str = seeds.CONTIGUOUS
    expand: int = 4
    positions: bool = True
    title: str = ""
    version: int = VERSION
    #: How many first bases name a folder of written postings; 0 for postings that are not written.
    bases: int = 0


@dataclass(frozen=True)
class Index:
    """postings(kmer, volume, oid, s_pos), counts(kmer, n: occurrences over all volumes), excluded(kmer), sequences(volume, oid, accession, seq, slen)."""

    meta: Meta
    sequences: DataFrame
    postings: DataFrame
    counts: DataFrame
    excluded: DataFrame
    #: Built, but not written: postings are made from the sequences whenever they are read.
    fresh: bool = False

    @property
    def offsets(self) -> list[int]:
        return seeds.offsets(self.meta.k, self.meta.span, self.meta.template)

    @property
    def window(self) -> int:
        return seeds.window(self.meta.k, self.meta.span)


def with_length(sequences: DataFrame) -> DataFrame:
    return sequences.select("volume", "oid", "accession", "seq", F.length("seq").alias("slen"))


def postings(sequences: DataFrame, k: int, span: int = 0, template: str = seeds.CONTIGUOUS, expand: int = 4) -> DataFrame:
    return kmers.kmers(sequences, ["volume", "oid"], "seq", seeds.offsets(k, span, template), expand, pos="s_pos")


def kmer_counts(posts: DataFrame) -> DataFrame:
    """Occurrences of each k-mer over all volumes."""
    return posts.groupBy("kmer").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, threshold: int | None) -> DataFrame:
    """k-mers that occur more often than the threshold; none without one."""
    return counts.where(F.col("n") > threshold if threshold is not None else F.lit(False)).select("kmer")


def occurrences(sequences: DataFrame, k: int, span: int = 0, template: str = seeds.CONTIGUOUS, expand: int = 4) -> DataFrame:
    """The same counts from sequences, without making postings."""
    return kmers.counts(sequences, "seq", seeds.offsets(k, span, template), expand)


def build(sequences: DataFrame, k: int, span: int = 0, template: str = seeds.CONTIGUOUS, expand: int = 4, max_freq: float = 1.0, positions: bool = True, title: str = "") -> Index:
    """sequences(volume, oid, accession, seq) -> an index. k-mers above max_freq go from all volumes and their counts too."""
    if not 0 <= expand <= 16:
        raise ValueError("a build expands up to 16 k-mers a window")
    sequences = with_length(sequences)
    posts = postings(sequences, k, span, template, expand)
    counts = occurrences(sequences, k, span, template, expand)
    threshold = settings.build_threshold(max_freq, sequences.count() if max_freq < 1 else 0)
    out = frequent(counts, threshold)
    if threshold is not None:
        posts, counts = posts.join(out, "kmer", "left_anti"), counts.join(out, "kmer", "left_anti")
    if not positions:
        posts = posts.select("kmer", "volume", "oid").distinct()
    return Index(Meta(k, span, template, expand, positions, title), sequences, posts, counts, out, True)


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Keep a table that is read several times, in memory and on disk, until `release`."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Let go of all that is kept. What still reads it is computed again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def kept(index: Index) -> Index:
    """An index that is not written, with its counts kept: searches may read them several times. Postings are many times the sequences and are made again."""
    for part in (index.counts, index.excluded):
        keep(part)
    return index


def build_all(sequences: DataFrame, k: int, span: int, kind: str, **options) -> list[Index]:
    """One index for each template of a kind; "both" gives two."""
    return [build(sequences, k, span, t, **options) for t in seeds.templates(span, kind)]


def folder(root: str, meta: Meta) -> str:
    return f"{root}/k={meta.k:02d}/t={meta.span:02d}/template={meta.template}"


#: Postings in a file and in a folder, about 100 MB.
PER_FILE = 16_000_000
#: First bases at most, which make 4096 folders.
MOST_BASES = 6


def _signature(sequences: DataFrame) -> str:
    n, sums = sequences.agg(F.count("*"), F.bit_xor(F.xxhash64("volume", "oid", "accession", "seq"))).first()
    return f"{n}:{sums}"


def write(index: Index, root: str, per_file: int = PER_FILE) -> str:
    """Write an index and, once for all indexes of a root, its sequences; the manifest comes last and marks it whole.

    Raises ValueError where the root has other sequences.
    """
    spark, at = index.postings.sparkSession, folder(root, index.meta)
    signed = _signature(index.sequences)
    known = _text(spark, f"{root}/signature")
    if known not in (None, signed):
        raise ValueError(f"{root} holds another collection")
    if known is None:
        index.sequences.write.mode("overwrite").partitionBy("volume").parquet(f"{root}/sequences")
        spark.createDataFrame([(signed,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/signature")
    n = index.counts.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-n // per_file))
    meta = replace(index.meta, bases=min(MOST_BASES, index.meta.k, math.ceil(math.log(files, 4))))
    order = [c for c in ("kmer", "volume", "oid", "s_pos") if c in index.postings.columns]
    posts = index.postings.select(*order).withColumn("bin", bin_of(F.col("kmer"), meta))
    posts.repartitionByRange(files, "kmer").sortWithinPartitions("bin", *order).write.mode("overwrite").partitionBy("bin").parquet(f"{at}/postings")
    index.counts.repartitionByRange(max(1, files // 8), "kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{at}/counts")
    index.excluded.write.mode("overwrite").parquet(f"{at}/excluded")
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return at


def bin_of(kmer: Column, meta: Meta) -> Column:
    return F.shiftright(kmer, 2 * (meta.k - meta.bases)).cast("int")


def near(index: Index, qk: DataFrame) -> DataFrame:
    """The postings that query k-mers (kmer) can meet: of written ones only the folders they fall into, of which there are 4^MOST_BASES at most."""
    if not index.meta.bases:
        return index.postings.drop("bin")
    bins = [r[0] for r in qk.select(bin_of(F.col("kmer"), index.meta)).distinct().collect()]
    return index.postings.where(F.col("bin").isin(bins)).drop("bin")


def made(index: Index, sequences: DataFrame) -> DataFrame:
    """The postings of some of a fresh index's sequences."""
    m = index.meta
    return postings(sequences, m.k, m.span, m.template, m.expand)


def _text(spark: SparkSession, path: str) -> str | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path).first().value


def read(spark: SparkSession, root: str, k: int, span: int = 0, template: str = seeds.CONTIGUOUS) -> Index:
    at = folder(root, Meta(k, span, template))
    meta = Meta(**json.loads(spark.read.text(f"{at}/manifest").first().value))
    if meta.version != VERSION:
        raise ValueError(f"index version {meta.version}, not {VERSION}")
    sequences = spark.read.parquet(f"{root}/sequences").select("volume", "oid", "accession", "seq", "slen")
    return Index(meta, sequences, spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/counts"), spark.read.parquet(f"{at}/excluded"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(k, span, template, meta as JSON) of the whole indexes of a root."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root).where("value like '{%'")
    schema = "k int, span int, template string, expand int, positions boolean, title string, version int"
    return found.select("value", F.from_json("value", schema).alias("m")).select("m.k", "m.span", "m.template", F.col("value").alias("meta")).orderBy("k", "span", "template")


def rewrite_without(index: Index, threshold: int) -> Index:
    """An existing index without the k-mers above a threshold; to be written under another root."""
    out = frequent(index.counts, threshold)
    posts = index.postings.drop("bin").join(out, "kmer", "left_anti")
    return Index(replace(index.meta, bases=0), index.sequences, posts, index.counts.join(out, "kmer", "left_anti"), index.excluded.union(out).distinct())
