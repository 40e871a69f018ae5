"""MinHash near-dedup by fast similarity sketching.

A document's sketch has T bins. Round i of 2 T throws every shingle into a bin
(round i < T: a hashed bin; round T + j: bin j) with the value (i, hash); a bin
keeps the smallest value and a document stops at the first round after which
all its bins are full. Every bin is thus full, each agrees between two
documents with the probability of their Jaccard similarity, and sums over bins
concentrate as with independent minima. Bands of R bins are then joined:

1. documents with equal shingle sets become one class, by a map-side combined
   minimum; only class representatives go on;
2. in each band bucket every member is paired with LEADERS members, the minima
   of as many hash orders: linear in the bucket, not quadratic;
3. pairs are pruned by set size and by the estimate of the sketch (5 standard
   deviations below the threshold) and then verified on full shingle sets;
4. components of these links leave the documents of buckets that still hold two
   components. Their remaining links are found exactly, by prefixes: with
   shingles in one common order, rare ones first, two similar sets share one
   near both their beginnings, and where it stands bounds their overlap. A
   group that shares a long passage but is not similar enough shares none, so
   it isn't paired off; within one component nothing is;
5. components of all links are the result.

The chance that the bands miss a pair at the threshold itself is
(1 - 0.75^R)^(T/R): 5e-6, and less above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SPACES, doc_id_of, save, table, text_ids
from helixframe.llm.graph import components
from helixframe.llm.textkernel import BLOCK_BYTES, U64, Block, blocks, cuts, lengths, longs, mix, signed, window_hashes

T, R, LEADERS = 128, 4, 2
SHINGLE, PERCENT = 5, 75
#: Counters that order shingles by how common they are.
ORDER_BITS = 18
_SKETCH = "id long, n long, s1 long, s2 long, bands array<long>, sketch binary"


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and where each row's begin."""
    words = block.word_hashes(lower=True)
    at = block.windows(size)
    h, row = window_hashes(words, size)[at] if len(at) else np.zeros(0, U64), block.row[at]
    count = np.diff(block.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([window_hashes(words[block.first[r] : block.first[r + 1]], count[r])[0] for r in short], U64)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    at = np.searchsorted(row, np.arange(block.n + 1))
    for r in range(block.n):
        h[at[r] : at[r + 1]].sort()
    if len(h):
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(block.n + 1))


def sketch(h: np.ndarray, at: np.ndarray, bins: int = T) -> np.ndarray:
    """A row of bins for each document: the smallest (round, hash) that fell into each. Documents without shingles have all ones."""
    n = len(at) - 1
    out = np.full((n, bins), U64(2**64 - 1))
    active = np.flatnonzero(np.diff(at))
    sizes = np.diff(at)
    for i in range(2 * bins):
        if not len(active):
            break
        take = sizes[active]
        doc = np.repeat(active, take)
        if len(active) == n:
            x = h
        else:
            x = h[np.repeat(at[active], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)]
        x = mix(x, 1000 + i)
        where = (x % U64(bins)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        value = (U64(i) << U64(55)) | (x >> U64(9))
        np.minimum.at(out.reshape(-1), doc * bins + where, value)
        full = (out[active] != U64(2**64 - 1)).all(axis=1)
        active = active[~full]
    return out


def _sketches(batches):
    for block in blocks(batches):
        h, at = shingle_sets(block)
        n = np.diff(at)
        full = n > 0
        s = sketch(h, at)
        sums = []
        with np.errstate(over="ignore"):
            for seed in (7, 8):
                total = np.zeros(len(h) + 1, U64)
                np.cumsum(mix(h, seed), out=total[1:])
                sums.append(total[at[1:]] - total[at[:-1]])
        bands = np.stack([window_hashes(s[:, j : j + R].reshape(-1), R, seed=100 + j)[::R] for j in range(0, T, R)], axis=1) if block.n else np.zeros((0, T // R), U64)
        small = mix(s).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                block.batch.column(0),
                pa.array(n.astype(np.int64)),
                pa.array(signed(sums[0])),
                pa.array(signed(sums[1])),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * (T // R))]).astype(np.int32)), pa.array(signed(np.ascontiguousarray(bands[full]).reshape(-1)))),
                pa.array([small[r].tobytes() for r in range(block.n)], pa.binary()),
            ],
            names=["id", "n", "s1", "s2", "bands", "sketch"],
        )


def _agree(least: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, T) for c in (2, 3))
            keep = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            for low, high in cuts(lengths(batch.column(2)) + lengths(batch.column(3)), BLOCK_BYTES):
                part = batch.slice(low, high - low)
                sets = [shingle_sets(Block(part, c)) for c in ("x", "y")]
                keep = np.zeros(len(part), bool)
                for r in range(len(part)):
                    (h, at), (g, to) = sets
                    a, b = h[at[r] : at[r + 1]], g[to[r] : to[r + 1]]
                    both = len(a) + len(b) - len(np.union1d(a, b))
                    keep[r] = 100 * both >= percent * (len(a) + len(b) - both)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose full shingle sets are similar enough."""
    p = percent / 100
    least = p - 5 * (p * (1 - p) / T) ** 0.5
    sketches = reps.select("id", "sketch")
    rough = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    rough = save(rough.mapInArrow(_agree(least), "a long, b long"), "rough")
    full = rough.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return save(full.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "links")


def _counted(batches):
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for block in blocks(batches):
        h, _ = shingle_sets(block)
        total += np.bincount((h >> U64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _prefixes(shared, percent: int):
    """Rows (token, pos) of each set's prefix; first: short enough a prefix to meet larger sets."""

    def run(batches):
        common = shared.value
        for block in blocks(batches):
            h, at = shingle_sets(block)
            rows = []
            for r in range(block.n):
                x = h[at[r] : at[r + 1]]
                n = len(x)
                keep = n - -(-percent * n // 100) + 1
                order = np.lexsort((x, common[(x >> U64(64 - ORDER_BITS)).astype(np.int64)]))[: max(0, keep)]
                rows.append(x[order])
            size = np.diff(at)
            take = np.array([len(x) for x in rows], np.int64)
            n = np.repeat(size, take)
            pos = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            first = (100 + percent) * (n - pos) >= 2 * percent * n
            token = np.concatenate(rows) if rows else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(np.repeat(longs(block.batch.column(0)), take)), pa.array(np.repeat(longs(block.batch.column(2)), take)), pa.array(n), pa.array(pos), pa.array(first)], names=["token", "id", "part", "n", "pos", "first"])

    return run


def _apart(rest: DataFrame, percent: int) -> DataFrame:
    """rest(id, text, part) -> pairs(a, b) of different parts whose prefixes allow similarity; none that is similar enough is missing."""
    spark = rest.sparkSession
    counts = rest.select("id", "text").mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << ORDER_BITS, np.int64)  # of this size whatever the corpus; any order is right, a good one prunes more
    common[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    prefix = rest.select("id", "text", "part").mapInArrow(_prefixes(spark.sparkContext.broadcast(common), percent), "token long, id long, part long, n long, pos long, first boolean")
    prefix = save(prefix, "prefixes")
    # tokens of one part only go; of the others, the largest part is not paired with itself
    parts = prefix.groupBy("token", "part").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("size", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("most.part").alias("most"))
    rows = save(prefix.join(mixed, "token"), "mixed")
    other = rows.select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "part", "n", "pos", "first")])
    bound = f"{100 + percent} * least(n - pos, n_ - pos_) >= {percent} * (n + n_)"
    smaller = "first and (n < n_ or (n = n_ and id < id_))"
    larger = "first_ and (n_ < n or (n = n_ and id_ < id))"
    # each pair once: from its row outside the largest part, or from the smaller of two such
    pairs = rows.where("part <> most").join(other, "token").where(f"part <> part_ and {bound} and ({smaller} or ({larger} and part_ = most))")
    return pairs.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, n_shingles, component_id, kept.

    Null or blank texts have no shingles and link with nothing. Rows that repeat
    a doc_id count as one document of one of their texts for links to others.
    Texts without a doc_id are documents of their own, equal ones the same; they
    sort before all others, by a hash of the text: a group that holds one has a
    null component_id, and the first of them is kept. An empty table gives an
    empty table. Other columns are ignored.
    """
    return grouped(docs, percent).select(doc_id_of(F.col("id")).alias("doc_id"), "n_shingles", doc_id_of(F.col("component")).alias("component_id"), "kept")


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """near_duplicates with id and component as text_ids() gives them: id, n_shingles, component, kept."""
    docs = docs.select(text_ids().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    all_docs = save(docs.mapInArrow(_sketches, _SKETCH), "sketches")
    sets = ["n", "s1", "s2"]
    classes = save(all_docs.where("n > 0").groupBy(*sets).agg(F.min("id").alias("rep")), "classes")
    reps = all_docs.where("n > 0").join(classes.withColumnRenamed("rep", "id"), [*sets, "id"], "left_semi").dropDuplicates(["id"])
    reps = save(reps.select("id", "n", "bands", "sketch"), "reps")
    band = reps.select("id", "n", F.explode("bands").alias("band"))
    order = [F.struct(F.xxhash64("id", F.lit(j)).alias("h"), "id", "n") if j else F.struct("id", "n") for j in range(LEADERS)]
    heads = band.groupBy("band").agg(F.count("*").alias("size"), *[F.min(o).alias(f"head{j}") for j, o in enumerate(order)]).where("size > 1")
    heads = heads.select("band", F.array(*[F.struct(F.col(f"head{j}.id").alias("id"), F.col(f"head{j}.n").alias("n")) for j in range(LEADERS)]).alias("heads"))
    shared = save(band.join(heads, "band"), "buckets")
    near = "100 * least(n, m) >= {0} * greatest(n, m)".format(percent)
    pairs = shared.select("id", "n", F.explode("heads").alias("head")).select("id", "n", F.col("head.id").alias("other"), F.col("head.n").alias("m")).where("id <> other").where(near)
    pairs = pairs.select(F.greatest("id", "other").alias("b"), F.least("id", "other").alias("a")).distinct()
    links = _links(pairs, reps, docs, percent)
    parts = components(links)

    open_ = shared.select("band", "id").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    mixed = open_.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band")
    rest = open_.join(mixed, "band", "left_semi").select("id", "part").distinct()
    rest = save(docs.join(rest, "id").dropDuplicates(["id"]).select("id", "text", "part"), "rest")
    pairs = _apart(rest, percent)
    more = _links(pairs, reps, rest, percent)
    parts = components(links.union(more))

    out = all_docs.select("id", *sets).join(classes, sets, "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return out.select("id", F.col("n").alias("n_shingles"), "component", (F.col("id") == F.col("component")).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACES}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, t.b FROM r JOIN t ON r.other = t.a),
m AS (SELECT id, min(other) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""
