"""Exact substring dedup by difference-cover anchors.

A difference cover D modulo V holds, for any two positions i and j, a shift
below V that brings both onto D. Anchors are runs of W = L + 1 - V words that
start at positions in D modulo V; two equal windows of L words therefore share
an anchor at the same place inside them, however they are aligned. Hashing
4 of 13 positions is thus enough to find every repeated window:

0. documents whose whole text an earlier one has are set aside (128-bit hashes,
   sums combined map-side): every window of theirs starts earlier, and none of
   theirs is the first of its kind;
1. anchors that occur twice or more are found by one shuffle on their hash;
2. each extends to the windows of L words that hold it: only these are hashed
   whole (94 bits), and one more shuffle tells for each whether an equal one
   starts earlier;
3. the words of those that have one are removed.

Before each shuffle, equal hashes of one block of text (a few MB) are settled
where they are: only the block's first goes to the hash's partition and the
others, whose answer is known, go to a partition of their own position. A
passage that a third of all documents share so sends one row a block. Reducers
stream over sorted rows and hold one row, never a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SPACES, doc_id_of, save, table, text_ids
from helixframe.llm.textkernel import U64, blocks, longs, mix, signed, window_hashes

WINDOW = 20
#: Text of a block: the larger, the more equal hashes are settled before a shuffle.
BLOCK_BYTES = 4 << 20
#: Perfect difference sets: period -> cover. Fixed values.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}
#: at: 30 bits that tell equal keys apart, 32 of the start word, and one that says whether the answer is known.
_KEYED = "k long, id long, at long"
_PLACE = "id long, pos int"


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for windows of so many words: the longest period that leaves anchors of a third of them."""
    period = max((v for v in COVERS if 3 * (window + 1 - v) >= window), default=1)
    return period, COVERS.get(period, (0,)), window + 1 - period


def _rows(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, mark_first: bool) -> pa.RecordBatch:
    """Rows of one block, settled as far as the block can; g tells equal h apart."""
    order = np.lexsort((pos, doc, g, h))
    x, y, d, p = h[order], g[order], doc[order], pos[order]
    first = np.ones(len(x), bool)
    if len(x):
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    if mark_first:
        sure = ~first | ~np.append(first[1:], True)[: len(x)]
    else:
        head = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
        sure = (d != d[head]) | (p != p[head])
    back = np.empty_like(order)  # texts' own order: near rows then look alike and compress well
    back[order] = np.arange(len(order))
    first, sure = first[back], sure[back]
    with np.errstate(over="ignore"):
        own = mix(doc.view(U64) * U64(0x9E3779B97F4A7C15) + pos.astype(U64), 5)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.where(first, h, own))), pa.array(doc), pa.array(((g >> U64(34)).astype(np.int64) << 33) | (2 * pos + sure))],
        names=["k", "id", "at"],
    )


def _anchors(window: int):
    period, shifts, size = cover(window)
    on = np.isin(np.arange(period), shifts)

    def run(batches):
        for block in blocks(batches, most=BLOCK_BYTES):
            words = block.word_hashes()
            at = block.windows(size)
            pos = at - block.first[block.row[at]]
            keep = on[pos % period]
            at, pos = at[keep], pos[keep]
            h = window_hashes(words, size)[at] if len(at) else np.zeros(0, U64)
            yield _rows(h, np.zeros(len(h), U64), longs(block.batch.column(0))[block.row[at]], pos, True)

    return run


def _settled(which: str):
    """Over rows sorted by key, id and start word: the places that have an equal (which = "shared") or an earlier equal ("later")."""

    def run(batches):
        held = None  # the first row of a group that may go on
        for batch in batches:
            if not len(batch):
                continue
            k, doc, at = (longs(batch.column(i)) for i in range(3))
            g, pos, sure = at >> 33, (at >> 1) & 0xFFFFFFFF, (at & 1).astype(bool)
            goes_on = held is not None and held[0] == k[0] and held[1] == g[0]
            if goes_on:
                k, g, doc, pos, sure = (np.concatenate([[x], y]) for x, y in zip(held, (k, g, doc, pos, sure), strict=True))
            elif held is not None and held[4]:
                yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int32())], names=["id", "pos"])
            first = np.ones(len(k), bool)
            first[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
            head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
            if which == "shared":
                hit = sure | ~first | ~np.append(first[1:], True)
            else:
                hit = sure | ((doc != doc[head]) | (pos != pos[head]))
            last = head[-1]  # stays open: the next batch may hold more of it
            held = (k[last], g[last], doc[last], pos[last], bool(hit[last]))
            hit[last] = False
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(pos[hit].astype(np.int32))], names=["id", "pos"])
        if held is not None and held[4]:
            yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int32())], names=["id", "pos"])

    return run


def _flat(block, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column as rows and values."""
    lists = block.batch.column(block.batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(block.n), sizes), longs(lists.flatten())


def _covered(block, row: np.ndarray, pos: np.ndarray, before: int, after: int) -> np.ndarray:
    """Marks, for each word, whether a place puts it between its own word less before and its own plus after."""
    total = len(block.row)
    steps = np.zeros(total + 1, np.int64)
    word = block.first[row] + pos
    ok = word < block.first[row + 1]  # rows that repeat an id may be shorter
    word, row = word[ok], row[ok]
    np.add.at(steps, np.maximum(word - before, block.first[row]), 1)
    np.add.at(steps, np.minimum(word + after, block.first[row + 1]), -1)
    return np.cumsum(steps)[:-1] > 0


def _windows(window: int):
    size = cover(window)[2]

    def run(batches):
        for block in blocks(batches, most=BLOCK_BYTES):
            near = _covered(block, *_flat(block, "at"), window - size, 1)
            at = block.windows(window)
            at = at[near[at]]
            doc = longs(block.batch.column(0))[block.row[at]]
            pos = at - block.first[block.row[at]]
            h, g = (window_hashes(block.word_hashes(seed=s), window, seed=s)[at] if len(at) else np.zeros(0, U64) for s in (0, 1))
            yield _rows(h, g, doc, pos, False)

    return run


def _removed(window: int):
    def run(batches):
        for block in blocks(batches, most=BLOCK_BYTES):
            gone = _covered(block, *_flat(block, "at"), 0, window)
            copy = block.batch.column(block.batch.schema.get_field_index("copy")).to_numpy(zero_copy_only=False).astype(bool)
            gone |= (copy & (np.diff(block.first) >= window))[block.row]
            data = block.bytes.tobytes()
            kept = []
            for r in range(block.n):
                low, high = block.first[r], block.first[r + 1]
                if gone[low:high].any():
                    kept.append(b" ".join(data[block.start[i] : block.end[i]] for i in low + np.flatnonzero(~gone[low:high])))
                else:
                    kept.append(b" ".join(data[block.at[r] : block.at[r + 1]].split()))
            lost = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0), pa.array(np.diff(block.first)), pa.array(lost[block.first[1:]] - lost[block.first[:-1]]), pa.array([x.decode() for x in kept], pa.string())],
                names=["id", "n_words", "n_removed", "text"],
            )

    return run


def copies(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (id, copied): hashes of the texts of an id that a smaller id has too."""
    sums = ["h", "g", "n"]
    keys = save(docs.select("id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.length("text").alias("n")), "keys")
    first = keys.groupBy(*sums).agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    return keys.join(first, sums).where("id > first").groupBy("id").agg(F.collect_set("h").alias("copied"))


def repeated_places(marked: DataFrame, window: int = WINDOW) -> DataFrame:
    """marked(id, text, copy) -> (id, at): the start words of the windows that also start earlier, but for those of copies."""

    def settle(df: DataFrame, which: str) -> DataFrame:
        df = df.repartition("k").sortWithinPartitions("k", F.shiftright("at", 33), "id", "at").mapInArrow(_settled(which), _PLACE)
        return df.groupBy("id").agg(F.collect_list("pos").alias("at"))

    own = marked.where("not copy").select("id", "text")
    anchors = settle(own.mapInArrow(_anchors(window), _KEYED), "shared")
    near = marked.join(anchors, "id").where("not copy").select("id", "text", "at")
    return settle(near.mapInArrow(_windows(window), _KEYED), "later")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, n_words, n_removed, text (the kept words, joined by one space).

    A word goes if a window of `window` consecutive words over it also starts
    earlier: in a smaller doc_id, or earlier in the same document. Null and empty
    texts have no words; texts shorter than the window lose none. Texts without a
    doc_id sort before all others, by a hash of the text, each a document of its own. Rows that repeat a doc_id are judged as that one document: a
    window at the same place of such rows is not earlier than itself, and what
    goes at a place goes from all of them. An empty table gives an empty table.
    Other columns are ignored.
    """
    docs = docs.select(text_ids().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.join(copies(docs), "id", "left").select("id", "text", F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False)).alias("copy"))
    gone = repeated_places(marked, window)
    out = marked.join(gone, "id", "left").select("id", "text", "at", "copy").mapInArrow(_removed(window), "id long, n_words long, n_removed long, text string")
    return out.select(doc_id_of(F.col("id")).alias("doc_id"), "n_words", "n_removed", "text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
f AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range({WINDOW}) AS s(j)),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)) ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
