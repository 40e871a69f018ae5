"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS cells. Each shard owns `virtual` nodes at hashed cells; a
key's cell is a hash of the row's key, and the next node clockwise names its
shard. A shard takes at most its quota. What overflows continues clockwise to
the next node whose shard has room. Rows stand in ring order: by cell, hash, key
and text.

Loads are settled on cell counts, not on rows: CELLS counts at most, whatever
the corpus, give a few intervals of ranks within cells, and these are broadcast
(their number is bounded by CELLS plus the number of nodes and shards). A row
only needs its rank within its cell.

A row's key is its doc_id with its text's checksum: equal texts are no group that
stays together (a third of all rows may be equal), they spread like others. When
a shard is added, rows move for two reasons: to the new shard, and as quotas and overflow
change, between old ones; a test bounds the second by a tenth of all rows.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import table

CELLS = 1 << 16


def nodes(shards: int, virtual: int, seed: int = 0, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; of nodes in one cell the first has its keys."""
    found = [(int(hashlib.md5(f"{seed}:{shard}:{v}".encode()).hexdigest()[:8], 16) % cells, shard) for shard in range(shards) for v in range(virtual)]
    return sorted(found)


def quotas(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard: an equal share, or that with slack; without slack they sum to the total."""
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def settle(counts: dict[int, int], ring: list[tuple[int, int]], quota: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, first rank, end, shard, first slot): first each shard fills from its own cells in ring order, then the rest goes clockwise, in ring order too."""
    at = [c for c, _ in ring]
    free, slot = list(quota), [0] * len(quota)
    out, rest = [], []

    def put(cell: int, low: int, high: int, shard: int) -> int:
        n = min(free[shard], high - low)
        if n:
            out.append((cell, low, low + n, shard, slot[shard]))
            free[shard] -= n
            slot[shard] += n
        return low + n

    for cell in sorted(counts):
        node = bisect.bisect_left(at, cell) % len(at)
        low = put(cell, 0, counts[cell], ring[node][1])
        if low < counts[cell]:
            rest.append((cell, low, node))
    for cell, low, node in rest:
        step = 0
        while low < counts[cell]:
            step += 1
            if step > len(ring):
                raise ValueError("the quotas are smaller than the number of rows")
            low = put(cell, low, counts[cell], ring[(node + step) % len(ring)][1])
    return out


def ring_shards(docs: DataFrame, shards: int = 24, virtual: int = 64, seed: int = 0, slack: float = 0.0) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, size, text_crc32, shard, slot.

    Shard counts are at most one apart (slack 0) or at most (1 + slack) of the
    equal share. Rows that repeat a doc_id and null doc_ids are placed by their
    text's checksum too, so they spread; a null text counts as an empty one, of
    size 8. slot numbers a shard's rows from 0 without gaps; among rows that are
    equal in doc_id, checksum and size the order is free, as they can't be told
    apart. An empty table gives an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.col("text_crc32").cast("string"))
    rows = rows.withColumn("point", F.md5(key)).withColumn("cell", (F.conv(F.substring("point", 1, 8), 16, 10).cast("long") % CELLS).cast("int"))
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    placed = settle(counts, nodes(shards, virtual, seed), quotas(sum(counts.values()), shards, slack))
    at: dict[int, list] = {}
    for cell, low, high, shard, slot in placed:
        at.setdefault(cell, []).append((low, high, shard, slot))
    spans = spark.createDataFrame([(c, v) for c, v in at.items()], "cell int, spans array<struct<low:long,high:long,shard:int,slot:long>>")
    order = Window.partitionBy("cell").orderBy("point", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(spans), "cell")
    rows = rows.withColumn("span", F.filter("spans", lambda s: (s.low <= F.col("rank")) & (F.col("rank") < s.high))[0])
    return rows.select("doc_id", "size", "text_crc32", F.col("span.shard").alias("shard"), (F.col("span.slot") + F.col("rank") - F.col("span.low")).alias("slot"))


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_CRC = "list_reduce(list_prepend({0}, {1}), lambda c, x: {2})"
_TABLE = _CRC.format("n", "range(8)", "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END")
#: The checksum byte by byte; the ring row by row, in a recursion over the rows that overflow.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: {_TABLE}) AS t),
x AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
y AS (SELECT k, doc_id, octet_length(b) + 8 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM x),
z AS (SELECT k, doc_id, size, xor({_CRC.format("4294967295::BIGINT", "bytes", "xor(t[(xor(c, x) & 255) + 1], c >> 8)")}, 4294967295) AS crc FROM y, crc),
p AS (SELECT *, md5('0:' || coalesce(doc_id::VARCHAR, '?') || ':' || crc) AS point FROM z),
o AS (SELECT *, ('0x' || substr(point, 1, 8))::BIGINT % {CELLS} AS cell, row_number() OVER (ORDER BY ('0x' || substr(point, 1, 8))::BIGINT % {CELLS}, point, doc_id NULLS FIRST, crc, size) AS place FROM p),
nodes AS (SELECT s AS shard, ('0x' || substr(md5('0:' || s || ':' || v), 1, 8))::BIGINT % {CELLS} AS cell FROM range(24) a(s), range(64) b(v)),
ring AS (SELECT shard, cell, row_number() OVER (ORDER BY cell, shard) - 1 AS node FROM nodes),
l AS (SELECT list(shard ORDER BY node) AS shards, count(*) AS n FROM ring),
h AS (SELECT o.*, coalesce((SELECT min(node) FROM ring WHERE ring.cell >= o.cell), 0) AS node FROM o),
q AS (SELECT s AS shard, count(*) // 24 + (s < count(*) % 24)::INT AS quota FROM range(24) r(s), documents GROUP BY s),
own AS (SELECT h.*, ring.shard AS home, quota, row_number() OVER (PARTITION BY ring.shard ORDER BY place) AS nth FROM h JOIN ring USING (node) JOIN q ON q.shard = ring.shard),
over AS (SELECT k, node, row_number() OVER (ORDER BY place) AS j FROM own WHERE nth > quota),
free AS (SELECT list(quota - n ORDER BY shard) AS free FROM (SELECT q.shard, q.quota, count(k) FILTER (nth <= own.quota) AS n FROM q LEFT JOIN own ON own.home = q.shard GROUP BY q.shard, q.quota) t(shard, quota, n)),
moved AS (
  SELECT 0::BIGINT AS j, free, NULL::BIGINT AS shard, NULL::BIGINT AS slot FROM free
  UNION ALL
  SELECT j, list_transform(free, lambda v, i: v - (i = pick + 1)::INT), pick, (SELECT quota FROM q WHERE q.shard = pick) - free[pick + 1]
  FROM (SELECT over.j, free, list_extract(list_filter(list_transform(range(1, l.n + 1), lambda s: shards[(node + s) % l.n + 1]), lambda s: free[s + 1] > 0), 1) AS pick FROM moved JOIN over ON over.j = moved.j + 1, l) t)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, home::INT AS shard, nth - 1 AS slot, NULL::INT AS grown_shard FROM own WHERE nth <= quota
UNION ALL SELECT doc_id, size::BIGINT, crc, 'rows', moved.shard::INT, moved.slot, NULL FROM own JOIN over USING (k) JOIN moved ON moved.j = over.j
"""
