"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-case tokens in which numbers, names (capitalised
words inside a sentence) and units (after a number) are typed placeholders.
Windows of WINDOW such tokens are hash-joined with those of the benchmark items.
Names depend on case, so windows that only replace numbers and units are joined
too; a passage in other case still meets its item. Windows of the tokens as they
stand are joined as well: a run of equal tokens that is long enough (RUN tokens, or the
whole item) counts as "verbatim", whatever its tokens are.

Each match of templates extends along its diagonal as far as they agree. That stretch is cut where its slots are not
consistent: in a run an item's value always stands for the same value in the document,
and different ones for different ones. A run counts if it is long enough
and has at least half its tokens spelled out; parts of a stretch that are so count where the whole is not.
Equal slots throughout make a run "verbatim"; others "reparameterised".

The benchmark is read in blocks of BLOCK characters (and the rest of the last item), which are at most half as
many tokens; the windows and tokens of one block, about 100 bytes
a token, go to the executors and all documents are matched with them, so
memory is bounded however long the benchmark is. Results are per document and
item, never per window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import ids, real_id, save, table
from helixframe.llm.textkernel import U64, Block, blocks, longs, window_hashes

WINDOW, RUN, BLOCK, PAIRS = 8, 13, 4_000_000, 1 << 20
#: Units that count as such after a number. Fixed values.
UNITS = "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degrees mph kmh kph hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal".split()
NUM, NAME, UNIT = (U64(x) for x in (11, 12, 13))
_BITS = 20
_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_INNER = _DIGIT | _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128) | (_BYTE == 95)
_JOINS = np.isin(_BYTE, list(b".,"))
_ENDS = np.isin(_BYTE, list(b'.!?\n:|"'))


class Templates(Block):
    """Tokens of some rows: runs of letters, digits, _ and bytes from 128, with points and commas between digits.

    raw: hashes of the tokens in lower case; full: with placeholders for numbers
    (first character a digit), names and units; plain: with all but those for names.
    """

    def _mark(self) -> np.ndarray:
        digit = _DIGIT[self.bytes]
        mark = _INNER[self.bytes]
        if len(mark) > 2:
            mark[1:-1] |= _JOINS[self.bytes[1:-1]] & digit[:-2] & digit[2:]
        return mark

    def __init__(self, batch: pa.RecordBatch, text: str):
        super().__init__(batch, text)
        self.raw = self.word_hashes(lower=True)
        n = len(self.raw)
        head = self.bytes[self.start]
        number = _DIGIT[head]
        ends = np.concatenate([[0], np.cumsum(_ENDS[self.bytes])])
        first = np.ones(n, bool)
        if n:
            first[1:] = (self.row[1:] != self.row[:-1]) | (ends[self.start[1:]] > ends[self.end[:-1]])
        long = self.end - self.start > 1
        second = self.bytes[np.minimum(self.start + 1, max(0, len(self.bytes) - 1))] if n else head
        name = _UPPER[head] & long & ~_UPPER[second] & ~first
        unit = np.isin(self.raw, _UNIT_HASHES)
        unit[1:] &= number[:-1] & (self.row[1:] == self.row[:-1])
        unit[:1] = False
        self.plain = np.where(number, NUM, np.where(unit, UNIT, self.raw))
        self.full = np.where(name & ~number & ~unit, NAME, self.plain)

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.first[row], self.first[row + 1])
        return self.raw[part], self.full[part], self.plain[part]


_UNIT_HASHES = np.zeros(0, U64)
_UNIT_HASHES = Templates(pa.RecordBatch.from_pydict({"text": [" ".join(UNITS)]}), "text").raw


def _worth(seq: np.ndarray, size: int) -> np.ndarray:
    """Windows of an item's template that a run that counts can need.

    A run has at least half its tokens spelled out. One of RUN tokens or more then
    holds a window that has so too, as the windows of more slots would add up to
    more than half of the run; so these are left out, and rows of placeholders,
    which any table of numbers is, meet nothing. A shorter run is a whole item:
    all its windows stay, or none if the item is more than half slots.
    """
    slot = np.isin(seq, (NUM, NAME, UNIT))
    n = len(seq) - size + 1
    if len(seq) < RUN:
        return np.arange(n if 2 * np.count_nonzero(slot) <= len(seq) else 0)
    level = np.concatenate([[0], np.cumsum(slot)])
    return np.flatnonzero(2 * (level[size:] - level[:n]) <= size)


class Index:
    """Sorted window hashes of a block of items, and where they stand."""

    def __init__(self, items: list[tuple[int, str]]):
        read = Templates(pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in items], pa.string())}), "text")
        self.ids = [i for i, _ in items]
        self.items = [read.of(r) for r in range(len(items))]
        h, where, at = [], [], []
        for n, item in enumerate(self.items):
            size = min(WINDOW, len(item[0]))
            for which, seq in enumerate(item if size else ()):
                w = window_hashes(seq, size)
                places = np.arange(len(w)) if which == 0 else _worth(seq, size)
                h.append(w[places]), where.append(np.full(len(places), n)), at.append(places)
        h = np.concatenate(h) if h else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.where = (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64))[order]
        self.size = np.array([min(WINDOW, len(x[0])) for x in self.items] or [0])
        self.sizes = sorted(set(self.size.tolist()) - {0})
        #: whether any hash has these last bits: most windows stop here
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.h & U64((1 << _BITS) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of h that the index holds."""
        maybe = np.flatnonzero(self.bits[(h & U64((1 << _BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.h, h[maybe]), max(0, len(self.h) - 1))
        return maybe[self.h[at] == h[maybe]] if len(self.h) else maybe[:0]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two arrays of one length are the same, read in parts that grow."""
    low, step = 0, 64
    while low < len(a):
        differ = np.flatnonzero(a[low : low + step] != b[low : low + step])
        if len(differ):
            return low + int(differ[0])
        low, step = low + step, 4 * step
    return len(a)


def _stretch(a: np.ndarray, b: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """How many tokens before and from item token i and document token d agree on their diagonal."""
    low, high = min(i, d), min(len(a) - i, len(b) - d)
    return _agree(a[i - low : i][::-1], b[d - low : d][::-1]), _agree(a[i : i + high], b[d : d + high])


def _consistent(slots: list[tuple], at: list[int], n: int) -> list[tuple[int, int]]:
    """The longest parts of n tokens in which the slots (kind, item's value, document's value), at these places, are consistent; no part lies in another."""
    parts, left = [], 0  # left: first slot of the part
    to: dict = {}
    back: dict = {}
    for s, (kind, u, v) in enumerate(slots):
        v0, s0 = to.get((kind, u), (v, -1))
        u1, s1 = back.get((kind, v), (u, -1))
        clash = max(s0 if v0 != v else -1, s1 if u1 != u else -1)
        if clash >= left:
            parts.append((at[left - 1] + 1 if left else 0, at[s]))
            left = clash + 1
        to[kind, u], back[kind, v] = (v, s), (u, s)
    return [*parts, (at[left - 1] + 1 if left else 0, n)]


def _spelled(slot: np.ndarray, need: int) -> list[tuple[int, int]]:
    """The longest parts of at least so many tokens of which at most half are slots; no part lies in another."""
    if 2 * np.count_nonzero(slot) <= len(slot):
        return [(0, len(slot))]
    level = np.concatenate([[0], np.cumsum(np.where(slot, -1, 1))])
    ahead = np.maximum.accumulate(level[::-1])  # from the end: the highest level from there on
    starts = np.flatnonzero(level == np.minimum.accumulate(level))
    starts = starts[np.unique(level[starts], return_index=True)[1][::-1]]  # where a level is reached first
    ends = len(slot) - np.searchsorted(ahead, level[starts], "left")
    new = np.diff(ends, prepend=-1) > 0
    return [(a, b) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True) if b - a >= need]


def _runs(item: tuple, doc: tuple, i: int, d: int, which: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Around item token i and document token d: where in the item the stretch on which the sequences agree ends, and its runs that count: first token in the item, end and kind."""
    low, high = _stretch(item[which], doc[which], i, d)
    need = min(RUN, len(item[0]))
    if low + high < need:
        return i + high, []
    if which == 0:
        return i + high, [(i - low, i + high, "verbatim")]
    x, y, t = (s[k - low : k + high] for s, k in ((item[0], i), (doc[0], d), (item[which], i)))
    slot = np.isin(t, (NUM, NAME, UNIT))
    at = np.flatnonzero(slot)
    slots = list(zip(t[at].tolist(), x[at].tolist(), y[at].tolist(), strict=True))
    runs = set()
    for p, q in _consistent(slots, at.tolist(), low + high):
        if q - p >= need:
            runs.update((p + a, p + b) for a, b in _spelled(slot[p:q], need))
    return i + high, [(i - low + a, i - low + b, "verbatim" if (x[a:b] == y[a:b]).all() else "reparameterised") for a, b in sorted(runs)]


def _starts(block: Templates, index: Index, seq: np.ndarray, size: int):
    """(row, item, item token, document token) where windows of so many tokens begin to agree on a diagonal, in order of diagonals and places.

    Pairs of places are made and put in order PAIRS at a time; what goes on from
    one part in the next begins again there.
    """
    h = window_hashes(seq, size)
    if not len(h):
        return
    places = index.hits(h)
    places = places[block.row[places] == block.row[places + size - 1]]
    low = np.searchsorted(index.h, h[places], "left")
    many = np.searchsorted(index.h, h[places], "right") - low
    ends = np.cumsum(many)
    at = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = many[at:to]
        total = int(some.sum())
        entry = np.repeat(low[at:to] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(total)
        p = np.repeat(places[at:to], some)
        at = to
        n, i = index.where[entry], index.at[entry]
        right = index.size[n] == size
        p, n, i = p[right], n[right], i[right]
        r = block.row[p]
        d = p - block.first[r]
        order = np.lexsort((i, d - i, n, r))
        r, n, i, d = r[order], n[order], i[order], d[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (n[1:] != n[:-1]) | ((d - i)[1:] != (d - i)[:-1]) | (i[1:] > i[:-1] + 1)
        yield from zip(r[first].tolist(), n[first].tolist(), i[first].tolist(), d[first].tolist(), strict=True)


def matches(block: Templates, index: Index) -> list[tuple[int, int, int, int, str]]:
    """(row, item, tokens of its longest run, tokens of it in runs, kind) for each item that a row holds."""
    found: dict[tuple[int, int], set] = {}
    for which, seq in enumerate((block.raw, block.full, block.plain)):
        for size in index.sizes:
            last, until = None, -1  # the diagonal before, and to which item token it is known
            for r, n, i, d in _starts(block, index, seq, size):
                if last == (r, n, d - i) and i < until:
                    continue
                last = r, n, d - i
                until, runs = _runs(index.items[n], block.of(r), i, d, which)
                if runs:
                    found.setdefault((r, n), set()).update(runs)
    out = []
    for (r, n), runs in found.items():
        covered = set().union(*(range(a, b) for a, b, _ in runs))
        longest = max(runs, key=lambda x: (x[1] - x[0], x[2]))
        out.append((r, index.ids[n], longest[1] - longest[0], len(covered), longest[2]))
    return sorted(out)


def _scan(shared):
    schema = pa.schema([("id", pa.int64()), ("sum", pa.int64()), ("item_id", pa.int64()), ("run", pa.int64()), ("covered", pa.int64()), ("kind", pa.string())])

    def run(batches):
        index = shared.value
        for block in blocks(batches, kind=Templates):
            doc, sums = longs(block.batch.column(0)), longs(block.batch.column(1))
            found = [(int(doc[r]), int(sums[r]), *rest) for r, *rest in matches(block, index)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=schema)

    return run


def item_blocks(benchmark: DataFrame, most: int = BLOCK):
    """The benchmark's items in blocks that reach `most` characters with their last item, one after another through the driver."""
    block, size = [], 0
    for row in benchmark.where("text is not null").select(ids("item_id").alias("id"), "text").toLocalIterator():
        block.append((row.id, row.text))
        size += len(row.text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def text_sum() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row per doc_id, text and item found in it: id, sum, item_id, run, covered, kind.

    id is `ids` of doc_id, sum the `text_sum`. Items of fewer than WINDOW tokens
    are found whole. Null and empty texts hold nothing and are held nowhere.
    Items that repeat an item_id are one item: the longest run stands for them.
    An empty table on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(ids().alias("id"), text_sum().alias("sum"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "id long, sum long, item_id long, run long, covered long, kind string"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block))
        found = found.unionByName(save(rows.mapInArrow(_scan(shared), schema), "found"))
    best = found.groupBy("id", "sum", "item_id").agg(F.max(F.struct("run", "covered", "kind")).alias("b"))
    return best.select("id", "sum", real_id(F.col("item_id")).alias("item_id"), "b.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row per document and item found in it: doc_id, sum, item_id, run, covered, kind.

    Rows that repeat a doc_id are one document: the longest run stands for them, and
    sum is null. A null doc_id names no document: each of its texts is one, with
    its `text_sum`. Other cases as in `contaminated_texts`.
    """
    found = contaminated_texts(docs, benchmark).withColumn("doc_id", real_id(F.col("id"))).withColumn("sum", F.when(F.col("doc_id").isNull(), F.col("sum")))
    return found.groupBy("doc_id", "sum", "item_id").agg(F.max(F.struct("run", "covered", "kind")).alias("b")).select("doc_id", "sum", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, items (ascending ids, null first), longest_run, kind (verbatim if any item is).

    Cases as in `contaminated`.
    """
    found = contaminated(docs, benchmark).groupBy(F.col("doc_id").alias("of"), F.col("sum").alias("of_sum")).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"), F.max("run").alias("longest_run"), F.max("kind").alias("kind"))
    rows = docs.select("doc_id", F.when(F.col("doc_id").isNull(), text_sum()).alias("sum"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("sum").eqNullSafe(F.col("of_sum")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), "kind")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
