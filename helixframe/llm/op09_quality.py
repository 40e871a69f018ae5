"""Quality rules for documents and for their hosts.

Each document is measured and fails the base rules or not. Failures are then
counted for each host, which every document of the host helps to decide. A beta
prior is fitted to the rates of all hosts by the method of moments, each host
counting once: its mean is that of the rates, its variance theirs less what
chance alone gives hosts of their sizes, so that small hosts do not pass for bad
ones. A host's rate is shrunk with it. The limit comes from the prior as well:
its mean and DEVIATIONS of its standard deviations, at least LEAST_LIMIT. A host whose shrunk rate is
above that loses all its documents. Everything is DataFrame functions. Per-host
sums are combined map-side, so a host with a third of all rows sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SPACES, let, save, table, words

SYMBOLS, RUN = "[#*$%&|<>]", 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
DEVIATIONS, LEAST_LIMIT = 2.0, 0.25
#: The prior's weight in documents where hosts differ no more than by chance, and the least it can be.
ALIKE, LEAST_WEIGHT = 1e6, 1.0


def _covered(at: Column, run: int) -> Column:
    """Words under windows that start at the given ascending places."""
    gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(run)), F.lit(run)).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def repeated_words(word: Column, run: int = RUN) -> Column:
    """Words of an array that lie in a window of `run` words found twice or more in it."""

    def found_twice(hashes: Column) -> Column:
        def covered(pairs: Column) -> Column:  # sorted by hash, then place
            before = F.concat(F.array(F.lit(None).cast(pairs_type)), F.slice(pairs, F.lit(1), F.size(pairs) - 1))
            after = F.concat(F.slice(pairs, F.lit(2), F.size(pairs) - 1), F.array(F.lit(None).cast(pairs_type)))
            marked = F.zip_with(F.arrays_zip(pairs.alias("p"), before.alias("b")), after, lambda x, a: F.when((x["p"]["h"] == x["b"]["h"]) | (x["p"]["h"] == a["h"]), x["p"]["i"]))
            return let(F.sort_array(F.filter(marked, lambda x: x.isNotNull())), lambda at: _covered(at, run))

        pairs_type = "struct<h:bigint,i:int>"
        zipped = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(zipped), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (run - 1)), lambda i: F.xxhash64(F.slice(w, i, run)))

    hashed = let(F.transform(word, lambda x: F.xxhash64(x)), windows)
    return F.when(F.size(word) <= run, F.lit(0).cast("long")).otherwise(let(hashed, found_twice))


def measures(text: Column, run: int = RUN) -> Column:
    """A struct of the base measures of a text."""

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            repeated_words(w, run).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    def of_text(t: Column) -> Column:
        return F.struct(
            let(words(t), of_words).alias("w"),
            (F.size(F.split(t, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
            let(F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")), of_lines).alias("n_dup_lines"),
        )

    return let(F.coalesce(text, F.lit("")), of_text)


def host_verdicts(judged: DataFrame, deviations: float = DEVIATIONS, least: float = LEAST_LIMIT) -> DataFrame:
    """judged(host, failed) -> host, n, n_failed, rate (shrunk), host_ok. The prior and the limit are fitted over all hosts."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("seen"), F.avg(1 / F.col("n")).alias("few"))
    room = F.col("mean") * (1 - F.col("mean"))
    prior = prior.withColumn("var", F.greatest(F.col("seen") - room * F.col("few"), F.lit(0.0)))
    weight = F.when(F.col("var") > 0, F.least(F.greatest(room / F.col("var") - 1, F.lit(LEAST_WEIGHT)), F.lit(ALIKE))).otherwise(F.lit(ALIKE))
    limit = F.when(F.col("var") > 0, F.greatest(F.col("mean") + deviations * F.sqrt("var"), F.lit(least))).otherwise(F.lit(1.0))
    prior = prior.select("mean", weight.alias("weight"), limit.alias("limit"))
    hosts = hosts.crossJoin(F.broadcast(prior))  # one row
    hosts = hosts.withColumn("rate", (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight")))
    return hosts.select("host", "n", "n_failed", "rate", (F.col("rate") <= F.col("limit")).alias("host_ok"))


def quality(docs: DataFrame, host: str = "source", deviations: float = DEVIATIONS, least: float = LEAST_LIMIT) -> DataFrame:
    """docs(doc_id, text, host column) -> one row per input row with the base measures, base_failed, host_rate and kept.

    A null or empty text has no words and fails. Documents without a host (null)
    make up one host of their own. Repeated rows are judged each and each counts
    for its host. kept is false if the document fails the base rules or its
    host's shrunk failure rate is above the limit that is fitted to all hosts. With
    one host, or hosts that are alike, no host falls. An empty table gives an empty
    table. Other columns are ignored.
    """
    judged = docs.select("doc_id", F.col(host).alias("host"), measures(F.col("text")).alias("m"))
    judged = judged.select("doc_id", "host", F.col("m.w.n_words").alias("n_words"), F.col("m.w.word_chars").alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"), F.col("m.n_dup_lines").alias("n_dup_lines"), F.col("m.w.n_repeat_words").alias("n_repeat_words"))
    judged = judged.withColumn("failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    judged = save(judged, "judged")  # a few numbers a document: measured once, read for the hosts and for the result
    verdicts = host_verdicts(judged, deviations, least).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), "host_ok")
    out = judged.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), "host_rate", (~F.col("failed") & F.col("host_ok")).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("host_rate")


ORACLE = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(8) AS s(j) GROUP BY doc_id),
j AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS mean, greatest(coalesce(var_samp(k / n), 0) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n), 0) AS var FROM h),
q AS (SELECT mean, CASE WHEN var > 0 THEN greatest(mean + {DEVIATIONS}::DOUBLE * sqrt(var), {LEAST_LIMIT}::DOUBLE) ELSE 1 END AS most, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, {LEAST_WEIGHT}::DOUBLE), {ALIKE}::DOUBLE) ELSE {ALIKE}::DOUBLE END AS weight FROM p),
v AS (SELECT source, (k + mean * weight) / (n + weight) <= most AS ok FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
