"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those that a rule decides. Trees (logistic loss, depth
DEPTH, histogram splits) are fitted to at most SAMPLE of them, the first by a
hash of their ids. The suffix statistics (how many labelled URLs the last one, two
and three labels of a host have, and their blocked share, shrunk to the overall share)
cover all labelled URLs. They are out of fold: hosts are dealt into FOLDS by a
hash, and a host's statistics leave out all hosts of its fold, in the fit and in
the result alike, so no URL's label reaches its own features. A URL is blocked if its
probability is at least `threshold`. `held_out_accuracy` keeps whole hosts apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import save, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SAMPLE, TREES, DEPTH, RATE, BINS, LEAST = 20_000, 40, 4, 0.2, 32, 10
FOLDS, LABELS, PRIOR = 5, 3, 20
FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "path_digits", "hyphens", "host_entropy", "path_entropy", "parameters", "query_length", "fragment", "secure", *(f"{name}_{n}" for n in range(1, LABELS + 1) for name in ("suffix_count", "suffix_blocked")))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(hosts: list[str], paths: list[str], rules) -> tuple[list, list]:
    """The longest rule that fits each URL (of equal ones that of the longer host), and its verdict."""
    at: dict[str, list] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        at.setdefault(host, []).append((len(rule), len(host), slash + path, rule, verdict))
    out_rule, out_verdict = [], []
    for host, path in zip(hosts, paths, strict=True):
        best, suffix = None, host
        while suffix:
            for r in at.get(suffix, ()):
                if path.startswith(r[2]) and (best is None or r[:2] > best[:2]):
                    best = r
            suffix = suffix.partition(".")[2]
        out_rule.append(best and best[3])
        out_verdict.append(best and best[4])
    return out_rule, out_verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] / len(text.encode("utf-8", "replace"))
    return float(-(n * np.log2(n)).sum())


def lexical(f: pd.DataFrame) -> np.ndarray:
    """FEATURES of url, host, path and the counts and blocked shares of the host's suffixes."""
    url = f["url"].fillna("")
    query = url.str.partition("?")[2].str.partition("#")[0]
    digits = lambda s: s.str.count("[0-9]")
    return np.column_stack(
        [
            url.str.len(), f["host"].str.len(), f["path"].str.len(), f["host"].str.count(r"\.") + 1, f["path"].str.count("/[^/]"),
            digits(url) / url.str.len().clip(lower=1), digits(f["path"]), f["host"].str.count("-"), f["host"].map(_entropy), f["path"].map(_entropy),
            query.str.count("=") , query.str.len(), url.str.contains("#", regex=False).astype(int), url.str.startswith("https").astype(int),
            *(x for n in range(1, LABELS + 1) for x in (np.log1p(f[f"suffix_count_{n}"]), f[f"suffix_blocked_{n}"])),
        ]
    ).astype(float)


class Trees:
    """Boosted trees: (feature, threshold) at each inner node, values at the leaves; a row with x > threshold goes right."""

    def __init__(self, base: float, trees: list):
        self.base, self.trees = base, trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                right = x[np.arange(len(x)), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            out += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1e-3
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Trees(base, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score, trees = np.full(len(y), base), []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        inner = 2**DEPTH - 1
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS + 1)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            local = node - first
            gain, pick = np.full(count, 1e-9), [(0, None)] * count
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                sums = [np.bincount(local * (BINS + 1) + binned[:, j], v, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1) for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = [s[:, : len(c)] for s in sums], [s[:, -1:] for s in sums]
                worth = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                worth = np.where((nl >= LEAST) & (nt - nl >= LEAST), worth, 0)
                best = worth.argmax(axis=1)
                for k in range(count):
                    if worth[k, best[k]] > gain[k]:
                        gain[k], pick[k] = worth[k, best[k]], (j, best[k])
            for k, (j, b) in enumerate(pick):
                if b is not None:
                    feature[first + k], cut[first + k], at[first + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > at[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[leaf]
        trees.append((feature, cut, value))
    return Trees(base, trees)


def ruled_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url) -> one row per input row: page_id, url, host, path, rule, label (the rule's verdict; both null where none fits)."""

    def ruled(frames):
        for f in frames:
            f["rule"], f["label"] = matching_rule(f["host"].tolist(), f["path"].tolist(), rules)
            yield f

    host, path = host_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    return split.mapInPandas(ruled, "page_id long, url string, host string, path string, rule string, label string")


def _suffix(n: int) -> Column:
    """The last n labels of a host; null if it has fewer."""
    parts = F.split("host", r"\.")
    return F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, F.size(parts) - (n - 1), n)))


def host_statistics(ruled: DataFrame) -> DataFrame:
    """(host, suffix_count_1, suffix_blocked_1, ...) of every host, from the labelled URLs of hosts of other folds.

    Per-host and per-suffix sums are combined map-side, so a suffix with a third
    of all rows sends a row a task.
    """
    fold = F.pmod(F.crc32("host"), F.lit(FOLDS))
    labelled = F.col("label").isNotNull()
    hosts = ruled.groupBy("host").agg(F.count_if(labelled).alias("n"), F.count_if(F.col("label") == "block").alias("blocked"))
    hosts = save(hosts, "hosts")
    overall = hosts.agg(((F.sum("blocked") + 1) / (F.sum("n") + 2)).alias("share")).first().share
    overall = F.lit(0.5 if overall is None else float(overall))
    out = hosts.select("host", fold.cast("int").alias("fold"))
    for n in range(1, LABELS + 1):
        each = hosts.where("n > 0").select(_suffix(n).alias("of"), fold.cast("int").alias("f"), "n", "blocked").where("of is not null")
        sums = [F.sum(F.when(F.col("f") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("n", "blocked")]
        each = each.groupBy("of").agg(*sums).select("of", *[F.array(*[f"{c}{k}" for k in range(FOLDS)]).alias(c) for c in ("n", "blocked")])
        out = out.withColumn("suffix", _suffix(n)).join(each, F.col("suffix") == F.col("of"), "left")
        count = F.coalesce(F.col("n")[F.col("fold")], F.lit(0))
        blocked = F.coalesce(F.col("blocked")[F.col("fold")], F.lit(0))
        out = out.withColumn(f"suffix_count_{n}", count).withColumn(f"suffix_blocked_{n}", (blocked + PRIOR * overall) / (count + PRIOR)).drop("of", "suffix", "n", "blocked")
    return out.withColumnRenamed("host", "of_host").drop("fold")


def _fitted(rows: pd.DataFrame) -> Trees:
    rows = rows.sort_values(["page_id", "url"]).reset_index(drop=True)
    return fit(lexical(rows), (rows["label"] == "block").to_numpy(float)) if len(rows) else fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def _sampled(df: DataFrame, sample: int) -> pd.DataFrame:
    return df.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(sample).toPandas()


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """pages(page_id, url) -> one row per input row: page_id, host, path, rule (null where none fits), verdict, score (probability of block).

    A null url, or one without `://`, has an empty host and path, fits no rule
    and is judged by the trees on these. Repeated rows are judged each. Without
    labelled URLs, or with one label only, the trees are the base rate alone: 0.001 and so
    allow without any. An empty table gives an empty table. Other columns are ignored.
    """
    split = save(ruled_urls(pages, rules), "urls")
    whole = split.join(host_statistics(split), F.col("host") == F.col("of_host")).drop("of_host")
    model = _fitted(_sampled(whole.where("label is not null"), sample))

    def scored(frames):
        for f in frames:
            f["score"] = model.scores(lexical(f))
            f["verdict"] = f["label"].where(f["label"].notna(), np.where(f["score"] >= threshold, "block", "allow"))
            yield f[["page_id", "host", "path", "rule", "verdict", "score"]]

    return whole.mapInPandas(scored, "page_id long, host string, path string, rule string, verdict string, score double")


def held_out_accuracy(pages: DataFrame, rules=RULES, threshold: float = 0.5, sample: int = SAMPLE) -> dict[str, float]:
    """Trees fitted to the labelled URLs of other hosts, held against those of every fifth host by hash: rows, accuracy, and that of the more frequent label.

    The suffix statistics of either side come from the hosts of the fit alone.
    """
    split = save(ruled_urls(pages, rules), "urls")
    apart = F.pmod(F.xxhash64("host", F.lit("apart")), F.lit(5)) == 0
    blind = host_statistics(split.withColumn("label", F.when(~apart, F.col("label"))))
    whole = split.where("label is not null").join(blind, F.col("host") == F.col("of_host"))
    model = _fitted(_sampled(whole.where(~apart), sample))
    test = _sampled(whole.where(apart), sample)
    if not len(test):
        return {"rows": 0, "accuracy": 0.0, "frequent": 0.0}
    block = (test["label"] == "block").to_numpy()
    return {"rows": len(test), "accuracy": float(((model.scores(lexical(test)) >= threshold) == block).mean()), "frequent": float(max(block.mean(), 1 - block.mean()))}


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 decides by its rules alone, for the check by SQL."""
    return ruled_urls(table(spark, sf_dir, "pages")).drop("url")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_ORACLE = f"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(label, rule) AS (VALUES {', '.join(f"('{v}', '{r}')" for v, r in RULES)}),
p AS (SELECT label, rule, split_part(rule, '/', 1) AS of_host, substr(rule, strpos(rule, '/')) AS of_path FROM r),
f AS (SELECT k, rule, label FROM s JOIN p ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path) QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, length(of_host) DESC) = 1)
SELECT page_id, host, path, rule, label FROM s LEFT JOIN f USING (k)
"""
