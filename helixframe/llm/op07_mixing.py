"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget runs down the tree: each
node splits its budget among its children by weight, none gets more than it can
give (its tokens times max_epochs), and what a child cannot take goes to its
siblings before it is missed at their parent, so shortages rise only when all
siblings are full. Each level is one water-filling by window sums over the
children of a node, in whole tokens.

A leaf's budget buys full epochs and a token-prefix of one more, in the order of
a seeded hash. The prefix is found without sorting a leaf: token sums by the
first three hex digits of the hash tell the bucket where the budget ends, and
only that bucket's documents are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import SPACES, save, table

LEVELS = ("domain", "language", "source")


def fill(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """children(parent..., node, cap, weight, budget of the parent) -> with budget replaced by the child's own.

    Children are taken in order of cap / weight. Those at the front whose cap is
    below their share of what is left are full; the rest split what then
    remains by weight, rounded so that it adds up.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    c = children.withColumn("had", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0))).withColumn("all_weight", F.sum("weight").over(whole))
    money = F.least(F.col("budget"), F.sum("cap").over(whole))
    c = c.withColumn("money", money)
    left, weight = F.col("money") - F.col("had"), F.col("all_weight") - F.col("passed")
    # a child is full if its share of what its predecessors leave is at least its cap; once one isn't, no later one is
    c = c.withColumn("full", (left.cast("decimal(38,0)") * F.col("weight") >= F.col("cap").cast("decimal(38,0)") * weight).cast("int"))
    c = c.withColumn("full", F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("spent", F.sum(F.col("full") * F.col("cap")).over(whole)).withColumn("out", F.sum(F.col("full") * F.col("weight")).over(whole))
    rest, share = F.col("money") - F.col("spent"), F.col("all_weight") - F.col("out")
    upto = F.col("passed") - F.col("out")

    def floor(w: Column) -> Column:
        # whole tokens of rest * w / share; decimals hold the product exactly
        return F.call_function("div", rest.cast("decimal(20,0)") * w.cast("decimal(18,0)"), F.greatest(share, F.lit(1)).cast("decimal(20,0)")).cast("long")

    own = F.when(F.col("full") == 1, F.col("cap")).otherwise(F.least("cap", floor(upto + F.col("weight")) - floor(upto)))
    return c.withColumn("budget", own).drop("had", "passed", "all_weight", "money", "full", "spent", "out")


def budgets(leaves: DataFrame, total, max_epochs: int, weights) -> DataFrame:
    """leaves(domain, language, source, tokens) -> with budget. weights: functions of the level's columns, each a whole number of at least 1."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    found = None
    for depth, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = caps.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", weights[depth])
        if found is None:
            nodes = nodes.crossJoin(total)  # one row
        else:
            nodes = nodes.join(found.select(*parent, "budget"), parent)
        found = fill(nodes, parent, level)
    return leaves.join(found.select(*LEVELS, "budget"), list(LEVELS))


def mix(docs: DataFrame, domain: Column, weights, percent: int = 90, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, lang, source) -> one row per input row: doc_id, sum (md5 of the text), domain, language, source, n_tokens, copies.

    Tokens are words. The budget is `percent` of all tokens. copies is how often
    the mixture takes the document (0 to max_epochs). Null languages and sources
    are leaves of their own ('?'). Documents without words are taken in full
    epochs only, as they cost nothing and prefixes are of tokens. Repeated rows
    are counted each; those that share a doc_id and a text stand at the same place of an
    epoch and are taken or left together, if their tokens fit together. An empty
    table gives an empty table. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    word = F.array_size(F.array_remove(F.split(text, f"[{SPACES}]+"), "")).cast("long")
    rows = docs.select("doc_id", domain.alias("domain"), F.coalesce("lang", F.lit("?")).alias("language"), F.coalesce("source", F.lit("?")).alias("source"), word.alias("n_tokens"), F.md5(text).alias("sum"))
    leaf = list(LEVELS)
    rows = save(rows, "mixed")
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(percent) / 100).cast("long").alias("budget"))
    plan = budgets(leaves, total, max_epochs, weights)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs).cast("long"), F.expr("budget div greatest(tokens, 1)"))).otherwise(0))
    plan = save(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "plan")
    marked = rows.join(plan.select(*leaf, "epochs", "rest"), leaf)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), "sum"))
    marked = marked.withColumn("place", place).withColumn("bucket", F.substring("place", 1, 3))
    sums = marked.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket")) - F.col("n"))  # 4096 rows a leaf at most
    cut = sums.where("before <= rest and rest < before + n").select(*leaf, F.col("bucket").alias("cut"), F.col("before"))
    marked = marked.join(cut, leaf, "left")
    inside = Window.partitionBy(*leaf, "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    split = F.col("bucket") == F.col("cut")
    ends = marked.where(split).withColumn("end", F.col("before") + F.sum("n_tokens").over(inside))
    sure = marked.where(F.coalesce(~split, F.lit(True))).withColumn("end", F.lit(None).cast("long"))
    # no cut: all of the leaf fits, which only a leaf without tokens or rest does
    more = F.when(F.col("rest") <= 0, 0).when(F.col("end").isNotNull(), (F.col("end") <= F.col("rest")).cast("int")).otherwise((F.col("bucket") < F.col("cut")).cast("int"))
    taken = F.when(F.col("n_tokens") == 0, F.col("epochs")).otherwise(F.col("epochs") + F.coalesce(more, F.lit(0)))
    return ends.unionByName(sure).select("doc_id", "sum", *leaf, "n_tokens", taken.cast("int").alias("copies"))


def domain_of(source: Column) -> Column:
    """The domains of the driver's sources: the crawl src0, and two halves of the others by number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").when(number == "0", "crawl").when(number.cast("int") % 2 == 0, "books").otherwise("forums")


def default_weights() -> tuple[Column, Column, Column]:
    """Whole-number target weights of domains, of languages in a domain, and of sources in a language."""
    domain = F.when(F.col("domain") == "crawl", 30).when(F.col("domain") == "books", 40).when(F.col("domain") == "forums", 30).otherwise(5)
    language = F.when(F.col("language") == "en", 50).otherwise(20)
    return tuple(w.cast("long") for w in (domain, language, F.lit(1)))


def _fill_sql(name: str, nodes: str, keys: tuple[str, ...], parent: tuple[str, ...]) -> str:
    """CTEs name_a to name: `fill` in SQL."""
    per = f"PARTITION BY {', '.join(parent)} " if parent else ""
    order = f"{per}ORDER BY cap / weight, {keys[-1]}"
    floor = "((money - spent)::HUGEINT * ({0})) // greatest(aw - gone, 1)"
    return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS had, coalesce(sum(weight) OVER o, 0) AS passed, sum(weight) OVER w AS aw, least(budget, sum(cap) OVER w) AS money
        FROM ({nodes}) WINDOW o AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS ({per})),
    {name}_b AS (SELECT *, min(((money - had)::HUGEINT * weight >= cap::HUGEINT * (aw - passed))::INT) OVER ({order} ROWS UNBOUNDED PRECEDING) AS full FROM {name}_a),
    {name}_c AS (SELECT *, sum("full" * cap) OVER w AS spent, sum("full" * weight) OVER w AS gone FROM {name}_b WINDOW w AS ({per})),
    {name} AS (SELECT {', '.join(keys)}, (CASE WHEN "full" = 1 THEN cap ELSE least(cap, {floor.format('passed - gone + weight')} - {floor.format('passed - gone')}) END)::BIGINT AS budget FROM {name}_c)"""


_NODES = "SELECT {0}, sum(2 * tokens)::BIGINT AS cap, {1}::BIGINT AS weight{2} FROM leaves {3} GROUP BY ALL"
_DOMAIN = "CASE WHEN domain = 'crawl' THEN 30 WHEN domain = 'books' THEN 40 WHEN domain = 'forums' THEN 30 ELSE 5 END"
_NUMBER = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS sum, CASE WHEN {_NUMBER} = '' THEN 'other' WHEN {_NUMBER} = '0' THEN 'crawl' WHEN {_NUMBER}::INT % 2 = 0 THEN 'books' ELSE 'forums' END AS domain,
    coalesce(lang, '?') AS language, coalesce(source, '?') AS source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * 90 / 100)::BIGINT AS budget FROM leaves),
{_fill_sql("f1", _NODES.format("domain", _DOMAIN, ", any_value(budget) AS budget", "CROSS JOIN total"), LEVELS[:1], ())},
{_fill_sql("f2", _NODES.format("domain, language", "CASE WHEN language = 'en' THEN 50 ELSE 20 END", ", any_value(budget) AS budget", "JOIN f1 USING (domain)"), LEVELS[:2], LEVELS[:1])},
{_fill_sql("f3", _NODES.format("domain, language, source", "1", ", any_value(budget) AS budget", "JOIN f2 USING (domain, language)"), LEVELS, LEVELS[:2])},
p AS (SELECT f3.*, CASE WHEN tokens > 0 THEN least(2, budget // greatest(tokens, 1)) ELSE 0 END AS epochs, tokens FROM f3 JOIN leaves USING (domain, language, source)),
m AS (SELECT d.*, epochs, budget - epochs * tokens AS rest, md5('7:' || epochs || ':' || coalesce(doc_id::VARCHAR, '?') || ':' || sum) AS place FROM d JOIN p USING (domain, language, source)),
e AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM m)
SELECT doc_id, sum, domain, language, source, n_tokens, (epochs + (n_tokens > 0 AND rest > 0 AND upto <= rest)::INT)::INT AS copies FROM e
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_of(F.col("source")), default_weights())
