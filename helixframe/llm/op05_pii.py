"""Personal data by fixed rules and by bootstrapped contextual extraction, in DataFrame functions only.

The fixed rules give the base spans, which seed the method. Candidates are other
strings of a form that a kind can have: addresses written with [at] or without a
point, hexadecimal groups, and stretches of numbers, of which every part with
the digits of a kind is one (a rule takes the longest stretch and drops it, so
a card behind a phone number is in no base span). Each seed and each candidate induces lexical patterns:
the words (what has a letter) before and behind it, alone, together and with a typed gap, and its own form, with
and without the number of its digits and its first character.

Spark scores the graph of patterns and instances in rounds. A pattern's score for
a kind is the sum of its distinct instances' scores for that kind over the number of all its instances,
those of other kinds and those that fail the kind's arithmetic included, and PRIOR more; it needs SUPPORT
instances' worth. A seed's score is 1, that of a candidate that fails (Luhn) 0, that of another its best
pattern's, so what is found seeds further patterns in the next round. Candidates with CONFIDENT or more become spans;
where some of a kind overlap the first stands, of equal starts the longest.

The graph holds seeds and candidates only; its sums are combined map-side, so a
pattern of a third of all spans sends one row a task. Words are those of the CONTEXT characters on either side.

The regular expressions below match what the published rules match: a run is
entered at its start or where the last match ended (\\G) and never given back,
which keeps them linear on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import drop, let, save, table

KINDS = ("email", "ip", "card", "phone")
RULES = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?=(?:[0-9][\x20-]?){14})[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A cheap test without which a text has no match of the rule.
HINTS = ("@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?:[0-9][\x20-]?){14}", r"\+[0-9]")
#: Candidates: addresses, hexadecimal groups, stretches of numbers; and for each what it implies.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]++)*+"
HEX = r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])"
NUMBERS = r"(?<![\w.+])\+?\(?[0-9]++(?!\w)(?:[().\x20-]++[0-9]++(?!\w))*+"
CANDIDATES = ((MAIL, r"@|\[at\]|\(at\)"), (HEX, r"[0-9A-Fa-f](?::[0-9A-Fa-f]{0,4}){3}"), (NUMBERS, r"[0-9]"))
#: Without this a stretch of numbers has too few digits for any kind.
DIGITS, FEWEST, MOST = r"(?:[0-9][().\x20-]*+){10}", 10, 19
ROUNDS, CONFIDENT, SUPPORT, PRIOR, CONTEXT, NEAR = 4, 0.8, 5, 1.0, 80, 64
_SPANS = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"
_BLOCK = 256


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it, in blocks, as appending copies an array."""

    def sums(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def joined(blocks: Column) -> Column:
        return let(sums(F.transform(blocks, lambda b: b["at"])), lambda top: F.flatten(F.zip_with(blocks, top["out"], lambda b, at: F.transform(b["out"], lambda x: x + at))))

    count = F.floor((F.size(sizes) + (_BLOCK - 1)) / _BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(1), count), lambda i: sums(F.slice(sizes, (i - 1) * _BLOCK + 1, F.lit(_BLOCK))))
    return F.when(F.size(sizes) == 0, F.expr("cast(array() as array<int>)")).when(F.size(sizes) <= _BLOCK, sums(sizes)["out"]).otherwise(let(cut, joined))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern, with what stands beside them: what lies between its matches and the matches themselves add up to their places."""

    def spans(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(gaps, found, lambda gap, value: F.length(gap) + F.coalesce(F.length(value), F.lit(0)))

        def span(value: Column, i: Column, before: Column) -> Column:
            start = before[i] + F.length(gaps[i])
            left, right = F.right(gaps[i], F.lit(CONTEXT)), F.substring(gaps[i + 1], 1, CONTEXT)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), left.alias("left"), right.alias("right"))

        return let(_before(sizes), lambda before: F.transform(found, lambda value, i: span(value, i, before)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, _none()).otherwise(let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps))))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) > 3, False).when(plain == "", True).otherwise(plain.cast("int") <= 255)


def _valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == 1:
        return F.forall(F.split(value, r"\."), _octet)
    if kind == 2:
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _passes(kind: int):
    return lambda s: _valid(kind, s["value"])


def _is(kind: int):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    each = []
    for kind, rule in enumerate(RULES):
        hint = text.contains("@") if kind == 0 else text.rlike(HINTS[kind])
        each.append(F.when(hint, F.filter(_matches(text, rule, kind), _passes(kind))).otherwise(_none()))
    return F.sort_array(F.concat(*each))


def candidate_spans(text: Column) -> Column:
    """Addresses, hexadecimal groups and stretches of numbers with enough digits (of kind -1)."""
    each = []
    for kind, (pattern, hint) in enumerate(CANDIDATES):
        number = pattern is NUMBERS
        found = _matches(text, pattern, -1 if number else kind)
        found = F.filter(found, lambda s: s["value"].rlike(DIGITS)) if number else found
        each.append(F.when(text.rlike(DIGITS if number else hint), found).otherwise(_none()))
    return F.concat(*each)


def _written(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _form(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[^\\W\\d_]+", "a")


def _patterns(value: Column, left: Column, right: Column) -> Column:
    """Hashes of the lexical patterns that a string and its surroundings induce."""

    def of(l: Column, r: Column, form: Column) -> Column:
        one, two, next_ = F.get(l, F.size(l) - 1), F.get(l, F.size(l) - 2), F.get(r, F.lit(0))
        loose = F.regexp_replace(form, "9+", "9")
        gap = F.regexp_replace(_form(one), "9+", "9")
        texts = [("before", (one,)), ("two before", (two, one)), ("before a gap", (two, gap)), ("behind", (next_,)), ("around", (one, next_)), ("form", (form,)), ("loose form", (loose,)), ("first", (F.substring(value, 1, 1), form))]
        hashed = [F.when(F.concat(*parts).isNotNull(), F.xxhash64(F.lit(name), *parts)) for name, parts in texts]
        return F.array_compact(F.array(*hashed))

    words = lambda text: F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return let(words(left), lambda l: let(words(right), lambda r: let(_form(value), lambda form: of(l, r, form))))


def parts_of_numbers(runs: DataFrame) -> DataFrame:
    """runs(key, s: a span of numbers) -> (key, start, end, value, left, right) of its stretches of whole numbers with FEWEST to MOST digits together.

    As each number has a digit, a stretch is at most MOST numbers, so a table gives at most so many for each of its numbers.
    """
    parts = F.regexp_extract_all("s.value", F.lit("[^0-9]*[0-9]+"), F.lit(0))
    df = runs.select("key", "s", parts.alias("parts"))
    df = df.withColumn("at", _before(F.transform("parts", lambda x: F.length(x)))).withColumn("digits", F.transform("parts", lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))))

    def beginning(part: Column, i: Column) -> Column:
        before = F.concat_ws("", F.slice("parts", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))))
        w, d = F.slice("parts", i + 1, F.lit(MOST + 2)), F.slice("digits", i + 1, F.lit(MOST))
        return F.struct(w.alias("w"), d.alias("d"), (F.col("s.start") + F.col("at")[i]).alias("start"), F.when(i < 2, F.concat("s.left", before)).otherwise(before).alias("left"), (F.size("parts") - i).alias("more"))

    df = df.select("key", F.col("s.right").alias("after"), F.explode(F.transform("parts", beginning)).alias("b"))
    total = lambda n: F.aggregate(F.slice("b.d", F.lit(1), n), F.lit(0), lambda a, x: a + x)
    fit = F.filter(F.sequence(F.lit(1), F.size("b.d")), lambda n: total(n).between(FEWEST, MOST))

    def stretch(n: Column) -> Column:
        behind = F.concat_ws("", F.slice("b.w", n + 1, F.lit(2)))
        right = F.when(F.col("b.more") - n < 2, F.concat(behind, "after")).otherwise(behind)
        return F.struct(F.concat_ws("", F.slice("b.w", F.lit(1), n)).alias("value"), right.alias("right"))

    df = df.select("key", "b", F.explode(F.transform(fit, stretch)).alias("e"))
    value = F.regexp_replace("e.value", "^[^+(0-9]+", "")
    df = df.select("key", value.alias("value"), (F.col("b.start") + F.length("e.value") - F.length(value)).alias("start"), F.col("b.left").alias("left"), F.col("e.right").alias("right"))
    return df.select("key", "start", (F.col("start") + F.length("value")).alias("end"), "value", "left", "right")


def _kinds_of_numbers(value: Column) -> Column:
    """What a stretch of numbers can be: (kind, whether it fails)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = F.when(F.length(digits).between(14, 19) & value.rlike(r"^[0-9\x20-]+$"), F.struct(F.lit(2).alias("kind"), (~_luhn(digits)).alias("fails")))
    phone = F.when(F.length(digits).between(10, 15), F.struct(F.lit(3).alias("kind"), F.lit(False).alias("fails")))
    return F.array_compact(F.array(card, phone))


def _near(df: DataFrame) -> DataFrame:
    """A row for each NEAR characters that a span touches."""
    return df.select("key", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / NEAR), F.floor((F.col("end") - 1) / NEAR))).alias("near"))


def discovered(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """seeds(key, start, kind, end, value, left, right), others(key, start, end, value, left, right, kinds: array of (kind, fails)) -> (key, start, kind, end, value) that confident patterns add.

    Others that overlap a seed count for nothing. Equal rows count once.
    """
    touched = _near(others).join(_near(seeds).withColumnsRenamed({"start": "s0", "end": "s1"}), ["key", "near"]).where("start < s1 and s0 < end").select("key", "start", "end").distinct()
    others = save(others.join(touched, ["key", "start", "end"], "left_anti"), "others")
    pattern = F.explode(_patterns(F.col("value"), F.col("left"), F.col("right"))).alias("pattern")
    known = seeds.select("value", "kind", pattern).distinct().select("pattern", F.xxhash64("value").alias("instance"), "kind", F.lit(True).alias("seed"), F.lit(False).alias("fails"))
    maybe = others.select("value", "kinds", pattern).distinct().select("pattern", F.xxhash64("value").alias("instance"), F.explode("kinds").alias("k"))
    edges = known.union(maybe.select("pattern", "instance", "k.kind", F.lit(False), "k.fails")).groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed"), F.max("fails").alias("fails"))
    edges = save(edges, "edges")
    able = edges.groupBy("pattern", "instance").agg(F.max(~F.col("seed") & ~F.col("fails")).alias("open")).groupBy("pattern").agg(F.count("*").alias("total"), F.max("open").alias("open"))
    edges = save(edges.join(able.where(f"total >= {SUPPORT} and open").select("pattern", "total"), "pattern"), "able")
    scored = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    best = None
    for _ in range(ROUNDS):
        patterns = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("worth"), F.max("total").alias("total")).where(f"worth >= {SUPPORT}")
        patterns = patterns.select("pattern", "kind", (F.col("worth") / (F.col("total") + PRIOR)).alias("p"))
        before, best = best, save(edges.where("not seed and not fails").join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("p").alias("best")), "best")
        scored = edges.join(best, ["instance", "kind"], "left").withColumn("score", F.when(F.col("seed"), 1.0).when(F.col("fails"), 0.0).otherwise(F.coalesce("best", F.lit(0.0)))).drop("best")
        drop(before)
    good = best.where(f"best >= {CONFIDENT}").select("instance", "kind")
    found = others.withColumn("instance", F.xxhash64("value")).withColumn("k", F.explode("kinds")).where("not k.fails").withColumn("kind", F.col("k.kind"))
    return found.join(good, ["instance", "kind"], "left_semi").select("key", "start", "kind", "end", "value").distinct()


def _apart(spans: Column) -> Column:
    """Of one kind's (start, less, end, value) those that overlap none before them."""
    none = F.expr("cast(array() as array<struct<start:int,less:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("until"), none.alias("out"))
    kept = lambda acc, s: F.when(s["start"] >= acc["until"], F.struct(s["end"].alias("until"), F.array_append(acc["out"], s).alias("out"))).otherwise(acc)
    return F.aggregate(F.sort_array(spans), start, kept, lambda acc: acc["out"])


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, candidates) of every row, written once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    return save(rows.select("doc_id", key.alias("key"), base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("candidates")), "found")


def _graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds and other candidates, a row each."""
    seeds = found.select("key", F.explode("base").alias("s")).select("key", "s.*").distinct()
    spans = found.select("key", F.explode("candidates").alias("s")).distinct()
    whole = spans.where("s.kind >= 0").select("key", "s.start", "s.end", "s.value", "s.left", "s.right", F.array(F.struct(F.col("s.kind").alias("kind"), F.lit(False).alias("fails"))).alias("kinds"))
    parts = parts_of_numbers(spans.where("s.kind < 0")).withColumn("kinds", _kinds_of_numbers(F.col("value"))).where("size(kinds) > 0")
    return seeds, whole.union(parts)


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, n_email, n_ip, n_card, n_phone, base, spans (arrays of start, kind, end, value).

    Null and empty texts have no spans. Rows that repeat a doc_id are judged each
    by their own text. An empty table gives an empty table. Other columns are
    ignored. Places are code points, ends exclusive. Spans that the method adds overlap no base span.
    """
    found = _read(docs)
    more = discovered(*_graph(found))
    more = more.groupBy("key", "kind").agg(F.collect_set(F.struct("start", (F.col("start") - F.col("end")).alias("less"), "end", "value")).alias("of"))
    more = more.select("key", F.transform(_apart(F.col("of")), lambda s: F.struct(s["start"].alias("start"), F.col("kind"), s["end"].alias("end"), s["value"].alias("value"))).alias("of"))
    more = more.groupBy("key").agg(F.flatten(F.collect_list("of")).alias("more"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    out = found.select("doc_id", "key", base.alias("base")).join(more, "key", "left")
    out = out.withColumn("spans", F.sort_array(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")))))
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *count, "base", "spans")


def hidden_recall(docs: DataFrame, every: int = 5) -> DataFrame:
    """(kind, hidden, found): of each `every`-th base value by hash, which the method does not get as a seed, how many it finds."""
    seeds, others = _graph(_read(docs))
    hide = F.pmod(F.xxhash64("value", F.lit("hide")), F.lit(every)) == 0
    hidden = seeds.where(hide).select("key", "start", "end", "value", "left", "right", F.array(F.struct("kind", F.lit(False).alias("fails"))).alias("kinds"))
    got = discovered(seeds.where(~hide), others.union(hidden)).select("key", "start", "kind", "end").distinct().withColumn("got", F.lit(1))
    all_ = hidden.select("key", "start", "end", F.col("kinds")[0]["kind"].alias("kind")).distinct()
    return all_.join(got, ["key", "start", "kind", "end"], "left").groupBy("kind").agg(F.count("*").alias("hidden"), F.count("got").alias("found"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op5 alone, for the check by SQL."""
    rows = table(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return rows.select("doc_id", *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_written(F.col("base")), 256).alias("base_sha256"))


#: The rules as they are published.
_PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
_EACH = " UNION ALL ".join(f"SELECT k, {i} AS kind, regexp_extract_all(text, '{p}') AS found, regexp_split_to_array(text, '{p}') AS gaps FROM d" for i, p in enumerate(_PLAIN))
_LUHN = "list_sum(list_transform(list_reverse(string_split(digits, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_PARTS = "list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (ltrim(p, '0') <> '' AND ltrim(p, '0')[:3]::INT > 255))"
BASE_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_EACH}),
u AS (SELECT k, kind, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM m WHERE len(found) > 0),
v AS (SELECT k, kind, i, found[i] AS value, length(gaps[i]) AS gap FROM u),
s AS (SELECT k, kind, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits, (sum(gap + length(value)) OVER (PARTITION BY k, kind ORDER BY i) - length(value))::BIGINT AS start FROM v),
ok AS (SELECT * FROM s WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN len({_PARTS}) = 0 WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND {_LUHN} ELSE length(digits) BETWEEN 10 AND 15 END),
a AS (SELECT k, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{name}" for i, name in enumerate(KINDS))}, string_agg({list(KINDS)}[kind + 1] || ':' || start || ':' || (start + length(value)), ',' ORDER BY start, kind) AS spans FROM ok GROUP BY k)
SELECT doc_id, {', '.join(f"coalesce(n_{name}, 0) AS n_{name}" for name in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (k)
"""
