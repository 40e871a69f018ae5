"""The search engine's queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import alphabet, kmers, seeds, settings
from helixframe.operators import align, info, primers, queries as qs, retrieve, stages
from helixframe.operators import index as ix
from helixframe.plans import bridge
from helixframe.plans.primers import search_primers
from helixframe.plans.search import SearchConfig, notes, search
from helixframe.sources import sinks

K, SMALL, SPAN, SHARE = 11, 8, 16, 0.5

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL building blocks -------------------------------------------------------


def _value(seq: str, pos: str, at: list[int]) -> str:
    """A k-mer's number; pos counts from 0."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({seq}, {pos} + {o + 1}, 1)) - 1) * {4 ** (len(at) - 1 - i)}" for i, o in enumerate(at)) + ")::BIGINT"


def _letters(seq: str, pos: str, at: list[int]) -> str:
    """A k-mer as text: enough wherever only equality counts."""
    if at == list(range(len(at))):
        return f"substr({seq}, {pos} + 1, {len(at)})"
    return " || ".join(f"substr({seq}, {pos} + {o + 1}, 1)" for o in at)


def _windows(name: str, source: str, keys: str, k: int = K, at: list[int] | None = None) -> str:
    at = at or list(range(k))
    windows = f"SELECT *, substr(seq, p + 1, {at[-1] + 1}) AS w FROM (SELECT *, unnest(range(0, length(seq) - {at[-1]})) AS p FROM {source})"
    return f"{name} AS (SELECT {keys}, p AS pos, {_letters('w', '0', at)} AS kmer FROM ({windows}))"


_TURN = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_S, _Q = bridge.SEQUENCES_SQL, bridge.QUERIES_SQL
_RC = f"t AS (SELECT qseqid, {_TURN.format('seq')} AS seq FROM q)"


def _stage1(k: int, strand: str = "+", score: str = "count(DISTINCT h.q_pos)", where: str = "", at: list[int] | None = None) -> str:
    """CTEs to `c`: candidates of one strand, no frequency filter, threshold a share of the query's places."""
    if strand == "+":
        q = _windows("qk", "q", "qseqid", k, at)
    else:
        q = f"{_RC}, {_windows('qt', 't', 'qseqid, length(seq) AS n', k, at)}, qk AS (SELECT qseqid, n - pos - {(at or list(range(k)))[-1] + 1} AS pos, kmer FROM qt)"
    return f"""{_S}, {_Q}, {q}, {_windows('sk', 's', 'volume, oid', k, at)},
        n AS (SELECT qseqid, ceil(count(DISTINCT pos) * {SHARE}::DOUBLE)::BIGINT AS threshold FROM qk GROUP BY qseqid),
        h AS (SELECT qk.qseqid, sk.volume, sk.oid, qk.pos AS q_pos, sk.pos AS s_pos FROM qk JOIN sk USING (kmer) {where}),
        a AS (SELECT qseqid, volume, oid, {score} AS score FROM h GROUP BY ALL),
        c AS (SELECT a.* FROM a JOIN n USING (qseqid) WHERE score >= threshold AND threshold > 0)"""


_NAMED = "SELECT 'D' || doc_id AS accession FROM labels WHERE quality = 1"
_SCORE = "SELECT qseqid, '{0}' AS strand, volume, oid, score FROM c"


def _parts(spark: SparkSession, sf_dir: str, k: int = K, strand: int = 1, span: int = 0, template: str = seeds.CONTIGUOUS):
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir)
    qk = qs.query_kmers(q, k, span, template, 16, strand)
    return s, q, qk, ix.postings(s, k, span, template)


def _limits(qk: DataFrame) -> DataFrame:
    return qs.thresholds(qk, qk.select("kmer").limit(0), SHARE, 0)


def _candidates(qk: DataFrame, s: DataFrame, k: int = K, subjects: tuple[DataFrame, str] | None = None, matches: bool = False) -> DataFrame:
    return stages.candidates([stages.Sought(qk, seeds.offsets(k))], s, _limits(qk), subjects, matches)


# k-mers --------------------------------------------------------------------


@query(f"WITH {_Q} SELECT qseqid, p::INT AS pos, {_value('seq', 'p', list(range(K)))} AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {K - 1})) AS p FROM q)")
def kmer_scan(spark, sf_dir):
    return kmers.kmers(bridge.queries(spark, sf_dir), ["qseqid"], "seq", seeds.offsets(K))


@query(f"WITH {_S}, {_windows('sk', 's', 'oid', SMALL)}, c AS (SELECT kmer, count(*) AS n FROM sk GROUP BY kmer) SELECT {_value('kmer', '0', list(range(SMALL)))} AS kmer, n FROM c")
def kmer_counts(spark, sf_dir):
    return ix.occurrences(bridge.sequences(spark, sf_dir), SMALL)


@query(f"WITH {_Q}, {_RC} SELECT qseqid, seq FROM t")
def revcomp(spark, sf_dir):
    return bridge.queries(spark, sf_dir).select("qseqid", alphabet.reverse_complement(F.col("seq")).alias("seq"))


def _spaced_sql(template: str) -> str:
    at = seeds.offsets(K, SPAN, template)
    return f"WITH {_Q} SELECT qseqid, p::INT AS pos, {_value('seq', 'p', at)} AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {SPAN - 1})) AS p FROM q)"


@query(_spaced_sql(seeds.CODING))
def spaced_kmers_cod(spark, sf_dir):
    return kmers.kmers(bridge.queries(spark, sf_dir), ["qseqid"], "seq", seeds.offsets(K, SPAN, seeds.CODING))


@query(_spaced_sql(seeds.OPTIMAL))
def spaced_kmers_opt(spark, sf_dir):
    return kmers.kmers(bridge.queries(spark, sf_dir), ["qseqid"], "seq", seeds.offsets(K, SPAN, seeds.OPTIMAL))


_WAYS = "list_filter(['A', 'C', 'G', 'T'], lambda b: contains(CASE substr(seq, p + {0}, 1) WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'S' THEN 'CG' WHEN 'N' THEN 'ACGT' ELSE substr(seq, p + {0}, 1) END, b))"
_AT5 = ", ".join(f"{_WAYS.format(i + 1)} AS w{i}" for i in range(5))
_EXPAND_SQL = f"""WITH q AS (SELECT item_id AS qseqid, {bridge.dna_sql('text', True)} AS seq FROM benchmark),
    w AS (SELECT qseqid, p, {_AT5} FROM (SELECT *, unnest(range(0, length(seq) - 4)) AS p FROM q)),
    ok AS (SELECT * FROM w WHERE {' * '.join(f'len(w{i})' for i in range(5))} <= 4),
    e0 AS (SELECT *, unnest(w0) AS b0 FROM ok), e1 AS (SELECT *, unnest(w1) AS b1 FROM e0), e2 AS (SELECT *, unnest(w2) AS b2 FROM e1), e3 AS (SELECT *, unnest(w3) AS b3 FROM e2), e4 AS (SELECT *, unnest(w4) AS b4 FROM e3)
    SELECT qseqid, p::INT AS pos, ({' + '.join(f"(strpos('ACGT', b{i}) - 1) * {4 ** (4 - i)}" for i in range(5))})::BIGINT AS kmer FROM e4"""


@query(_EXPAND_SQL)
def degenerate_expand(spark, sf_dir):
    return kmers.kmers(bridge.queries(spark, sf_dir, codes=True), ["qseqid"], "seq", seeds.offsets(5), 4)


@query(f"SELECT item_id AS qseqid, regexp_matches({bridge.dna_sql('text', True)}, '[RYSN]') AS degenerate FROM benchmark")
def skip_degenerate(spark, sf_dir):
    kept, skipped = qs.skip_degenerate(bridge.queries(spark, sf_dir, codes=True))
    return kept.select("qseqid", F.lit(False).alias("degenerate")).unionByName(skipped.select("qseqid", F.lit(True).alias("degenerate")))


# index ---------------------------------------------------------------------

_COUNTS = f"{_S}, {_windows('sk', 's', 'volume, oid', SMALL)}, c AS (SELECT kmer, count(*) AS n FROM sk GROUP BY kmer), l AS (SELECT greatest(1, ceil({SHARE}::DOUBLE * count(*))) AS most FROM s)"


def _small_threshold(s: DataFrame) -> int:
    return settings.build_threshold(SHARE, s.count())


@query(f"WITH {_COUNTS} SELECT {_value('kmer', '0', list(range(SMALL)))} AS kmer FROM c, l WHERE n > most")
def highfreq_kmers(spark, sf_dir):
    s = bridge.sequences(spark, sf_dir)
    return ix.frequent(ix.occurrences(s, SMALL), _small_threshold(s))


@query(f"WITH {_COUNTS} SELECT volume, oid, count(*) AS n FROM sk JOIN c USING (kmer), l WHERE n <= most GROUP BY volume, oid")
def index_exclude_anti(spark, sf_dir):
    built = ix.build(bridge.sequences(spark, sf_dir), SMALL, max_freq=SHARE)
    return built.postings.groupBy("volume", "oid").agg(F.count("*").alias("n"))


@query(f"WITH {_S}, {_windows('sk', 's', 'volume, oid', SMALL)} SELECT (SELECT count(*) FROM s) AS sequences, (SELECT sum(length(seq)) FROM s)::BIGINT AS bases, count(*) AS postings, count(DISTINCT kmer) AS kmers FROM sk")
def index_totals(spark, sf_dir):
    s = bridge.sequences(spark, sf_dir)
    return info.totals(s, ix.occurrences(s, SMALL))


_SLOTS = 4**SMALL
_P = ", ".join(f"round(quantile_cont(n, {p}::DOUBLE), 6) AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99))


@query(
    f"WITH {_COUNTS}, f AS (SELECT n FROM c UNION ALL SELECT 0 FROM range((SELECT {_SLOTS} - count(*) FROM c))) "
    f"SELECT count(*) FILTER (n > 0) AS kmers, min(n) FILTER (n > 0) AS least, max(n) AS most, round(sum(n)::DOUBLE / {_SLOTS}, 6) AS mean, {_P} FROM f"
)
def freq_stats(spark, sf_dir):
    out = info.frequency(ix.occurrences(bridge.sequences(spark, sf_dir), SMALL), SMALL)
    return out.select("kmers", "least", "most", *[F.round(c, 6).alias(c) for c in ("mean", "p25", "p50", "p75", "p95", "p99")])


@query(f"WITH {_S}, {_windows('sk', 's', 'oid', SMALL)} SELECT least(100000, greatest(1000, floor(10.0::DOUBLE * count(*) / {_SLOTS})))::BIGINT AS max_freq FROM sk")
def max_freq_auto(spark, sf_dir):
    n = ix.occurrences(bridge.sequences(spark, sf_dir), SMALL).agg(F.sum("n")).first()[0] or 0
    return spark.createDataFrame([(settings.search_threshold(0, 0, n, SMALL),)], "max_freq long")


# thresholds and stage 1 ----------------------------------------------------


@query(
    f"""WITH {_COUNTS}, {_Q}, {_windows('qk', 'q', 'qseqid', SMALL)}, hf AS (SELECT kmer FROM c, l WHERE n > most)
    SELECT qseqid, '+' AS strand, count(*) AS n_kmers, count(hf.kmer) AS n_high, greatest(0, ceil(count(*) * {SHARE}::DOUBLE)::BIGINT - count(hf.kmer)) AS threshold
    FROM qk LEFT JOIN hf USING (kmer) GROUP BY qseqid"""
)
def query_threshold(spark, sf_dir):
    s, q, qk, posts = _parts(spark, sf_dir, SMALL)
    counts = ix.kmer_counts(posts)
    high = qs.high_frequency(qk, counts, counts.select("kmer").limit(0), _small_threshold(s))
    return qs.thresholds(qk, high, SHARE, 0).drop("min_chain")


@query(f"WITH {_stage1(K)} {_SCORE.format('+')}")
def stage1_cover(spark, sf_dir):
    s, _, qk, _ = _parts(spark, sf_dir)
    return _candidates(qk, s)


@query(f"WITH {_stage1(K, score='count(*)')} {_SCORE.format('+')}")
def stage1_match(spark, sf_dir):
    s, _, qk, _ = _parts(spark, sf_dir)
    return _candidates(qk, s, matches=True)


@query(f"WITH {_stage1(SMALL, '-')} {_SCORE.format('-')}")
def stage1_minus(spark, sf_dir):
    s, _, qk, _ = _parts(spark, sf_dir, SMALL, -1)
    return _candidates(qk, s, SMALL)


def _both_sql() -> str:
    parts = []
    for t in (seeds.CODING, seeds.OPTIMAL):
        at = seeds.offsets(K, SPAN, t)
        parts.append(f"{_windows(f'qk_{t}', 'q', 'qseqid', K, at)}, {_windows(f'sk_{t}', 's', 'volume, oid', K, at)}, n_{t} AS (SELECT qseqid, ceil(count(DISTINCT pos) * {SHARE}::DOUBLE)::BIGINT AS n FROM qk_{t} GROUP BY qseqid), a_{t} AS (SELECT qseqid, volume, oid, count(DISTINCT qk_{t}.pos) AS score FROM qk_{t} JOIN sk_{t} USING (kmer) GROUP BY ALL)")
    return f"""WITH {_S}, {_Q}, {', '.join(parts)}, n AS (SELECT qseqid, sum(n) AS n FROM (FROM n_cod UNION ALL FROM n_opt) GROUP BY qseqid),
        a AS (SELECT qseqid, volume, oid, sum(score)::BIGINT AS score FROM (FROM a_cod UNION ALL FROM a_opt) GROUP BY ALL)
        SELECT qseqid, '+' AS strand, volume, oid, score FROM a JOIN n USING (qseqid) WHERE score >= n"""


@query(_both_sql())
def stage1_both(spark, sf_dir):
    sought, limits = [], []
    for t in seeds.templates(SPAN, "both"):
        s, _, qk, _ = _parts(spark, sf_dir, K, 1, SPAN, t)
        sought.append(stages.Sought(qk, seeds.offsets(K, SPAN, t)))
        limits.append(_limits(qk))
    return stages.candidates(sought, s, stages.merged(limits, ["qseqid", "strand"], threshold=F.sum("threshold")))


@query(f"WITH {_stage1(SMALL)} {_SCORE.format('+')} QUALIFY row_number() OVER (PARTITION BY qseqid, volume ORDER BY score DESC, volume, oid) <= 3")
def stage1_topn(spark, sf_dir):
    s, _, qk, _ = _parts(spark, sf_dir, SMALL)
    return stages.top(_candidates(qk, s, SMALL), 3, ["qseqid", "strand", "volume"], "score")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"))


@query(f"WITH {_stage1(SMALL, where=f'''JOIN s USING (volume, oid) WHERE accession IN ({_NAMED})''')} {_SCORE.format('+')}")
def oid_include(spark, sf_dir):
    s, _, qk, _ = _parts(spark, sf_dir, SMALL)
    return _candidates(qk, s, SMALL, stages.allowed(s, _named(spark, sf_dir)))


@query(f"WITH {_stage1(SMALL, where=f'''JOIN s USING (volume, oid) WHERE accession NOT IN ({_NAMED})''')} {_SCORE.format('+')}")
def oid_exclude(spark, sf_dir):
    s, _, qk, _ = _parts(spark, sf_dir, SMALL)
    return _candidates(qk, s, SMALL, stages.allowed(s, _named(spark, sf_dir), exclude=True))


# whole searches in SQL ------------------------------------------------------


def _found(select: str, ats: tuple = (tuple(range(K)),), strands: str = "+", high: float | None = None, queries: str = _Q, share: float = SHARE, least: str = "max(threshold)", gap: int = 100) -> str:
    """CTEs to `f`, chains with a lookback of 64, one for each candidate, and a last part. Chains grow hit by hit in a recursion: the first best hit before, of those that fit, goes on."""
    k, span = len(ats[0]), ats[0][-1] + 1
    parts, qk, sk = [], [], []
    for t, at in enumerate(map(list, ats)):
        parts.append(_windows(f"sk_{t}", "s", "volume, oid", k, at))
        sk.append(f"SELECT {t} AS t, volume, oid, pos, kmer FROM sk_{t}")
        if "+" in strands:
            parts.append(_windows(f"qp_{t}", "q", "qseqid", k, at))
            qk.append(f"SELECT {t} AS t, '+' AS strand, qseqid, pos, kmer FROM qp_{t}")
        if "-" in strands:
            parts.append(_windows(f"qm_{t}", "t", "qseqid, length(seq) AS n", k, at))
            qk.append(f"SELECT {t} AS t, '-' AS strand, qseqid, n - pos - {span} AS pos, kmer FROM qm_{t}")
    often = f"GROUP BY ALL HAVING count(*) > (SELECT greatest(1, ceil({high}::DOUBLE * count(*))) FROM s)" if high else "WHERE false"
    fits = "qs[j] < qs[i + 1] AND ss[j] < ss[i + 1] AND abs((ss[i + 1] - ss[j]) - (qs[i + 1] - qs[j])) <= " + str(gap)
    return f"""WITH RECURSIVE {_S}, {queries}, {_RC}, {', '.join(parts)},
        qk AS (SELECT * FROM ({' UNION ALL '.join(qk)}) WHERE NOT contains(kmer, 'N')), sk AS ({' UNION ALL '.join(sk)}),
        hf AS (SELECT t, kmer FROM sk {often}),
        lt AS (SELECT qseqid, strand, t, greatest(0, ceil(count(*) * {share}::DOUBLE)::BIGINT - count(hf.kmer)) AS threshold FROM qk LEFT JOIN hf USING (t, kmer) GROUP BY qseqid, strand, t),
        lim AS (SELECT qseqid, strand, sum(threshold) AS threshold, {least} AS least FROM lt GROUP BY ALL),
        h AS (SELECT t, qseqid, strand, sk.volume, sk.oid, qk.pos AS q_pos, sk.pos AS s_pos FROM qk JOIN sk USING (t, kmer) ANTI JOIN hf USING (t, kmer)),
        a AS (SELECT qseqid, strand, volume, oid, sum(n)::BIGINT AS score FROM (SELECT t, qseqid, strand, volume, oid, count(DISTINCT q_pos) AS n FROM h GROUP BY ALL) GROUP BY ALL),
        c AS (SELECT a.*, least FROM a JOIN lim USING (qseqid, strand) WHERE score >= threshold AND threshold > 0),
        d AS (SELECT DISTINCT qseqid, strand, volume, oid, score, least, CASE strand WHEN '-' THEN length(q.seq) - q_pos - {span} ELSE q_pos END AS q_pos, s_pos FROM h JOIN c USING (qseqid, strand, volume, oid) JOIN q USING (qseqid)),
        g AS (SELECT qseqid, strand, volume, oid, score, least, list(q_pos ORDER BY q_pos, s_pos) AS qs, list(s_pos ORDER BY q_pos, s_pos) AS ss, count(*) AS n FROM d GROUP BY ALL),
        r AS (SELECT qseqid, strand, volume, oid, 1::BIGINT AS i, [1::BIGINT] AS best, [1::BIGINT] AS root FROM g
            UNION ALL SELECT qseqid, strand, volume, oid, i + 1, list_append(best, m + 1), list_append(root, CASE WHEN m > 0 THEN root[low + list_position(v, m) - 1] ELSE i + 1 END)
            FROM (SELECT *, list_max(v) AS m FROM (SELECT r.*, greatest(1, i - 63) AS low, list_transform(range(greatest(1, i - 63), i + 1), lambda j: CASE WHEN {fits} THEN best[j] ELSE 0 END) AS v FROM r JOIN g USING (qseqid, strand, volume, oid) WHERE i < n))),
        e AS (SELECT r.*, qs, ss, score, least, list_max(best) AS top, list_position(best, list_max(best)) AS z FROM r JOIN g USING (qseqid, strand, volume, oid) WHERE i = n),
        x AS (SELECT e.*, qs[root[z]] AS q0, qs[z] + {span} AS q1, length(q.seq) AS qlen FROM e JOIN q USING (qseqid) WHERE top >= least),
        f AS (SELECT qseqid, strand, volume, oid, score, qlen, top::INT AS chainscore, (CASE strand WHEN '-' THEN qlen - q1 ELSE q0 END)::INT AS qstart, (CASE strand WHEN '-' THEN qlen - q0 ELSE q1 END)::INT AS qend, ss[root[z]]::INT AS sstart, (ss[z] + {span})::INT AS send FROM x)
        {select}"""


_CHAINS = "SELECT qseqid, strand, volume, oid, chainscore, qstart AS q_start, qend AS q_end, sstart AS s_start, send AS s_end FROM f"
_MODE2 = "SELECT qseqid, accession AS sseqid, strand AS sstrand, qstart, qend, qlen::INT AS qlen, sstart, send, length(s.seq)::INT AS slen, score AS coverscore, chainscore, volume, oid FROM {0} JOIN s USING (volume, oid)"
_BEST = "row_number() OVER (PARTITION BY {0} ORDER BY chainscore DESC, volume, oid, strand, sstart, qstart) <= 10"
_TOP10 = f"(SELECT * FROM (SELECT * FROM f QUALIFY {_BEST.format('qseqid, volume')}) QUALIFY {_BEST.format('qseqid')})"

# stage 2 -------------------------------------------------------------------

_HITS = f"{_stage1(K)}, d AS (SELECT DISTINCT qseqid, '+' AS strand, volume, oid, q_pos, s_pos FROM h SEMI JOIN c USING (qseqid, volume, oid))"
_HITS_COLUMNS = "qseqid, strand, volume, oid, q_pos::INT AS q_pos, s_pos::INT AS s_pos"


def _hits(spark: SparkSession, sf_dir: str, strand: int = 1):
    ix.release()  # what the query before has kept
    s, q, qk, _ = _parts(spark, sf_dir, K, strand)
    found = ix.keep(_candidates(qk, s))
    return s, q, _limits(qk), stages.seed_hits(qk, ix.postings(align.of_hits(s, found, ["volume", "oid"]), K), found)


def _lengths(q: DataFrame) -> DataFrame:
    return q.select("qseqid", F.length("seq").alias("qlen"))


@query(f"WITH {_HITS} SELECT {_HITS_COLUMNS} FROM d")
def seed_hits(spark, sf_dir):
    return _hits(spark, sf_dir)[3]


@query(f"WITH {_HITS} SELECT {_HITS_COLUMNS} FROM d QUALIFY count(*) OVER (PARTITION BY qseqid, volume, oid, s_pos - q_pos) >= 20")
def diagonal_filter(spark, sf_dir):
    return stages.diagonal_filter(_hits(spark, sf_dir)[3], 20)


@query(f"WITH {_HITS}, g AS (SELECT qseqid, volume, oid, s_pos - q_pos AS diagonal, count(*) AS n FROM d GROUP BY ALL), b AS (SELECT qseqid, volume, oid, max(n) AS n FROM g GROUP BY ALL) SELECT b.qseqid, '+' AS strand, volume, oid, b.n::INT AS chainscore FROM b JOIN n ON b.qseqid = n.qseqid WHERE b.n >= threshold")
def chain_gap0(spark, sf_dir):
    _, q, limits, hits = _hits(spark, sf_dir)
    return stages.chains(hits, limits, _lengths(q), K, max_gap=0, lookback=0).select(*stages.SUBJECT, "chainscore")


def _chained(spark: SparkSession, sf_dir: str, strand: int = 1):
    s, q, limits, hits = _hits(spark, sf_dir, strand)
    return s, q, stages.chains(hits, limits, _lengths(q), K)


@query(_found(_CHAINS))
def chain_default(spark, sf_dir):
    return _chained(spark, sf_dir)[2]


@query(_found(_CHAINS, strands="+-"))
def chain_both_strands(spark, sf_dir):
    return _chained(spark, sf_dir, 2)[2]


_DIAGONAL = f"{_HITS}, g AS (SELECT qseqid, volume, oid, s_pos - q_pos AS diagonal, count(*) AS n, min(s_pos) AS sstart, max(s_pos) + {K} AS send, min(q_pos) AS qstart, max(q_pos) + {K} AS qend FROM d GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY qseqid, volume, oid ORDER BY n DESC, qend, sstart) = 1), e AS (SELECT b.* FROM b JOIN n ON b.qseqid = n.qseqid WHERE b.n >= threshold)"


def _best(spark: SparkSession, sf_dir: str):
    """The best diagonal of each candidate, as hits: chains with no gap allowed, which SQL can express. Of equal chains the first end wins, in queries and then subjects."""
    s, q, limits, hits = _hits(spark, sf_dir)
    found = stages.chains(hits, limits, _lengths(q), K, max_gap=0, lookback=0)
    found = found.withColumnsRenamed({"q_start": "qstart", "q_end": "qend", "s_start": "sstart", "s_end": "send"})
    return s, q, found


_TOP = "row_number() OVER (PARTITION BY qseqid ORDER BY n DESC, volume, oid, sstart, qstart) <= 2"


@query(f"WITH {_DIAGONAL} SELECT qseqid, '+' AS strand, volume, oid, n::INT AS chainscore FROM e QUALIFY {_TOP}")
def final_topn(spark, sf_dir):
    found = _best(spark, sf_dir)[2]
    return stages.top(found, 2, ["qseqid"], "chainscore", ("volume", "oid", "sstart", "qstart")).select(*stages.SUBJECT, "chainscore")


@query(f"WITH {_DIAGONAL} SELECT qseqid, '+' AS strand, volume, oid, n::INT AS chainscore FROM e QUALIFY row_number() OVER (PARTITION BY qseqid, volume ORDER BY n DESC, volume, oid, sstart, qstart) <= 1")
def volume_topn(spark, sf_dir):
    found = _best(spark, sf_dir)[2]
    return stages.top(found, 1, ["qseqid", "volume"], "chainscore", ("volume", "oid", "sstart", "qstart")).select(*stages.SUBJECT, "chainscore")


# stage 3 -------------------------------------------------------------------

_WINDOW = f"{_DIAGONAL}, x AS (SELECT e.*, length(q.seq) AS qlen, length(s.seq) AS slen, q.seq AS qs, s.seq AS ss, greatest(0, sstart - floor(length(q.seq) * 0.1::DOUBLE))::BIGINT AS first, least(send + floor(length(q.seq) * 0.1::DOUBLE), length(s.seq) - 1)::BIGINT AS last FROM e JOIN q USING (qseqid) JOIN s USING (volume, oid))"


@query(f"WITH {_WINDOW} SELECT qseqid, volume, oid, first, last, substr(ss, first + 1, last - first + 1) AS part FROM x")
def context_window(spark, sf_dir):
    s, q, found = _best(spark, sf_dir)
    df = found.join(_lengths(q), "qseqid").join(s.select("volume", "oid", "seq", "slen"), ["volume", "oid"])
    first, last = align.window_bounds(F.col("sstart"), F.col("send"), F.col("slen"), settings.context(F.col("qlen"), True, 0.1))
    df = df.withColumn("first", first).withColumn("last", last)
    return df.select("qseqid", "volume", "oid", "first", "last", alphabet.subsequence(F.col("seq"), F.col("first"), F.col("last")).alias("part"))


@query(
    f"""WITH {_WINDOW}, w AS (SELECT qseqid, volume, oid, qs, substr(ss, first + 1, last - first + 1) AS part FROM x),
    o AS (SELECT *, unnest(range(1 - length(qs), length(part))) AS shift FROM w),
    p AS (SELECT *, unnest(range(greatest(0, -shift), least(length(qs), length(part) - shift))) AS i FROM o),
    v AS (SELECT qseqid, volume, oid, shift, sum(CASE WHEN substr(qs, i + 1, 1) = substr(part, i + shift + 1, 1) THEN 5 ELSE -4 END) AS score FROM p GROUP BY ALL)
    SELECT qseqid, volume, oid, greatest(0, max(score))::INT AS alnscore FROM v GROUP BY ALL"""
)
def align_ungapped(spark, sf_dir):
    s, q, found = _best(spark, sf_dir)
    out = align.stage3(found, q, s, True, 0.1, resolve=False, gap_open=1_000_000, gap_extend=1)
    return out.select("qseqid", "volume", "oid", "alnscore")


def _kept(indexes: list) -> list:
    ix.release()  # what the query before has kept
    return [ix.kept(i) for i in indexes]


def _built(s: DataFrame, k: int):
    return _kept([ix.build(s, k)])[0]


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir)
    return search([_built(s, K)], q, SearchConfig(mode=3, max_freq=1.0, strand=1, trace=True, context="0.1"))


@query()
def align_sg(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query()
def sam_rows(spark, sf_dir):
    return sinks.sam_rows(_aligned(spark, sf_dir))


# whole searches ------------------------------------------------------------


def _mode1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir)
    return search([_built(s, K)], q, SearchConfig(mode=1, max_freq=1.0, strand=1))


_MODE1 = f"WITH {_stage1(K)}, r AS (SELECT c.qseqid, s.accession AS sseqid, '+' AS sstrand, length(q.seq)::INT AS qlen, length(s.seq)::INT AS slen, score AS coverscore, c.volume, c.oid FROM c JOIN q USING (qseqid) JOIN s USING (volume, oid))"


@query(f"{_MODE1} FROM r")
def search_mode1(spark, sf_dir):
    return _mode1(spark, sf_dir)


@query(f"{_MODE1} SELECT concat_ws(chr(9), qseqid, sseqid, sstrand, qlen, slen, coverscore, volume) AS value FROM r")
def tsv_rows(spark, sf_dir):
    return sinks.tsv_rows(_mode1(spark, sf_dir))


@query(
    f"""{_MODE1} SELECT qseqid, '{{"qseqid":' || qseqid || ',"hits":[' || string_agg('{{"sseqid":"' || sseqid || '","sstrand":"+","qlen":' || qlen || ',"slen":' || slen || ',"coverscore":' || coverscore || ',"volume":' || volume || '}}', ',' ORDER BY coverscore DESC, volume, sseqid) || ']}}' AS value
    FROM r GROUP BY qseqid"""
)
def json_grouped(spark, sf_dir):
    return sinks.json_rows(_mode1(spark, sf_dir))


@query(_found(_MODE2.format(_TOP10), strands="+-", high=0.5))
def search_mode2(spark, sf_dir):
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir)
    return search([_built(s, K)], q, SearchConfig(results=10))


@query(_found(_MODE2.format("f"), ats=tuple(tuple(seeds.offsets(K, SPAN, t)) for t in seeds.templates(SPAN, "both"))))
def search_both(spark, sf_dir):
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir)
    return search(_kept(ix.build_all(s, K, SPAN, "both")), q, SearchConfig(strand=1, max_freq=1.0))


# written indexes -----------------------------------------------------------


def _written(spark: SparkSession, s: DataFrame, k: int, **how):
    """An index that is written in folders of one first base or more, and read again."""
    built = ix.build(s, k, **how)
    root = bridge.scratch(spark)
    ix.write(built, root, 100_000)
    return ix.read(spark, root, k), root


@query(f"{_MODE1} FROM r")
def search_written(spark, sf_dir):
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir)
    return search([_written(spark, s, K)[0]], q, SearchConfig(mode=1, max_freq=1.0, strand=1))


@query(f"WITH {_COUNTS} SELECT volume, oid, count(*) AS n FROM sk JOIN c USING (kmer), l WHERE n <= most GROUP BY volume, oid")
def index_rewritten(spark, sf_dir):
    s = bridge.sequences(spark, sf_dir)
    read, _ = _written(spark, s, SMALL)
    thin = ix.rewrite_without(read, _small_threshold(s))
    root = bridge.scratch(spark)
    ix.write(thin, root, 100_000)
    return ix.read(spark, root, SMALL).postings.groupBy("volume", "oid").agg(F.count("*").alias("n"))


@query(f"WITH {_S}, {_windows('sk', 's', 'volume, oid', SMALL)} SELECT volume, oid, count(DISTINCT kmer) AS n FROM sk GROUP BY volume, oid")
def index_without_places(spark, sf_dir):
    read, _ = _written(spark, bridge.sequences(spark, sf_dir), SMALL, positions=False)
    return read.postings.groupBy("volume", "oid").agg(F.count("*").alias("n"))


@query(f"WITH {_S}, {_windows('sk', 's', 'volume, oid', SMALL)} SELECT {SMALL} AS k, 0 AS span, 'con' AS template, 'db' AS title, 4 AS expand, true AS positions, (SELECT count(*) FROM s) AS sequences, (SELECT sum(length(seq)) FROM s)::BIGINT AS bases, count(*) AS postings, count(DISTINCT kmer) AS kmers FROM sk")
def index_described(spark, sf_dir):
    return info.described(spark, _written(spark, bridge.sequences(spark, sf_dir), SMALL, title="db")[1])


# primers and retrieval -----------------------------------------------------

_PRIMERS = f"p AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, 'P' || item_id AS id, substr({bridge.dna_sql('text')}, 1, 20) AS seq FROM benchmark)"


def _places(seq: str) -> str:
    return f"(length({seq}) - {K - 1})"


@query(
    f"""WITH {_PRIMERS} SELECT f.ord // 2 AS pair, f.id || '__+__' || r.id AS qseqid, f.seq || repeat('N', 50) || {_TURN.format('r.seq')} AS seq, {_places('f.seq')}::INT AS fwd_positions, {_places('r.seq')}::INT AS rev_positions
    FROM p f JOIN p r ON r.ord = f.ord + 1 WHERE f.ord % 2 = 0"""
)
def primer_queries(spark, sf_dir):
    from pyspark.sql import Window

    q = bridge.queries(spark, sf_dir)
    order = F.row_number().over(Window.orderBy("qseqid")).cast("long") - 1  # a primer file is a short list
    return primers.pairs(q.select(order.alias("ord"), F.concat(F.lit("P"), F.col("qseqid").cast("string")).alias("id"), F.substring("seq", 1, 20).alias("seq")), 50, K)


_INSERT = 40
_PAIRS = f"p AS (SELECT item_id, {bridge.dna_sql('text')} AS w FROM benchmark), q AS (SELECT 'P' || item_id || 'f__+__P' || item_id || 'r' AS qseqid, substr(w, 1, 20) || repeat('N', {_INSERT}) || substr(w, {21 + _INSERT}, 20) AS seq FROM p WHERE length(w) >= {40 + _INSERT})"


@query(_found(_MODE2.format("f"), queries=_PAIRS, least=f"{20 - K + 2}", gap=_INSERT))
def primer_search(spark, sf_dir):
    """Primers at both ends of the first letters of each item."""
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir).where(F.length("seq") >= 40 + _INSERT)
    name = lambda end: F.concat(F.lit("P"), F.col("qseqid").cast("string"), F.lit(end))
    forward = q.select((2 * F.col("qseqid")).alias("ord"), name("f").alias("id"), F.substring("seq", 1, 20).alias("seq"))
    backward = q.select((2 * F.col("qseqid") + 1).alias("ord"), name("r").alias("id"), alphabet.reverse_complement(F.substring("seq", 21 + _INSERT, 20)).alias("seq"))
    return search_primers([_built(s, K)], forward.union(backward), _INSERT, config=SearchConfig(strand=1, max_freq=1.0, expand=1))


def _as_hits(found: DataFrame, s: DataFrame, strand: str) -> DataFrame:
    return found.join(s.select("volume", "oid", F.col("accession").alias("sseqid")), ["volume", "oid"]).withColumn("sstrand", F.lit(strand))


def _retrieve_sql(part: str, strand: str) -> str:
    return f"""WITH {_DIAGONAL}, z AS (SELECT e.*, s.accession, s.seq, greatest(0, sstart - 10)::BIGINT AS first, least(send + 10, length(s.seq) - 1)::BIGINT AS last FROM e JOIN s USING (volume, oid))
    SELECT accession AS sseqid, qseqid, '{strand}' AS sstrand, first, last, n::INT AS score, {part} AS seq FROM z"""


_PART = "substr(seq, first + 1, last - first + 1)"


@query(_retrieve_sql(_PART, "+"))
def retrieve_subseq(spark, sf_dir):
    s, _, found = _best(spark, sf_dir)
    return retrieve.local(_as_hits(found, s, "+"), s, 10)


@query(_retrieve_sql(_TURN.format(_PART), "-"))
def retrieve_minus(spark, sf_dir):
    s, _, found = _best(spark, sf_dir)
    return retrieve.local(_as_hits(found, s, "-"), s, 10)


@query(
    f"""WITH {_DIAGONAL}, z AS (SELECT s.accession, e.qseqid, greatest(0, sstart - 10) AS first, least(send + 10, length(s.seq) - 1) AS last, n, s.seq FROM e JOIN s USING (volume, oid))
    SELECT '>' || accession || ' query=' || qseqid || ' strand=+ range=' || first || '-' || last || ' score=' || n || chr(10) || regexp_replace({_PART}, '(.{{70}})', '\\1' || chr(10), 'g') AS value FROM z WHERE (last - first + 1) % 70 <> 0
    UNION ALL SELECT '>' || accession || ' query=' || qseqid || ' strand=+ range=' || first || '-' || last || ' score=' || n || chr(10) || rtrim(regexp_replace({_PART}, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10)) FROM z WHERE (last - first + 1) % 70 = 0"""
)
def fasta_rows(spark, sf_dir):
    s, _, found = _best(spark, sf_dir)
    return retrieve.fasta(retrieve.local(_as_hits(found, s, "+"), s, 10))


@query(
    f"""WITH {_DIAGONAL}, z AS (SELECT s.accession, e.* FROM e JOIN s USING (volume, oid)), m AS (SELECT accession, max(send) + 1 > 1000 AS long FROM z GROUP BY accession)
    SELECT DISTINCT '{retrieve.SERVICE}?db=nuccore&rettype=fasta&retmode=text&id=' || accession || '&seq_start=' || (greatest(0, sstart - 5) + 1) || '&seq_stop=' || (send + 6) AS url FROM z SEMI JOIN (FROM m WHERE long) USING (accession)
    UNION ALL SELECT '{retrieve.SERVICE}?db=nuccore&rettype=fasta&retmode=text&id=' || string_agg(accession, ',' ORDER BY accession) FROM (SELECT accession, (row_number() OVER (ORDER BY ('0x' || substr(md5(accession), 1, 4))::INT % {retrieve.GROUPS}, accession) - 1) // 10 AS b FROM m WHERE NOT long) GROUP BY b"""
)
def efetch_plan(spark, sf_dir):
    s, _, found = _best(spark, sf_dir)
    return retrieve.remote_plan(_as_hits(found, s, "+"), 5, 10, 1000).select("url")


@query(
    f"WITH {_COUNTS}, f AS (SELECT n FROM c UNION ALL SELECT 0 FROM range((SELECT {_SLOTS} - count(*) FROM c))), t AS (SELECT (SELECT count(*) FROM s) AS sequences, (SELECT sum(length(seq)) FROM s)::BIGINT AS bases, count(*) AS postings, count(DISTINCT kmer) AS kmers FROM sk) "
    f"SELECT {SMALL} AS k, 0 AS span, 'con' AS template, '' AS title, sequences, bases, postings, kmers, min(n) FILTER (n > 0) AS least, max(n) AS most, round(sum(n)::DOUBLE / {_SLOTS}, 6) AS mean, {_P} FROM f, t GROUP BY ALL"
)
def info_report(spark, sf_dir):
    out = info.report(ix.build(bridge.sequences(spark, sf_dir), SMALL))
    return out.select(*[F.round(c, 6).alias(c) if c == "mean" or c[0] == "p" and c[1:].isdigit() else c for c in out.columns])


@query(
    f"WITH q AS (SELECT item_id, {bridge.dna_sql('text', True)} AS seq FROM benchmark) SELECT 'skipped' AS kind, item_id::VARCHAR AS id FROM q WHERE regexp_matches(seq, '[RYSN]') "
    "UNION ALL SELECT DISTINCT 'unknown', 'D' || doc_id FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'unknown', 'none'"
)
def search_notes(spark, sf_dir):
    s, q = bridge.sequences(spark, sf_dir), bridge.queries(spark, sf_dir, codes=True)
    listed = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession")).union(spark.createDataFrame([("none",)], "accession string"))
    return notes([ix.build(s, SMALL)], q, SearchConfig(accept_degenerate=False), listed)
