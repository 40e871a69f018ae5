import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helixframe.functions import alphabet, kmers, seeds, settings
from helixframe.operators import align, index as ix, info, primers, queries as qs, retrieve, stages
from helixframe.plans.primers import search_primers
from helixframe.plans.search import SearchConfig, columns, notes, search, status
from helixframe.sources import bam, sinks, texts


def scan(seq, k, expand=0):
    pos, value = kmers.scan(seq.encode(), seeds.offsets(k), expand)
    return list(zip(pos.tolist(), value.tolist(), strict=True))


def test_scan():
    assert [p for p, _ in scan("ACGTACGT", 5)] == [0, 1, 2, 3]
    assert [p for p, _ in scan("ACNGTACGT", 5)] == [3, 4]
    assert {v for _, v in scan("ACGTR", 5, 4)} == {0x6C, 0x6E}
    assert len(scan("ACGTN", 5, 4)) == 4
    assert scan("ACRSW", 5, 4) == []
    assert len(scan("ACRWT", 5, 4)) == 4
    assert scan("ACGTR", 5) == [] and kmers.skips(b"ACGTR", seeds.offsets(5), 0)
    assert scan("ACGU", 5) == [] and scan("acgta", 5) == scan("ACGTA", 5)


def test_spaced_scan():
    at = seeds.offsets(11, 16, seeds.CODING)
    pos, value = kmers.scan(b"ACGTACGTACGTACGT", at)
    assert (pos.tolist(), value.tolist()) == ([0], [470407])
    assert len(kmers.scan(b"ACGT" * 5, at)[0]) == 5
    assert len(kmers.scan(b"ACGTACGTACGTACG", at)[0]) == 0
    assert len(kmers.scan((b"ACGT" * 6)[:22], seeds.offsets(12, 18, seeds.CODING))[0]) == 5


@pytest.mark.parametrize("key", sorted(seeds.MASKS))
def test_masks(key):
    k, span = key
    for mask in seeds.MASKS[key]:
        assert bin(mask).count("1") == k and mask.bit_length() == span and mask & 1


def test_bad_seeds():
    for args in ((4,), (17,), (11, 17, seeds.CODING), (11, 16, "con")):
        with pytest.raises(ValueError):
            seeds.offsets(*args)


def test_long_sequences_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(kmers, "_SLICE", 100)
    seq = "".join(random.Random(1).choices("ACGTN", k=1003))
    want = {(int(p), int(v)) for p, v in zip(*kmers.scan(seq.encode(), seeds.offsets(5), 4), strict=True)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "seq": [seq, "ACGTACG"]})
    got = set()
    for data, row, begin, first in kmers._pieces(batch, 1, 5):
        start, value = kmers._windows(data, seeds.offsets(5), 4)
        ok = row[start] == row[start + 4]
        got |= {(int(s - begin[s] + first), int(v)) for s, v in zip(start[ok], value[ok], strict=True) if row[s] == 0}
    assert got == want


def test_alphabet(spark):
    df = spark.createDataFrame([("RYSWKM", "ACGT"), ("acgtn!", "TTTT")], "s string, k string")
    got = df.select(alphabet.reverse_complement(F.col("s")), alphabet.kmer_value(F.col("k")), alphabet.is_degenerate(F.col("s")), alphabet.expansions(F.col("s")), alphabet.reverse_complement(F.col("s"), True)).collect()
    assert [tuple(r) for r in got] == [("KMWSRY", 27, True, 64, "MKWSYR"), ("Nnacgt", 255, True, 4, "!nacgt")]


def test_settings():
    assert settings.parse_size("8G") == 8 << 30 and settings.format_size(1536) == "1.50 KB"
    assert settings.parse_context("2.0") == (True, 2.0) and settings.parse_context("50") == (False, 50)
    assert settings.build_threshold(1, 10) is None and settings.build_threshold(0.25, 10) == 3 and settings.build_threshold(7.9, 10) == 7
    assert settings.search_threshold(0, 1, 10**9, 8) == 100_000 and settings.search_threshold(0, 1, 10, 8) == 1000
    for bad in (lambda: settings.parse_context("-1"), lambda: settings.build_threshold(0, 1), lambda: settings.primer_threshold(1.5, [(3, 3)]), lambda: settings.primer_chain_minimum(9, [(3, 3)])):
        with pytest.raises(ValueError):
            bad()
    assert settings.primer_chain_minimum(2, [(5, 4), (9, 9)]) == 7


CHAINS = [
    ([(10, 100)], {}, [(1, 10, 17, 100, 107)]),
    ([(0, 90), (7, 97), (14, 104), (21, 111), (28, 118)], {}, [(5, 0, 35, 90, 125)]),
    ([(0, 100), (10, 110), (50, 200)], {}, [3]),
    ([(0, 100), (10, 300)], {}, [1]),
    ([(10, 100)], {"min_score": 3}, []),
    ([(0, 200), (10, 100), (20, 50)], {}, [1]),
    ([(10, 100), (10, 110), (10, 120), (10, 130)], {}, [1]),
    ([(0, 90), (7, 57), (14, 104), (21, 71), (28, 118)], {"lookback": 1}, [2]),
    ([(0, 90), (7, 57), (14, 104), (21, 71), (28, 118)], {"lookback": 2}, [3]),
    ([(7 * i, 90 + 7 * i) for i in range(5)] + [(7 * i, 500 + 7 * i) for i in range(5)], {"max_gap": 50, "max_chains": 2}, [5, 5]),
]


@pytest.mark.parametrize("hits,how,want", CHAINS)
def test_chain(hits, how, want):
    got = stages.chain(sorted(hits), 7, **how)
    assert got == want if want and isinstance(want[0], tuple) else [c[0] for c in got] == want


def test_diagonal_filter(spark):
    rows = [("q", "+", 0, 1, *h) for h in ((0, 100), (5, 105), (10, 110), (10, 210))]
    df = spark.createDataFrame(rows, "qseqid string, strand string, volume int, oid long, q_pos int, s_pos int")
    assert stages.diagonal_filter(df, 1).count() == 4
    assert {tuple(r)[4:] for r in stages.diagonal_filter(df, 2).collect()} == {(0, 100), (5, 105), (10, 110)}


def test_align():
    a = align.align("ACGT" * 5, "ACGT" * 5)
    assert (a["cigar"], a["alnscore"], a["q_end"], a["s_end"]) == ("20=", 100, 19, 19)
    a = align.align("ACGT" * 5, "ACGTACTTACGTACGTACGT", matrix="nuc44")
    assert (a["npositive"], a["nnegative"]) == (19, 1)
    a = align.align("ACGTACGTACGT", "ACGTAAACGTACGT", matrix="nuc44")
    assert "I" in a["cigar"] or "D" in a["cigar"]
    a = align.align("ACGT" * 5, "ACTTACGTACGTACGTACTT", matrix="nuc44")
    assert a["npositive"] + a["nnegative"] == 20
    a = align.align("ACGTACGTCC", "TTTTACGTACGTCCTTTT")
    assert a["cigar"] == "4D10=4D" and align.align("ACGTACGTCC", "TTTTACGTACGTCCTTTT", end_gaps=False)["cigar"] == "10="
    assert align.align("", "ACGT")["alnscore"] == 0


def slow_score(q, s, go, ge):
    low = -(10**9)
    h = [[0] * (len(s) + 1) for _ in range(len(q) + 1)]
    e, f = ([[low] * (len(s) + 1) for _ in range(len(q) + 1)] for _ in range(2))
    for i in range(1, len(q) + 1):
        for j in range(1, len(s) + 1):
            e[i][j] = max(h[i][j - 1] - go, e[i][j - 1] - ge)
            f[i][j] = max(h[i - 1][j] - go, f[i - 1][j] - ge)
            w = align.DEGMATCH[align.LETTERS.index(q[i - 1]), align.LETTERS.index(s[j - 1])]
            h[i][j] = max(h[i - 1][j - 1] + w, e[i][j], f[i][j])
    return max(max(h[-1]), max(r[-1] for r in h))


def test_align_against_cells():
    rng = random.Random(5)
    for _ in range(60):
        q, s = ("".join(rng.choices("ACGTN", k=rng.randint(1, 25))) for _ in range(2))
        a = align.align(q, s, 4, 1)
        assert a["alnscore"] == slow_score(q, s, 4, 1)
        assert a["qseq"].replace("-", "") == q and a["sseq"].replace("-", "") == s and len(a["qseq"]) == len(a["sseq"]) == a["aln_len"]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=600)) for _ in range(10)]
    turn = str.maketrans("ACGT", "TGCA")
    seqs[5] = seqs[5][:100] + seqs[0][200:300].translate(turn)[::-1] + seqs[5][200:]
    rows = [(i % 2, i, f"ACC{i:03d}", s) for i, s in enumerate(seqs)]
    sequences = spark.createDataFrame(rows, "volume int, oid long, accession string, seq string")
    queries = spark.createDataFrame([("q0", seqs[0][200:300]), ("q1", seqs[1][50:150])], "qseqid string, seq string")
    return seqs, sequences, queries


def test_search_modes(spark, world):
    seqs, sequences, queries = world
    built = ix.build(sequences, 9)
    for mode in (1, 2, 3):
        got = search([built], queries, SearchConfig(mode=mode, max_freq=1.0, trace=mode == 3, context="0")).collect()
        assert {(r.qseqid, r.sseqid, r.sstrand) for r in got} == {("q0", "ACC000", "+"), ("q1", "ACC001", "+"), ("q0", "ACC005", "-")}
        for r in got:
            assert r.coverscore == 92
            if mode == 2:
                start = {"ACC000": 200, "ACC001": 50, "ACC005": 100}[r.sseqid]
                assert (r.qstart, r.qend, r.sstart, r.send, r.chainscore) == (0, 100, start, start + 100, 92)
            if mode == 3:
                assert r.npositive == 100 and r.alnscore == 500 and r.ppositive > 90
    one = search([built], queries, SearchConfig(max_freq=1.0, strand=-1)).collect()
    assert [r.sseqid for r in one] == ["ACC005"]
    plain = search([built], queries, SearchConfig(max_freq=1.0, strand=-1, same_direction=True, chain_minimum=1)).collect()
    assert all(r.chainscore < 5 for r in plain)


def test_search_filters(spark, world):
    _, sequences, queries = world
    built = ix.build(sequences, 9)
    names = spark.createDataFrame([("ACC000",), ("NONE",)], "accession string")
    config = SearchConfig(mode=1, max_freq=1.0)
    assert {r.sseqid for r in search([built], queries, config, names).collect()} == {"ACC000"}
    assert {r.sseqid for r in search([built], queries, config, names, True).collect()} == {"ACC001", "ACC005"}
    assert search([built], queries, config, names.limit(0)).count() == 3
    assert [r.accession for r in stages.unknown(sequences, names).collect()] == ["NONE"]
    assert search([built], queries, SearchConfig(mode=1, max_freq=1.0, results=1)).count() == 2
    both = ix.build_all(sequences, 11, 16, "both")
    assert {r.sseqid for r in search(both, queries, SearchConfig(max_freq=1.0, strand=1)).collect()} == {"ACC000", "ACC001"}
    for bad in (dict(mode=4), dict(strand=0), dict(mode=1, max_chains=2), dict(min_npositive=3), dict(matrix="none")):
        with pytest.raises(ValueError):
            SearchConfig(**bad)


def test_index_round_trip(spark, world, tmp_path):
    _, sequences, queries = world
    root = str(tmp_path / "index")
    built = ix.build(sequences, 8, max_freq=2)
    assert built.counts.where("n > 2").count() == 0 and built.excluded.count() > 0
    assert built.postings.join(built.excluded, "kmer").count() == 0
    ix.write(built, root, 1000)
    back = ix.read(spark, root, 8)
    assert replace(back.meta, bases=0) == built.meta and back.postings.count() == built.postings.count()
    assert sorted(map(tuple, back.sequences.collect())) == sorted(map(tuple, built.sequences.collect()))
    assert [tuple(r)[:3] for r in ix.discover(spark, root).collect()] == [(8, 0, "con")]
    small = ix.rewrite_without(ix.build(sequences, 8), 2)
    assert small.counts.count() == built.counts.count()
    flat = ix.build(sequences, 8, positions=False)
    assert flat.postings.columns == ["kmer", "volume", "oid"] and search([flat], queries, SearchConfig(mode=1, max_freq=1.0)).count() >= 3
    assert info.report(built).first().sequences == 10


def test_written_postings_are_pruned(spark, world, tmp_path):
    seqs, sequences, queries = world
    root = str(tmp_path / "i")
    ix.write(ix.build(sequences, 9), root, 500)
    read = ix.read(spark, root, 9)
    assert read.meta.bases == 2
    one = spark.createDataFrame([(0,), (5,)], "kmer long")
    near = ix.near(read, one)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bin" in plan.split("PartitionFilters")[1][:200]
    files = lambda df: {r[0].rsplit("/", 1)[0][-6:] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(files(near)) <= 1 < len(files(read.postings.drop("bin")))
    for f in read.postings.inputFiles():  # each file by k-mer, then sequence and place
        rows = [tuple(r) for r in spark.read.parquet(f).select("kmer", "volume", "oid", "s_pos").collect()]
        assert rows == sorted(rows)
    ix.write(ix.build(sequences, 8), root)
    with pytest.raises(ValueError, match="another collection"):
        ix.write(ix.build(sequences.where("oid > 2"), 7), root)
    sizes = {r.part: r for r in info.sizes(spark, root, 9).collect()}
    assert sizes["postings"].share > 0 and sizes["sequences"].bytes > 0 and info.described(spark, root).count() == 2


def test_repeated_queries_count_once(spark, world):
    seqs, sequences, queries = world
    index = ix.build(sequences, 8)
    twice = spark.createDataFrame([("q", seqs[0][200:300], 1), ("q", seqs[1][50:150], 2)], "qseqid string, seq string, ord long")
    hits = search([index], twice, SearchConfig(max_freq=1.0)).collect()
    assert [r.sseqid for r in hits] == ["ACC001"]
    greatest = max(seqs[0][200:300], seqs[1][50:150])
    assert [r.sseqid for r in search([index], twice.drop("ord"), SearchConfig(max_freq=1.0)).where("sstrand = '+'").collect()] == ["ACC000" if greatest == seqs[0][200:300] else "ACC001"]


def test_primer_search(spark, world):
    seqs, sequences, _ = world
    turn = str.maketrans("ACGT", "TGCA")
    p = spark.createDataFrame([(0, "f", seqs[2][100:120]), (1, "r", seqs[2][180:200].translate(turn)[::-1])], "ord long, id string, seq string")
    index = ix.build(sequences, 8)
    config = SearchConfig(max_freq=1.0, strand=1, expand=1)
    hits = search_primers([index], p, 60, config=config).collect()
    assert [(r.qseqid, r.sseqid, r.sstart, r.send) for r in hits] == [("f__+__r", "ACC002", 100, 200)]
    assert len(search_primers([index], p, 60, score=1.0, config=config).collect()) == 1
    assert search_primers([index], p, 60, score=1.0, config=replace(config, min_score=0.9)).count() == 1
    with pytest.raises(ValueError):
        search_primers([index], p, 60, score=99, config=config)


def test_notes_and_status(spark, world):
    _, sequences, queries = world
    q = queries.union(spark.createDataFrame([("bad", "ACGTNNNNNNNNACGTACGT")], queries.schema))
    listed = spark.createDataFrame([("ACC001",), ("X",)], "accession string")
    index = ix.build(sequences, 8)
    strict = SearchConfig(accept_degenerate=False)
    assert {tuple(r) for r in notes([index], q, strict, listed).collect()} == {("skipped", "bad"), ("unknown", "X")}
    assert {tuple(r) for r in notes([index], q).collect()} == {("windows", "bad")}
    assert (status(q), status(q, strict), status(q.limit(0))) == (0, 2, 1)


def test_thresholds(spark):
    qk = spark.createDataFrame([("q", "+", p, k) for p, k in ((0, 1), (1, 2), (1, 3), (2, 4), (3, 4))], "qseqid string, strand string, q_pos int, kmer long")
    high = spark.createDataFrame([(2,), (4,)], "kmer long")
    r = qs.thresholds(qk, high, 0.9, 0).first()
    assert (r.n_kmers, r.n_high, r.threshold, r.min_chain) == (4, 2, 2, 2)
    assert qs.thresholds(qk, high, None, 3, 5).first().min_chain == 5


def test_overlaps_are_resolved():
    seq = "".join(random.Random(9).choices("ACGT", k=300))
    q = seq[100:150]
    base = {"_q": q, "_part": seq[50:271], "_first": 50, "_last": 270, "qstart": 0, "qend": 49, "npositive": 1, "nnegative": 0, "ppositive": 1.0, "cigar": "", "qseq": "", "sseq": "", "alnscore": 1}
    rows = [base | {"sstart": 80, "send": 170, "chainscore": 9}, base | {"sstart": 120, "send": 220, "chainscore": 3}]
    out = align.resolve_group(rows, True, {})
    assert out[0]["chainscore"] == 9 and all(r["sstart"] > 170 for r in out[1:])
    rows = [base | {"sstart": 80, "send": 170, "chainscore": 9}, base | {"sstart": 90, "send": 160, "chainscore": 3}]
    assert len(align.resolve_group(rows, False, {})) == 1


def test_room_beside_what_is_taken():
    rng = random.Random(10)
    assert align.room(10, 20, (0, 99), []) == (10, 20) and align.room(10, 20, (0, 99), [(20, 30)]) == (0, 19)
    assert align.room(10, 20, (0, 99), [(2, 5), (18, 30)]) == (6, 17) and align.room(10, 40, (0, 99), [(2, 15), (60, 70)]) == (16, 59)
    assert align.room(10, 20, (0, 99), [(10, 15)]) is None and align.room(10, 20, (0, 99), [(5, 25)]) is None
    for _ in range(300):  # whatever is taken, no two hits meet in the end
        rows = [{"sstart": a, "send": a + rng.randrange(5, 40), "chainscore": rng.randrange(5), "_q": "ACGT" * 5, "_part": "ACGT" * 60, "_first": 0, "_last": 239, "alnscore": 0, "qend": 0} for a in rng.sample(range(150), 6)]
        out = align.resolve_group(rows, False, {})
        assert out and all(x["send"] < y["sstart"] for x, y in zip(out, out[1:])) and max(r["chainscore"] for r in rows) in [r["chainscore"] for r in out]


def test_traceback_in_parts(monkeypatch):
    rng = random.Random(11)
    for _ in range(40):
        q, s = ("".join(rng.choices("ACGT", k=rng.randint(5, 60))) for _ in range(2))
        s += q[: rng.randrange(60)] + "ACGGT" + q[rng.randrange(60) :]
        whole = align.align(q, s, 4, 1)
        monkeypatch.setattr(align, "CELLS", 1)
        assert align.align(q, s, 4, 1) == whole
        monkeypatch.undo()


def test_matrices():
    at = align.LETTERS.index
    for m in align.MATRICES.values():
        assert (m == m.T).all()
    assert [align.NUC44[at(a), at(b)] for a, b in ("AA", "AT", "SS", "RR", "NN", "NA", "NS", "SW", "RY", "BV")] == [5, -4, -1, -1, -1, -2, -1, -4, -4, -2]


def test_primers(spark):
    rows = [(0, "f", "ACGTACGTACGT"), (1, "r", "TTTTGGGGCCCC")]
    p = spark.createDataFrame(rows, "ord long, id string, seq string")
    r = primers.pairs(p, 10, 8).first()
    assert (r.qseqid, r.seq) == ("f__+__r", "ACGTACGTACGT" + "N" * 10 + "GGGGCCCCAAAA") and (r.fwd_positions, r.rev_positions) == (5, 5)
    for bad in (lambda: primers.pairs(p.limit(1), 10, 8), lambda: primers.pairs(p, 5, 8), lambda: primers.pairs(p, 20, 13)):
        with pytest.raises(ValueError):
            bad()


def test_retrieve(spark):
    seq = "".join(random.Random(4).choices("ACGT", k=500))
    s = spark.createDataFrame([(0, 1, "A", seq)], "volume int, oid long, accession string, seq string")
    h = spark.createDataFrame([("q", "A", "+", 100, 200, 7), ("q", "A", "-", 0, 3, 7), ("q", "B", "+", 0, 1, 1)], "qseqid string, sseqid string, sstrand string, sstart int, send int, chainscore int")
    got = {r.sstrand: r for r in retrieve.local(h, s).collect()}
    assert got["+"].seq == seq[100:201] and got["-"].seq == seq[:4].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    wide = {r.sstrand: r for r in retrieve.local(h, s, 10).collect()}
    assert (wide["+"].first, wide["+"].last, len(wide["+"].seq)) == (90, 210, 121) and wide["-"].first == 0
    lines = retrieve.fasta(retrieve.local(h, s, 10)).where(F.col("value").contains("strand=+")).first().value.split("\n")
    assert lines[0] == ">A query=q strand=+ range=90-210 score=7" and list(map(len, lines[1:])) == [70, 51]
    assert [r.sseqid for r in retrieve.missing(h, s).collect()] == ["B"]
    with pytest.raises(ValueError):
        retrieve.local(h.drop("sstart"), s)
    urls = [r.url for r in retrieve.remote_plan(h, 5, 100, 150, "K").collect()]
    assert any(u.endswith("id=A&seq_start=96&seq_stop=206&api_key=K") for u in urls) and any(u.endswith("id=B&api_key=K") for u in urls)


def test_remote_batches_are_full(spark):
    rows = [("q", f"ACC{i}", 5, 10, 100) for i in range(250)]
    h = spark.createDataFrame(rows, "qseqid string, sseqid string, sstart int, send int, qlen int")
    plan = retrieve.remote_plan(h)
    assert sorted(len(r.accessions) for r in plan.collect()) == [50, 100, 100]
    assert sorted(a for r in plan.collect() for a in r.accessions) == sorted(r[1] for r in rows)
    assert retrieve.remote_context(h, "0.25") == 25 and retrieve.remote_context(h, "7") == 7


def test_fetching_again(spark, tmp_path):
    plan = spark.createDataFrame([("fine",), ("busy",), ("gone",), ("down",)], "url string")
    seen = str(tmp_path)

    def get(url, timeout):
        import pathlib

        n = len(list(pathlib.Path(seen).glob(f"{url}*")))
        pathlib.Path(seen, f"{url}{n}").write_text("")
        if url == "down":
            raise OSError("no route")
        return {"fine": (200, ">gi|1|gb|ACC1.2| x\nAC\nGT\n>ACC2.1.3\nGG"), "busy": (200 if n == 2 else 503, ">B\nA"), "gone": (404, "")}[url]

    got = retrieve.fetch(plan, get, 3, 0.01).persist()
    by = {r.url: r for r in got.collect()}
    assert by["busy"].body and by["gone"].error == "status 404" and by["down"].error == "no route"
    count = lambda url: len(list(tmp_path.glob(f"{url}*")))
    assert [count(u) for u in ("fine", "busy", "gone", "down")] == [1, 3, 1, 4]
    assert sorted((r.accession, r.seq) for r in retrieve.records(got).collect()) == [("ACC1", "ACGT"), ("ACC2", "GG"), ("B", "A")]


def test_fasta_headers_stand_at_line_starts(spark, tmp_path):
    (tmp_path / "b.fa").write_text("; top comment\nACGT\n>q1 len>5 x\nACGT\n>q2\nGG")
    (tmp_path / "c.fa").write_text(">q3\nAA>\nC\n")
    got = {(r.id, r.seq) for r in texts.fasta(spark, [str(tmp_path / "b.fa"), str(tmp_path / "c.fa")]).collect()}
    assert got == {("q1", "ACGT"), ("q2", "GG"), ("q3", "AA>C")}


def test_texts(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\r\nacgt\r\n;note\r\nAC\r\n>\nACGT\n>gi|12|gb|ACC001.1| x\nGG\n")
    got = texts.numbered(texts.fasta(spark, str(tmp_path / "a.fa"))).collect()
    assert [tuple(r) for r in got] == [(0, "s1", "ACGTAC"), (1, "gi|12|gb|ACC001.1|", "GG")]
    assert [r.accession for r in texts.fetched(spark, str(tmp_path / "a.fa")).collect()] == ["s1", "ACC001"]
    (tmp_path / "ids").write_text("# c\n\n>A1 more\n  B2\n")
    assert [r.accession for r in texts.id_list(spark, str(tmp_path / "ids")).collect()] == ["A1", "B2"]
    n = lambda x, size: x.to_bytes(size, texts.ORDER)
    long = "L" * 300
    data = b"\0" + n(0, 8) + n(2, 8) + n(1, 4) + b"t" + n(1, 1) + b"d" + n(0, 8) + n(2, 1) + b"A1" + b"\xff" + n(300, 4) + long.encode()
    assert texts.parse_binary_ids(data) == ["A1", long] and texts.parse_binary_ids(data[:-1]) == ["A1"]
    (tmp_path / "bin").write_bytes(data)
    assert [r.accession for r in texts.binary_id_list(spark, str(tmp_path / "bin")).collect()] == ["A1", long]


def test_hit_tables(spark, world, tmp_path):
    _, sequences, queries = world
    found = search([ix.build(sequences, 9)], queries, SearchConfig(mode=3, max_freq=1.0, trace=True, context="0"))
    sinks.write(found, str(tmp_path / "t"))
    back = texts.hits(spark, str(tmp_path / "t"))
    assert back.columns == columns(3, False, True)
    pick = lambda df: sorted(map(tuple, df.select("qseqid", "sseqid", "sstart", "send", "cigar", "qseq").collect()))
    assert pick(back) == pick(found)
    sinks.write(found, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for name in ("a", "b"):
        sinks.write(found, str(tmp_path / name), "sam")
    sinks.merge_sam(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "m"))
    head = [r.value for r in spark.read.text(str(tmp_path / "m/header")).collect()]
    body = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "m/body")).collect()]
    assert len(head) == 5 and head[1] == "@SQ\tSN:ACC000\tLN:600" and len(body) == 6
    assert {(r[1], r[2], r[3]) for r in body} == {("0", "ACC000", "201"), ("0", "ACC001", "51"), ("16", "ACC005", "101")}
    sinks.merge(spark, [str(tmp_path / "t"), str(tmp_path / "t")], str(tmp_path / "tt"))
    assert pick(texts.hits(spark, str(tmp_path / "tt"))) == sorted(2 * pick(found))
    sinks.merge(spark, [str(tmp_path / "j"), str(tmp_path / "j")], str(tmp_path / "jj"), "json")
    assert spark.read.json(str(tmp_path / "jj")).count() == 4
    sinks.write(found.select(*columns(2)), str(tmp_path / "two"))
    with pytest.raises(ValueError, match="headers"):
        sinks.merge(spark, [str(tmp_path / "t"), str(tmp_path / "two")], str(tmp_path / "x"))
    for how in (("cram",), ("sam", 2), ("sam", 3, False), ("bam", 2), ("bam", 3, False)):
        with pytest.raises(ValueError):
            sinks.check(*how)
    with pytest.raises(ValueError):
        sinks.write(found, str(tmp_path / "x"), "cram")
    (tmp_path / "old").write_text("query1\tACC001\t+\t0\t49\t500\t100\t149\t2000\t5\t15\t0\nbad\tline\nq\tA\t+\tx\t49\t500\t100\t149\t2000\t5\t15\t0\n")
    assert [(r.sseqid, r.chainscore) for r in texts.hits(spark, str(tmp_path / "old")).collect()] == [("ACC001", 15)]


def unpacked(data):
    """(header text, references, records as SAM lines) of a BAM file."""
    import gzip
    import struct

    assert data.endswith(bam.END)
    data = gzip.decompress(data)
    take = lambda form, at: struct.unpack_from(f"<{form}", data, at)
    assert data[:4] == b"BAM\1"
    at = 8 + take("I", 4)[0]
    text, n, refs, lines = data[8:at].decode(), take("I", at)[0], [], []
    at += 4
    for _ in range(n):
        size = take("I", at)[0]
        refs.append((data[at + 4 : at + 3 + size].decode(), take("I", at + 4 + size)[0]))
        at += size + 8
    while at < len(data):
        size, ref, start, label, quality, _, steps, flag, bases, mate, place, length = take("I2i2B3HI3i", at)
        end, at = at + 4 + size, at + 36
        name, at = data[at : at + label - 1].decode(), at + label
        cigar = "".join(f"{x >> 4}{bam.OPERATIONS[x & 15]}" for x in take(f"{steps}I", at))
        at += 4 * steps
        letters = "".join(bam.BASES[b >> 4] + bam.BASES[b & 15] for b in data[at : at + (bases + 1) // 2])[:bases]
        at += (bases + 1) // 2
        assert data[at : at + bases] == b"\xff" * bases and (mate, place, length) == (-1, -1, 0)
        at += bases
        tags = []
        while at < end and data[at + 2 : at + 3] == b"i":
            tags.append(f"{data[at : at + 2].decode()}:i:{take('i', at + 3)[0]}")
            at += 7
        if at < end:
            assert data[at : at + 4] == b"CGBI"
            cigar = "".join(f"{x >> 4}{bam.OPERATIONS[x & 15]}" for x in take(f"{take('I', at + 4)[0]}I", at + 8))
            at = end
        assert at == end
        lines.append("\t".join([name, str(flag), refs[ref][0], str(start + 1), str(quality), cigar, "*", "0", "0", letters, "*", *tags]))
    return text, refs, lines


def test_bam(spark, world, tmp_path):
    _, sequences, queries = world
    found = search([ix.build(sequences, 9)], queries, SearchConfig(mode=3, max_freq=1.0, trace=True, context="0"))
    sinks.write(found, str(tmp_path / "b"), "bam")
    text, refs, lines = unpacked((tmp_path / "b/alignments.bam").read_bytes())
    assert text == "".join(r.value + "\n" for r in sinks.sam_header(found).orderBy("part", "name").collect())
    assert refs == [("ACC000", 600), ("ACC001", 600), ("ACC005", 600)]
    assert sorted(lines) == sorted(r.value for r in sinks.sam_rows(found).collect()) and len(lines) == 3
    assert [p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith(".")] == ["alignments.bam"]
    many = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4000)))).withColumn("sseqid", F.concat("sseqid", F.lit("_"), F.col("n")))
    sinks.write(many, str(tmp_path / "b"), "bam")
    text, refs, lines = unpacked((tmp_path / "b/alignments.bam").read_bytes())
    assert len(refs) == 12000 and refs == sorted(refs) and text.count("@SQ") == 12000
    assert sorted(lines) == sorted(r.value for r in sinks.sam_rows(many).collect())
    sinks.write(found.where("false"), str(tmp_path / "none"), "bam")
    assert unpacked((tmp_path / "none/alignments.bam").read_bytes())[1:] == ([], [])
    with pytest.raises(ValueError, match="traceback"):
        bam.write(found.drop("cigar"), str(tmp_path / "x"))


def test_bam_records():
    assert [bam.interval_bin(*x) for x in ((0, 1), (0, 16384), (16383, 16385), (0, 1 << 20), (1 << 26, (1 << 26) + 1), (0, 1 << 29))] == [4681, 4681, 585, 73, 8777, 0]
    random.seed(3)
    noise = random.randbytes(200000)
    import gzip

    assert gzip.decompress(bam.blocks(noise)) == noise and bam.blocks(b"") == b""
    cigar = "1M1I" * 40000 + "7M"
    one = bam.record("q", 0, 5, True, cigar, "ACGTN" * 16001 + "RY", {"AS": -3})
    text = b"@HD\n"
    import struct

    data = b"BAM\1" + struct.pack("<I", len(text)) + text + struct.pack("<II", 1, 2) + b"s\0" + struct.pack("<I", 90000) + one
    assert unpacked(bam.blocks(data) + bam.END)[2] == ["\t".join(["q", "16", "s", "6", "255", cigar, "*", "0", "0", "ACGTN" * 16001 + "RY", "*", "AS:i:-3"])]
    with pytest.raises(ValueError, match="name"):
        bam.record("q" * 255, 0, 0, False, "1M", "A", {})


def test_stream_resumes(spark, world, tmp_path):
    from helixframe.streaming import resume

    _, sequences, queries = world
    built = ix.build(sequences, 9)
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    queries.where("qseqid = 'q0'").coalesce(1).write.parquet(source)
    resume.stream(spark, source, [built], out, at, SearchConfig(mode=1, max_freq=1.0)).awaitTermination()
    assert resume.results(spark, out).select("qseqid").distinct().count() == 1
    queries.where("qseqid = 'q1'").coalesce(1).write.mode("append").parquet(source)
    assert [r.qseqid for r in resume.remaining(queries, resume.done(spark, out)).collect()] == ["q1"]
    resume.stream(spark, source, [built], out, at, SearchConfig(mode=1, max_freq=1.0)).awaitTermination()
    assert resume.results(spark, out).count() == 3
    with pytest.raises(ValueError, match="begun with"):
        resume.stream(spark, source, [built], out, at, SearchConfig(mode=1, max_freq=0.9))
    nothing = spark.createDataFrame([("q9", "ACGT")], "qseqid string, seq string")
    nothing.coalesce(1).write.mode("append").parquet(source)
    resume.stream(spark, source, [built], out, at, SearchConfig(mode=1, max_freq=1.0)).awaitTermination()
    assert sorted(r.qseqid for r in resume.done(spark, out).collect()) == ["q0", "q1", "q9"]  # searched without a hit
    assert resume.signature(SearchConfig(), queries) != resume.signature(SearchConfig(mode=1), queries)


def test_sql_functions(spark):
    from helixframe.functions.register import register

    register(spark)
    assert len(spark.sql("SELECT kmers('ACGTACGT', 5, 0) AS k").first().k) == 4
    assert spark.sql("SELECT spaced_kmers('ACGTACGTACGTACGT', 11, 16, 'cod', 0) AS k").first().k[0].kmer == 470407
    assert spark.sql("SELECT sg_align('ACGT', 'ACGT').alnscore AS s").first().s == 20


def test_packed():
    import struct

    from helixframe.sources import packed

    two = bytes([0b00011011, 0b11100100])
    assert packed.unpack(two, 7) == "ACGTTGC"
    old = struct.pack(">II", 1, 15 << 28 | 1 << 24 | 2)
    assert packed.unpack(two, 8, old) == "ACNNTGCA"
    new = struct.pack(">IIIII", 1 << 31 | 4, 5 << 28 | 0 << 16, 6, 10 << 28 | 1 << 16, 0)
    assert packed.runs(new) == [(0, 2, "Y"), (6, 1, "R")] and packed.unpack(two, 8, new) == "YYGTTGRA"
    assert packed.runs(new[:-4]) == [] and packed.runs(b"") == []


def test_requests(spark, world, tmp_path):
    import json

    from helixframe.plans import requests

    seqs, sequences, _ = world
    ix.write(ix.build(sequences, 9), str(tmp_path))
    ask = {"k": 9, "mode": 1, "stage1_max_freq_frac_x10000": 10_000, "strand": 1, "queries": [{"qseqid": "q0", "sequence": seqs[0][200:300]}]}
    roots = {"db": str(tmp_path)}
    assert [r.sseqid for r in requests.answer(spark, roots, json.dumps(ask)).collect()] == ["ACC000"]
    assert requests.answer(spark, roots, json.dumps(ask | {"seqidlist_mode": "exclude", "seqids": ["ACC000"]})).count() == 0
    for bad in ({"queries": []}, {"db": "none"}, {"k": 8}, {"t": 16}):
        with pytest.raises(ValueError):
            requests.answer(spark, roots, json.dumps(ask | bad))
    got = requests.settings({"stage2_max_gap": 0, "stage1_min_score_frac_x10000": 2500, "stage3_traceback": 1, "context_frac_x10000": 5000, "stage1_score": 2, "accept_qdegen": 0})
    assert (got.max_gap, got.min_score, got.trace, got.context, got.matches, got.accept_degenerate) == (100, 0.25, True, "0.5000", True, False)


@pytest.mark.parametrize("expand,matches", [(1, False), (16, False), (16, True)])
def test_candidates_are_those_of_postings(spark, expand, matches):
    """Repeated and null ids, empty, null and long sequences, degenerate letters, a query without k-mers and one without an id."""
    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACGT" if i % 3 else "ACGTN", k=rng.choice([3, 40, 400]))) for i in range(60)]
    rows = [(i % 2, i // 2 if i < 8 else i if i % 11 else None, f"A{i}", s) for i, s in enumerate(seqs)]
    long = "".join(rng.choices("ACGT", k=1_200_000))  # read in parts
    rows += [(0, 100, "L", long), (1, 101, "E", ""), (1, 102, "Z", None)]
    sequences = spark.createDataFrame(rows, "volume int, oid long, accession string, seq string")
    texts = [seqs[9][:30], seqs[12][5:35] + "RYN" + seqs[12][38:60], seqs[14], "ACG", long[1_048_560:1_048_600] + long[:40]]
    queries = spark.createDataFrame([*((f"q{i}", t) for i, t in enumerate(texts)), (None, seqs[20])], "qseqid string, seq string")
    for at in ([seeds.offsets(5)], [seeds.offsets(12)], [seeds.offsets(11, 16, t) for t in (seeds.CODING, seeds.OPTIMAL)]):
        kmers_of = lambda a: qs.query_kmers(queries, len(a), 16 if a[-1] == 15 else 0, seeds.CONTIGUOUS if a[-1] != 15 else seeds.CODING if a == at[0] else seeds.OPTIMAL, expand)
        sought = [stages.Sought(kmers_of(a), a) for a in at]
        parts = [qs.thresholds(s.qk, s.qk.select("kmer").limit(0), 0.5, 0) for s in sought]
        limits = stages.merged(parts, ["qseqid", "strand"], threshold=F.sum("threshold"))
        want = stages._through_postings(sought, sequences, limits, matches)
        got = stages.candidates(sought, sequences, limits, None, matches)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 3


def test_query_kmers_in_blocks(spark, world, monkeypatch):
    _, sequences, queries = world
    found = lambda: sorted(map(str, search([ix.build(sequences, 9)], queries, SearchConfig(max_freq=1.0)).collect()))
    whole = found()
    for size in (100, 10):  # a block for each query and strand or so; queries beyond a block
        monkeypatch.setattr(stages, "QUERY_KMERS", size)
        assert found() == whole and len(whole) == 3


def test_searches_of_a_fresh_index_make_no_postings_but_of_candidates(spark, world):
    """search_both kept the postings of all sequences, many times their size."""
    _, sequences, queries = world
    both = ix.build_all(sequences, 11, 16, "both")
    for i in both:
        ix.kept(i)
    found = search(both, queries, SearchConfig(strand=1, max_freq=1.0))
    assert found.count() == 2 and not any(i.postings.storageLevel.useMemory for i in both)
    ix.release()


def test_stage1_topn_joins_no_postings(spark):
    """It shuffled a row for each k-mer that a query and a document share."""
    from helixframe.plans import catalog

    plan = catalog.stage1_topn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Join" not in plan
