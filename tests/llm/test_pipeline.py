import random

import pytest

import __spark_entry__
import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, sum string, copies int"


def make(spark, tmp_path, rows, items):
    out = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.mode("overwrite").parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n, a: " ".join(f"{rng.choice(a)}{rng.choice(a)}{rng.choice(a)}" for _ in range(n))
    alphabets = {"aa": ["ka", "mo", "si", "pa", "tu", "re", "ni"], "bb": ["sch", "gru", "wol", "zwe", "bli", "kno", "tau"]}
    item = text(30, alphabets["aa"])
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        rows.append([i, text(40, alphabets[lang]), lang, f"src{i % 5}"])
    rows += [[200, rows[0][1], "aa", "src1"], [201, rows[3][1].upper(), "bb", "src2"], [202, "intro " + item + " outro", "aa", "src1"], [203, "123 456", "aa", "src0"], [204, None, "aa", None], [None, text(40, alphabets["aa"]), None, "src1"], rows[5][:], rows[5][:]]
    rows = [(*r, None if r[1] is None else len(r[1]), "r", "i", "s", 3) for r in rows]
    out = make(spark, tmp_path, rows, [(1, item)])
    docs = spark.read.parquet(f"{out}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{out}/{name}"
        stage(spark, docs, out).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == before.columns
    whole = sorted(str(r[0]) for r in rows)
    assert kept["language_id"] == sorted(x for x in whole if x not in ("203", "204"))
    assert kept["near_dedup"] == sorted({*kept["language_id"]} - {"200", "201"})
    assert kept["decontamination"] == sorted({*kept["near_dedup"]} - {"202"})
    assert set(kept["source_mixing"]) <= set(kept["decontamination"]) and len(set(kept["source_mixing"])) > 60
    assert kept["sharding"] == kept["source_mixing"]
    assert corpus_pipeline.run(spark, out).count() == len(kept["sharding"])


def test_language_stage_drops_other_languages(spark, tmp_path):
    rng = random.Random(3)
    stems = {"aa": ["ka", "mo", "si", "pa", "tu", "re", "ni"], "bb": ["sch", "gru", "wol", "zwe", "bli", "kno", "tau"]}
    text = lambda n, a: " ".join("".join(rng.choices(a, k=3)) for _ in range(n))
    rows = [(i, text(40, stems[lang]), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(300, text(20, stems["aa"]) + " " + text(20, stems["bb"]), None), (301, text(3000, stems["aa"]), None)]  # two languages, and a very long text
    foreign = [(400, "Ο Αχιλλέας πήγε στη θάλασσα με το πλοίο", None), (401, "Съешь же ещё этих мягких французских булок", None), (402, "zxq vjfq qqyx hhdq xxyd fqvj " * 20, None), (403, "すべての人間は、生まれながらにして自由", None), (404, "++ -- 12", None)]
    out = make(spark, tmp_path, [(*r, "src1", 9, "r", "i", "s", 3) for r in rows + foreign], [])
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{out}/documents.parquet"), out).collect()}
    assert got == {r[0] for r in rows}


def test_near_dedup_of_texts_without_doc_ids(spark, tmp_path):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(i, t, "aa", "src1", 9, "r", "i", "s", 3) for i, t in [(None, a), (None, a + " tail"), (None, a), (None, b), (None, None), (3, a), (4, b + " tail")]]
    out = make(spark, tmp_path, rows, [])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{out}/documents.parquet"), out).collect()]
    assert {i for i, _ in got} == {None} and len(got) == 3
    assert {t for _, t in got} in ({a, b, None}, {a + " tail", b, None})


def test_decontamination_decides_by_row(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    item, clean = text(), [text() for _ in range(3)]
    rows = [(i, t, "aa", "src1", 9, "r", "i", "s", 3) for i, t in [(None, item), (None, clean[0]), (None, clean[1]), (None, None), (7, item), (7, clean[2]), (7, clean[2])]]
    out = make(spark, tmp_path, rows, [(1, item)])
    got = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{out}/documents.parquet"), out).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("None", clean[0]), ("None", clean[1]), ("None", "None"), ("7", clean[2]), ("7", clean[2])])


def test_nothing_to_do(spark, tmp_path):
    out = make(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, out).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op4_substring_dedup", "op7_source_mixing", "op9_quality_rules", "op10_ring_sharding", "base_personal_data", "base_url_rules"])
def test_sql(spark, name):
    import duckdb

    from pathlib import Path

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for name_ in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{sf}/{name_}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, str(sf)).toPandas()
    alike = lambda f: f.astype(object).where(f.notna(), None)  # noqa: E731  either side has its own nulls
    rows = lambda f: sorted(map(str, alike(f)[sorted(want.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
