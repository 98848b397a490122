"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names: for every operator and stage."""

import pytest

import corpus_pipeline
from fathomry.llm import decontamination, license_scan, lm_score, mixing, near_dedup, pii, quality_rules, secret_scan, toxicity, url_filter

LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
TEXTS = [None, "", " \n\t", "one", "x" * 200_000, LONG, LONG, "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "mail me: a.b@c.de\n+1 (22) 333-4444"]
EXTRA = "bucket long, words string, h string, n long, kept string, __w string, hit int, score double, pass int, `odd name` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "null id here it is, with a few words more than ten", None, None, None), (3, "another text of id three", None, "s", None)]
    pad = (1, "w", "h", 2, "k", "w", 3, 0.5, 4, "o")
    return spark.createDataFrame([(*r, *pad) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 0), (9, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h"), (2, "B c! d e f g h i"), (None, "k l m"), (4, None), (5, " "), (5, "n")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "mixing": mixing.mix,
        "pii": pii.find,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "secrets": secret_scan.scan,
        "decontamination": lambda d: decontamination.contamination(d, benchmark),
        "licenses": license_scan.licenses,
        "quality": quality_rules.quality_rules,
        "near": near_dedup.near_duplicates,
        "lm": lm_score.pseudo_likelihood,
    }


@pytest.mark.parametrize("name", ["mixing", "pii", "toxicity", "secrets", "decontamination", "licenses", "quality", "near", "lm"])
def test_operators(docs, labels, benchmark, name):
    op = operators(labels, benchmark)[name]
    got = op(docs).collect()
    ids = [r.doc_id for r in got]
    if name == "mixing":
        assert {*ids} == {r.doc_id for r in docs.collect()}
    else:
        assert sorted(ids, key=str) == sorted((r.doc_id for r in docs.collect()), key=str)
    assert op(docs.where("1 = 0")).collect() == []


def test_empty_side_tables(docs, labels, benchmark):
    assert {r.n_items for r in decontamination.contamination(docs, benchmark.where("1 = 0")).collect()} == {0}
    scores = toxicity.toxicity(docs, labels.where("1 = 0")).collect()
    assert len({r.score for r in scores}) == 1 and len(scores) == docs.count()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, benchmark, tmp_path, k):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    ids = {r.doc_id for r in rows}
    if name == "near_dedup":
        assert {0, 1, 2, 3, None} <= ids and not {6, 8} & ids
    if name == "decontamination":
        assert not {7, 8} & ids and None in ids
    if name == "pii":
        text = {r.doc_id: (r.text, r.n_chars) for r in rows}
        assert text[9] == ("mail me: [EMAIL]\n[PHONE]", 24) and text[0] == (None, 0) and text[5] == (LONG, len(LONG))
    assert stage(spark, docs.where("1 = 0"), str(tmp_path)).count() == 0


def test_pages(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.NET/de/8?x=/en/"), (4, "HTTP://A.Example.NET/de/8?x=/en/"), (None, "a://b://c/d#e"), (6, "x://" + "y" * 100_000 + ".com/en/")]
    pages = spark.createDataFrame([(*r, None, "w") for r in rows], "page_id long, url string, html string, words string")
    got = url_filter.judge(pages)
    assert {(r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in got.collect()} == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.net", "/de/8", "example.net/de/8", "block"),
        (None, "b:", "//c/d", None, "allow"), (6, "y" * 20, "/en/", "com/en/", "block"),
    }
    assert got.count() == 7 and url_filter.judge(pages.where("1 = 0")).count() == 0
