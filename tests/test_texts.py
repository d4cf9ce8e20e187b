"""Dictionary scans, sections, extracts, windows, mined terms, and line files."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmill.functions import terms as T
from jobmill.sources import files


@pytest.mark.parametrize("a, b", [("Data Models", "data-model"), ("optimise", "optimizing"), ("libraries", "library"), ("machine", "Machines"), ("test", "testing"), ("REST APIs", "rest api")])
def test_keys_fold_spellings(a, b):
    assert T.phrase_key(a) == T.phrase_key(b)


def test_keys_keep_words_apart():
    assert len({T.phrase_key(x) for x in ("C", "C++", "C#", ".net", "net", "class", "R", "go")}) == 8
    assert T.norm("Crème – C#") == "creme   c#" and T.norm(None) is None


def test_the_longest_claims_first():
    assert T.claimed([(0, 7, "machine"), (0, 16, "machine learning"), (8, 25, "learning platform"), (30, 32, "go")]) == [(0, 7, "machine"), (8, 25, "learning platform"), (30, 32, "go")]
    assert T.claimed([]) == []


def test_scan_edges(spark):
    df = spark.createDataFrame([(1, "Go and go", "x"), (1, None, "x"), (2, "", "x"), (None, "GO", "x"), (3, "word " * 50_000, "x"), (4, "machine learning platforms, machines; going", "x")], "k int, t string, term string")
    terms = spark.createDataFrame([("go",), (None,), ("Go",), ("machine learning",), ("machine",), ("learning platform",)], "term string")
    got = sorted((str(r.k), r.term, r.term_from, r.term_to) for r in T.scan(df, "k", "t", terms, "term").collect())
    assert got == [("1", "Go", 0, 2), ("1", "Go", 7, 9), ("4", "learning platform", 8, 26), ("4", "machine", 0, 7), ("4", "machine", 28, 36), ("None", "Go", 0, 2)]
    assert T.scan(df.limit(0), "k", "t", terms, "term").count() == 0 and T.scan(df, "k", "t", terms.limit(0), "term").count() == 0


def test_sections(spark):
    text = "Intro\r\n\n## Requirements\n* a\n  * b \nNice to have:\n* c\n\nBenefits\n\nfood\nour nice offer, long"
    df = spark.createDataFrame([(text,), ("",), (None,), ("Requirements:",)], "t string")
    got = [None if r.s is None else [tuple(x) for x in r.s] for r in df.select(T.sections(F.col("t"), {"required": "requirement", "nice": "nice", "offer": "benefits"}).alias("s")).collect()]
    assert got == [[(0, "preamble", "Intro"), (1, "required", "* a\n* b"), (2, "nice", "* c"), (3, "offer", "food\nour nice offer, long")], [], None, [(1, "required", "")]]


@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.text("xy \n", max_size=60)), max_size=6), st.integers(1, 120))
@settings(max_examples=200, deadline=None)
def test_extract_never_exceeds_its_room(parts, room):
    assert len(T.extract(parts, ["b", "a"], room, len)) <= room


def test_windows_cover_the_text(spark):
    import random

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab\n") for _ in range(n)) for n in (1, 9, 10, 11, 19, 20, 21, 200)] + ["", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.windows(F.col("t"), 10, 3).alias("w")).collect()
    for text, windows in got:
        if not text:
            assert windows == ([] if text == "" else None)
            continue
        at = 0
        for k, w in enumerate(windows):
            assert 0 < len(w) <= 10 and text[7 * k :].startswith(w) and 7 * k <= at
            at = 7 * k + len(w)
        assert at == len(text)


def test_mentions(spark):
    df = spark.createDataFrame([("go, going go c++ c+++ (c++)", "go"), ("c++ and c++11, xc++", "c++"), (None, "go"), ("a.b axb", "a.b")], "t string, s string")
    assert [r[0] for r in df.select(T.mentions(F.col("t"), F.col("s"))).collect()] == [2, 1, None, 1]


def test_cleaned():
    c = T.clean_terms(["Strong Python skills, SQL", None, "123", "python", "a b c d e f g"])
    assert c["kept"] == ["Python", "SQL"] and {r["rule"] for r in c["rejected"]} == {"empty", "no_letter", "clause"}
    assert T.clean_terms(None) == {"kept": [], "rejected": []}


def test_line_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"job_id": "a", "status": "new", "t": 1}\nbroken\n{"job_id": "a", "status": "done", "t": 3}\n{"job_id": "a", "status": "late", "t": 2}\n{"status": "x", "t": 9}\n')
    rows = files.read_json_lines(spark, str(log), "job_id string, status string, t int").cache()
    assert [(r.job_id, r.status) for r in files.last_of_key(rows, "job_id", F.col("t")).collect()] == [("a", "done")]
    df = spark.createDataFrame([("k", "x" * 500, ["a", "b"])], "k string, long string, arr array<string>")
    files.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert len(back.long) == 300 and back.arr == "a, b"
    assert {(r.value, r.n) for r in files.exploded_csv(spark, str(tmp_path / "csv"), "arr").collect()} == {("a", 1), ("b", 1)}
    for _ in range(2):
        files.append_new(spark.createDataFrame([(1,), (2,)], "id int"), str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert "- n: 3" in files.report(spark.range(3).agg(F.count("id").alias("n")), "T")


@pytest.mark.parametrize("name", ["longest_match_scan", "advert_sections", "required_and_nice", "advert_extracts", "text_windows", "mined_terms", "cleaned_terms", "emphasis_signals"])
def test_text_queries_run(spark, name):
    from jobmill.plans import texts

    assert texts.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
