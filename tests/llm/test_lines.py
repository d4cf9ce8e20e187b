"""Repeated lines against brute force."""

import html
import unicodedata

import pandas as pd

from jobmill.llm import queries as q
from jobmill.llm.boilerplate import line_key, repeated_lines, without_repeated_lines


def plain_key(line):
    text = unicodedata.normalize("NFKD", html.unescape(html.unescape(line))).casefold()
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if ch.isalpha())


def test_line_key():
    assert line_key("Pléasé &amp; QUOTE 26549 – ｎｏｗ™!") == "pleasequotenow"
    assert line_key("12 -- ©") == "" and line_key("") == "" and line_key("&amp;lt;b&amp;gt;") == "b"
    assert line_key("R&amp;amp;amp;amp;D") == "rd"


def test_jobs(spark, sf):
    jobs = pd.read_parquet(f"{sf}/all_jobs.parquet")
    seen, places = {}, []
    for r in jobs.itertuples():
        if r.jd_text and r.company is not None:
            for n, line in enumerate(r.jd_text.split("\n"), 1):
                if k := plain_key(line):
                    seen.setdefault((r.company, k), set()).add(r.job_id)
                    places.append((r.company, k, r.job_id, n))
    want = {(j, n) for c, k, j, n in places if len(seen[c, k]) >= 5}
    got = [tuple(r) for r in q.p3_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_edges(spark):
    rows = [("s", f"d{i}", "Share this!\nown text " + "abcdefgh"[i] * 5 + "\n\n123") for i in range(5)]
    rows += [("s", "d0", rows[0][2]), ("s", "d9", None), (None, "d8", "Share this!"), ("s", None, "Share this!"), ("t", "d7", "SHARE THIS"), ("s", "e", "")]
    df = spark.createDataFrame(rows, "source string, document string, text string")  # clashing names
    assert {tuple(r) for r in repeated_lines(df, "source", "document", "text").collect()} == {(f"d{i}", 1) for i in range(5)}
    clean = {(r.document, r.clean_text) for r in without_repeated_lines(df, "source", "document", "text").collect()}
    assert ("d1", "own text bbbbb\n\n123") in clean and ("d9", None) in clean and ("d7", "SHARE THIS") in clean and ("e", "") in clean
    assert repeated_lines(df.limit(0), "source", "document", "text").count() == 0


def test_hot_lines_take_the_other_way(spark, monkeypatch):
    from jobmill.llm import boilerplate

    df = spark.createDataFrame([("s", i, "hello\nworld " + ("x" if i < 6 else "y" * i)) for i in range(30)], "c string, d int, t string")
    want = {tuple(r) for r in repeated_lines(df, "c", "d", "t").collect()}
    monkeypatch.setattr(boilerplate, "HOT", 10)
    assert {tuple(r) for r in repeated_lines(df, "c", "d", "t").collect()} == want and len(want) == 36


def test_republished_texts_count_once(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 1, n, 8)
    rows = [("s", f"copy{i}", "A story\nretold", day(1)) for i in range(9)]
    rows += [("s", f"own{i}", "Follow us\nstory " + "abcdef"[i], day(1 + i % 3)) for i in range(6)]
    rows += [("s", f"day{i}", "Only today\ntale " + "abcdef"[i], day(5)) for i in range(6)] + [("s", "undated", "Follow us", None)]
    df = spark.createDataFrame(rows, "s string, d string, t string, p timestamp")
    by_id = {tuple(r) for r in repeated_lines(df, "s", "d", "t").collect()}
    assert {("copy3", 1), ("copy3", 2), ("own1", 1), ("day2", 1), ("undated", 1)} <= by_id
    by_text = {tuple(r) for r in repeated_lines(df, "s", "d", "t", by_text=True).collect()}
    assert by_text == {x for x in by_id if not x[0].startswith("copy")}
    dated = {tuple(r) for r in repeated_lines(df, "s", "d", "t", by_text=True, published="p", least_days=2).collect()}
    assert dated == {(f"own{i}", 1) for i in range(6)} | {("undated", 1)}


def test_clean_texts_of_all_jobs(spark, sf):
    cases = {}
    for r in q.p3_found(spark, sf).collect():
        cases.setdefault(r.job_id, set()).add(r.line_no)
    jobs = spark.read.parquet(f"{sf}/all_jobs.parquet").select("job_id", "company", "jd_text").distinct().collect()
    want = {(j, c, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in cases.get(j, ()))) for j, c, t in jobs}
    assert {tuple(r) for r in q.p3_clean(spark, sf).collect()} == want
