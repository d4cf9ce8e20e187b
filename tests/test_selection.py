"""Picking items and range joins against brute force; single postings; shingles; relative dates; the board readers' new fields."""

import itertools
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmill.operators.relational import children, jaccard_pairs, pick_n
from jobmill.operators.selection import Item, pick, pick_items, range_join, weight_of
from jobmill.sources.boards import posted_relative, read_details, read_json

WEIGHTS = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 1.0, "e": 0.5}


@given(st.lists(st.frozensets(st.sampled_from("abcde"), max_size=3), max_size=7), st.integers(0, 4), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_pick(sets, most, least):
    items = [Item(n, c, n == 3) for n, c in enumerate(sets)]
    got = pick(items, WEIGHTS, most, least)
    assert len(got) <= most and len({i.id for i in got}) == len(got)
    if most and len(items) > 3:
        assert any(i.pinned for i in got)
    assert len(got) >= min(most, least, len(items))
    value = lambda of: weight_of(frozenset().union(*(i.covers for i in of)) if of else (), WEIGHTS)
    free = [i for i in items if not i.pinned]
    best = max((value([*c, *[i for i in items if i.pinned][:most]]) for n in range(most + 1) for c in itertools.combinations(free, max(0, min(n, most - sum(i.pinned for i in items))))), default=0)
    assert value(got) >= (1 - 1 / 2.7) * best - 1e-9  # greedy's bound, exchanges can only add


def test_what_must_be_shown_is_promoted():
    items = [Item(1, frozenset("abc")), Item(2, frozenset("bcd")), Item(3, frozenset("e")), Item(4, frozenset("d"))]
    assert {i.id for i in pick(items, WEIGHTS, 2)} == {1, 2}
    assert {i.id for i in pick(items, WEIGHTS, 2, must=frozenset("e"))} == {1, 3}
    assert [i.id for i in pick(items, WEIGHTS, 0, must=frozenset("e"))] == [] and pick([], WEIGHTS, 3) == []


def test_pick_items(spark):
    rows = [(1, 1, ["a"], True), (1, 2, ["b", "c"], False), (1, 2, ["b"], False), (1, 3, None, False), (2, 9, ["z"], None), (None, 1, ["a"], True), (1, None, ["a"], True)]
    df = spark.createDataFrame(rows, "g int, i int, c array<string>, p boolean").withColumn("w", F.expr("map('a', 3.0D, 'b', 2.0D, 'c', 1.0D)"))
    assert {tuple(r) for r in pick_items(df, "g", "i", "c", "w", 2, pinned="p").collect()} == {(1, 1, 0, 3.0), (1, 2, 1, 3.0)}
    assert pick_items(df.limit(0), "g", "i", "c", "w", 2).count() == 0


def test_range_join(spark):
    rnd = random.Random(1)
    points = [(rnd.choice("xy"), rnd.randint(0, 100)) for _ in range(60)] + [(None, 1), ("x", None)]
    ranges = [(rnd.choice("xy"), a := rnd.randint(-5, 100), a + rnd.randint(0, 40)) for _ in range(30)] + [("x", None, 5), (None, 0, 100)]
    got = sorted(tuple(r) for r in range_join(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(ranges, "k string, s long, e long"), ["k"], "at", "s", "e", 7).select("k", "at", "s", "e").collect())
    assert got == sorted((k, p, s, e) for k, p in points for q, s, e in ranges if k is not None and k == q and p is not None and s is not None and s <= p < e)


def test_jaccard_pairs(spark):
    rnd = random.Random(2)
    base = [rnd.sample(range(40), 12) for _ in range(6)]
    rows = [(rnd.choice("xy"), n, [t for t in base[n % 6] if rnd.random() > 0.06]) for n in range(60)] + [("x", 99, []), ("x", 98, None), (None, 97, [1])]
    want = set()
    for (g, a, s), (h, b, t) in itertools.combinations(rows, 2):
        if g is not None and g == h and s and t and len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t)):
            want.add((g, min(a, b), max(a, b)))
    got = jaccard_pairs(spark.createDataFrame(rows, "g string, i int, s array<int>"), ["g"], "i", "s", 0.8).collect()
    assert {(r.g, r.i_a, r.i_b) for r in got} == want and len(got) == len(want) > 5


def test_children_and_pick_n(spark):
    df = spark.createDataFrame([('{"a": "x", "b": {"c": 1}, "d": [1], "e": null, "f": 2}',), ('["y", {"z": 1}]',), ("{}",)], "t string")
    got = [[(x.key, x.kind, x.text) for x in r.c] for r in df.select(children(F.col("t")).alias("c")).collect()]
    assert sorted(got[0], key=str)[:3] == [("a", "STRING", "x"), ("b", "NESTED", '{"c":1}'), ("d", "NESTED", "[1]")] and [k for _, k, _ in got[1]] == ["STRING", "NESTED"] and got[2] == []
    rows = spark.createDataFrame([(g, n) for g in "ab" for n in range(5)] + [(None, 1)], "g string, n int")
    assert {tuple(r) for r in pick_n(rows, ["g"], ["n"], 2).collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1), (None, 1)}


def test_relative_dates(spark):
    texts = ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "posted 1 day ago", "soon", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select((F.datediff(F.lit("2026-03-31").cast("timestamp"), posted_relative(F.col("t"), F.lit("2026-03-31").cast("timestamp"))))).collect()
    assert [r[0] for r in got] == [0, 1, 3, 31, 1, None, None]
    body = json.dumps({"jobPostings": [{"bulletFields": ["R1"], "title": "Cook", "postedOn": "Posted 2 Days Ago"}, {"bulletFields": ["R2"], "title": "Cook", "postedOn": "Rolling"}]})
    rows = spark.createDataFrame([("workday", "b", body)], "ats string, board_id string, body string").withColumn("polled_at", F.lit("2026-03-31").cast("timestamp"))
    assert [(r.posting_id, r.posted) for r in read_json(rows, "workday").orderBy("posting_id").collect()] == [("R1", "2026-03-29T00:00:00Z"), ("R2", "Rolling")]


def test_lever_blocks_and_workable_owner(spark):
    lever = json.dumps([{"id": "1", "text": "Cook", "descriptionPlain": "We cook.", "lists": [{"text": "You", "content": "<li>chop</li><li>fry</li>"}], "additionalPlain": "Bye."}])
    workable = json.dumps({"name": "Acme", "jobs": [{"shortcode": "S", "title": "Cook"}]})
    df = spark.createDataFrame([("lever", "b", lever), ("workable", "b", workable)], "ats string, board_id string, body string")
    assert read_json(df, "lever").first().description == "We cook.\n\n### You\n\n* chop\n* fry\n\nBye."
    assert read_json(df, "workable").first().company == "Acme"


def test_details(spark):
    page = lambda d: f'<script type="application/ld+json">{json.dumps(d)}</script>'
    rows = [("1", page({"title": "Cook", "hiringOrganization": "Acme", "jobLocation": [{"address": {"addressLocality": "Pune"}}], "description": "<p>a</p>"})), ("2", page([{"title": "Chef", "hiringOrganization": {"name": "B"}}])), ("3", "<html>"), ("4", None)]
    got = {r.posting_id: (r.title, r.company, r.location, r.description) for r in read_details(spark.createDataFrame(rows, "posting_id string, body string")).collect()}
    assert got == {"1": ("Cook", "Acme", "Pune", "a"), "2": ("Chef", "B", None, None), "3": (None,) * 4, "4": (None,) * 4}


def test_file_ranges(spark, tmp_path):
    from jobmill.sources.files import file_ranges, files_between

    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 as twice").repartitionByRange(4, "id").write.parquet(path)
    got = sorted((int(r.low), int(r.high), r.rows) for r in file_ranges(spark, path, "twice").collect())
    assert len(got) == 4 and got[0][0] == 0 and got[-1][1] == 198 and sum(r[2] for r in got) == 100 and all(a[1] < b[0] for a, b in zip(got, got[1:]))
    few = files_between(file_ranges(spark, path, "twice"), 190, 500)
    assert len(few) == 1 and spark.read.parquet(*few).where("twice >= 190").count() == 5
    assert file_ranges(spark, str(tmp_path / "none"), "twice").count() == 0
