"""Relational operators and rule functions on small tables, and the registered queries against their SQL."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobmill.functions import rules as R
from jobmill.operators import relational as O
from jobmill.operators.skew import join_counted


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_never_writes_null(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    s = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, v string, w int")
    assert sorted((r.k, r.v, r.w) for r in O.upsert(t, s, ["k"], ["v", "w"]).collect()) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert O.insert_absent(t, s.union(s), ["k"], F.col("w")).count() == 1


def test_diff_and_pick(spark):
    o = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    n = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string")
    assert rows(O.diff(o, n, ["k"], ["v"])) == [(1, "deactivate"), (2, "unchanged"), (3, "update"), (4, "insert")]
    assert rows(O.pick(o.union(n), ["k"], F.col("v").desc_nulls_last()).where("k = 3")) == [(3, "d")]


def test_nearest_rank(spark):
    d = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(1, 11)] + [("a", None)], "g string, v double")
    assert rows(O.nearest_rank(d, "v", [5, 50, 99], ["g"])) == [(g, p, v) for g in "ab" for p, v in ((5, 1.0), (50, 5.0), (99, 10.0))]


def test_running_total_of_a_hot_group(spark):
    d = spark.createDataFrame([("hot" if i % 10 else None, i) for i in range(500)], "g string, v int").repartition(5)
    got = {(r.g, r.v): r.t for r in O.running_total(d, ["g"], ["v"], F.col("v"), "t").collect()}
    assert len(got) == 500
    for g in ("hot", None):
        total = 0
        for i in range(500):
            if ("hot" if i % 10 else None) == g:
                total += i
                assert got[g, i] == total
    assert O.running_total(d.limit(0), ["g"], ["v"], F.col("v"), "t").count() == 0
    assert [r.value for r in O.nearest_rank(d, "v", [50]).collect()] == [249]


def test_similar_titles(spark):
    left = spark.createDataFrame([("k", "data engineer"), ("k", "cook"), (None, "x")], "c string, t string")
    right = spark.createDataFrame([("k", "data engineers"), ("k", "data engin"), ("o", "cook")], "c string, t string")
    assert [(r.t, r.match) for r in O.similar_titles(left, right, "c", "t").collect()] == [("data engineer", "data engineers")]


def test_similar_titles_against_all_pairs(spark):
    import difflib
    import random

    rnd = random.Random(7)
    base = ["senior data engineer", "data engineer, north", "risk modeller", "ab", "a", "aaaaaaaa"]
    typo = lambda t: "".join(ch if rnd.random() > 0.07 else rnd.choice("xyz ") for ch in t)
    left, right = ({("k", typo(rnd.choice(base))) for _ in range(150)} for _ in range(2))
    want = {}
    for _, a in left:
        best = max(((difflib.SequenceMatcher(None, a, b).ratio(), b) for _, b in right), default=(0, ""))
        if best[0] >= 0.9:
            want[a] = best[1]
    frames = [spark.createDataFrame(sorted(x), "c string, t string") for x in (left, right)]
    assert {r.t: r.match for r in O.similar_titles(*frames, "c", "t").collect()} == want
    assert O.similar_titles(frames[0].limit(0), frames[1], "c", "t").count() == 0


def test_similar_titles_in_cells_against_all_pairs(spark):
    import difflib
    import random

    rnd = random.Random(11)
    base = ["senior data engineer", "データエンジニア、東京本社", "a" * 90 + " b" * 70, "ab", "", "x", "naïve 🙂 analyst 🙂🙂"]
    typo = lambda t: "".join(ch if rnd.random() > 0.06 else rnd.choice("xyzé🙂 ") for ch in t)
    left, right = ({(rnd.choice("kkko"), typo(rnd.choice(base))) for _ in range(200)} for _ in range(2))
    frames = [spark.createDataFrame(sorted(x), "c string, t string") for x in (left, right)]
    for ratio in (0.5, 0.9, 1.0):
        want = {}
        for k, a in left:
            best = max(((1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio(), b) for j, b in right if j == k), default=(0, ""))
            # a title that the other side has is its own match
            best = (1.0, a) if (k, a) in right else best
            if best[0] >= ratio:
                want[k, a] = (best[1], best[0])
        for cell in (9, 8000):
            assert {(r.c, r.t): (r.match, r.ratio) for r in O.similar_titles(*frames, "c", "t", ratio, cell).collect()} == want


def test_similar_titles_write_no_pairs(spark):
    from pathlib import Path

    # one key, all titles alike: the pairs, and the titles' pairs of characters, would be many times the titles
    frames = [spark.createDataFrame([("k", f"senior platform engineer, group {n:04d} {side}") for n in range(300)], "c string, t string") for side in ("p", "b")]
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = written()
    found = O.similar_titles(*frames, "c", "t")
    assert found.count() == 300 and written() - before < 300_000


def test_set_cover_against_all_subsets(spark):
    from itertools import combinations

    items = {"g": [("i1", ["a", "b"]), ("i2", ["b", "c", "d"]), ("i3", ["a"]), ("i4", []), ("i5", ["e", "a"])], "h": [("j", None)]}
    df = spark.createDataFrame([(g, i, c) for g, xs in items.items() for i, c in xs], "g string, i string, c array<string>")
    got = O.set_cover(df, "g", "i", "c", most=2).where("g = 'g'").collect()
    best = max(len(set().union(*(set(c) for _, c in s))) for s in combinations(items["g"], 2))
    assert sum(r.adds for r in got) == best
    assert O.set_cover(df, "g", "i", "c").where("g = 'h'").count() == 0


def test_join_counted_keeps_every_row(spark):
    r = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("lost", 2), (None, 3)], "k string, i int")
    d = spark.createDataFrame([("hot", 50, "H"), ("cold", 1, "C")], "k string, n int, v string")
    assert join_counted(r, d, "k", "n", hot=10).groupBy("v").count().orderBy("v").collect() == [("C", 1), ("H", 50)]
    assert join_counted(r, d, "k", "n", how="left", hot=10).count() == 53


def test_rules(spark):
    d = spark.createDataFrame([(None, None), (5, "3-6 Yrs"), (50, "Fresher"), (500, "many")], "n int, e string")
    got = [tuple(r) for r in d.select(R.piecewise(F.col("n"), [(10, 1.5), (100, 1.0)], 1.0), R.experience_floor(F.col("e")), R.first_reason(("a", F.col("n") > 100), ("b", F.col("e") == "Fresher"))).collect()]
    assert [g[0] for g in got] == [1.0, 1.5, pytest.approx(1.5 - 40 * 0.5 / 90), 1.0]
    assert [g[1] for g in got] == [None, 3, 0, None]
    assert [g[2] for g in got] == [None, None, "b", "a"]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in v.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]
    t = spark.createDataFrame([("c++ and .net here", "c++"), ("scala", "cal"), ("c++x", "c++")], "t string, w string")
    assert [r[0] for r in t.select(R.has_term(F.col("t"), F.col("w"))).collect()] == [True, False, False]


def _plain(df: pd.DataFrame) -> list:
    def one(v):
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return [one(x) for x in v]
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([one(v) for v in r]) for r in df.itertuples(index=False))


def _names():
    import __spark_entry__

    return sorted(n for n in __spark_entry__.oracle_sql() if n in __spark_entry__.queries())


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    want = c.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_strategies(spark):
    from jobmill.plans import upkeep

    upkeep.STRATEGIES.clear()
    upkeep.register_strategy("a", lambda d: d.select("k", F.lit("by a").alias("v")))
    upkeep.register_strategy("b", lambda d: d.select("k", F.lit("by b").alias("v")))
    with pytest.raises(ValueError):
        upkeep.register_strategy("a", lambda d: d)
    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, m string")
    assert rows(upkeep.route(df, F.col("m"), "b")) == [(1, "by a"), (2, "by b"), (3, "by b")]
