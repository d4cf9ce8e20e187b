"""Canonical values against a search over all entries."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmill.llm import canonical as c
from jobmill.llm import queries as q


@pytest.mark.parametrize(
    "value, name",
    [
        ("Saixnai 6.13", "saixnai"), ("knowledge of query tuning", "query tuning"), ("• Geskongil  Mobile\xa0Kit;", "geskongil mobile kit"), ("Ｓａｓｔｓｉｍ", "sastsim"), ("Gloolаtіnd DB", "gloolatind db"), ("Drésuk", "dresuk"),
        ("natural language understanding experience", "natural language understanding"), ("D8M (deanforlum)", "deanforlum"), ("2+ years C++", "c++"), ("X &amp; Co Suite", "x co suite"), ("X and Co Suite", "x co suite"), ("Zistloost (preferred)", "zistloost"), ("Listdrook (v2+)", "listdrook"), ("R&amp;amp;amp;D &amp;amp;lt;lead&gt;", "r d lead"),
    ],
)
def test_readings(value, name):
    assert name in c.readings(value)


def test_readings_of_nothing():
    assert c.readings(None) == [] and c.readings("") == [] and c.readings(" ​- ") == []


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(max_examples=300, deadline=None)
def test_edits_is_a_distance(a, b):
    d = c.edits(a, b, 20)
    assert d == c.edits(b, a, 20) and (d == 0) == (a == b) and d <= max(len(a), len(b))
    assert c.edits(a, b, 1) == min(d, 2) or abs(len(a) - len(b)) > 1


def test_edits_counts_swaps():
    assert c.edits("stream", "starm", 5) == 2 and c.edits("ab", "ba", 5) == 1 and c.edits("ca", "abc", 5) == 2


def test_similar_names_against_all_pairs(spark):
    left = ["alpha beta", "beta alpha", "alpah bta", "gamma", "gama", "delta stream", "deltastream", "zzz", "東京", "ejnkisn", "jenkisn", "a"]
    right = ["alpha beta", "gamma", "delta stream", "東京", "jenkins", "sql", "a"]
    frames = [spark.createDataFrame([(x,) for x in xs], "name string") for xs in (left, right)]
    want = {(a, b) for a in left for b in right if c.verified(a, b)[1] < 99}
    near = {(a, b) for a in left for b in right if c.verified(a, b)[0] >= c.needed(len(b.replace(" ", ""))) and abs(len(a.replace(" ", "")) - len(b.replace(" ", ""))) <= 2}
    got = {(r.left_name, r.right_name) for r in c.similar_names(*frames).collect()}
    assert want <= near <= got and {("ejnkisn", "jenkins"), ("beta alpha", "alpha beta"), ("deltastream", "delta stream"), ("gama", "gamma")} <= want
    assert c.similar_names(frames[0].limit(0), frames[1]).count() == 0 and c.similar_names(frames[0], frames[1].limit(0)).count() == 0


@given(st.text("abcdef", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 13), st.sampled_from("abcdefxyz")), max_size=2))
@settings(max_examples=500, deadline=None)
def test_what_the_slips_leave_is_similar_enough(entry, changes):
    text = entry
    for kind, at, letter in changes[: c.slips(len(entry))]:
        i = at % len(text) if text else 0
        text = {0: text[:i] + letter + text[i + 1 :], 1: text[:i] + letter + text[i:], 2: text[:i] + text[i + 1 :], 3: text[:i] + text[i + 1 : i + 2] + text[i : i + 1] + text[i + 2 :]}[kind]
    jaccard, edits = c.verified(text, entry)
    assert edits <= len(changes)


@pytest.mark.parametrize("words", [3, 5, 8])
def test_word_order_never_matters(words):
    import random

    names = ["alpha", "query", "broker", "tuning", "vector", "stream", "ledger", "mobile"][:words]
    for seed in range(5):
        mixed = random.Random(seed).sample(names, words)
        mixed[0] = mixed[0][:-1]
        assert c.distance(" ".join(mixed), " ".join(names)) == 1


def test_canonical_values_edge_cases(spark):
    entries = spark.createDataFrame([("Data lineage",), ("data-lineage",), (None,), ("SMK",), ("Data lineage",)], "entry string")
    values = spark.createDataFrame([(None,), ("",), ("  ",), ("dta lineage",), ("dta lineage",), ("TMK",), ("smk",), ("lineage, Data",), ("x" * 20_000,)], "value string")
    got = {r.value: (r.n, r.entry) for r in c.canonical_values(values, "value", entries, "entry").collect()}
    assert got["dta lineage"] == (2, "Data lineage") and got["TMK"] == (1, None) and got["smk"] == (1, "SMK") and got["lineage, Data"] == (1, "Data lineage")
    assert got[""] == (1, None) and None not in got and got["x" * 20_000] == (1, None)


def test_jobs_against_a_full_search(spark, sf):
    registry = pd.read_parquet(f"{sf}/skill_registry.parquet")
    names = {t: c._words(c.plain(t)) for t in registry.term}
    means = {t: m[0] for t, m in zip(registry.term, registry.means) if m is not None and len(m)}
    jobs = pd.read_parquet(f"{sf}/all_jobs.parquet")
    want = set()
    memo = {}
    for r in jobs.itertuples():
        for f in ("required_skills", "nice_to_have"):
            for v in getattr(r, f) if getattr(r, f) is not None else ():
                if v is None or not v.strip() or v in names:
                    continue
                if v not in memo:
                    found = [(-j, e, t) for x in c.readings(v) for t, n in names.items() for j, e in [c.verified(x, n)] if e < 99]
                    memo[v] = means.get(min(found)[2], min(found)[2]) if found else "-"
                want.add((r.job_id, f, v, memo[v]))
    got = {tuple(r) for r in q.p1_found(spark, sf).collect()}
    assert got == want
