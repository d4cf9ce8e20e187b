"""Openings across sites: parsing, links of names, and pairs."""

import pytest
from pyspark.sql import functions as F

from jobmill.llm import entities as e
from jobmill.llm import places
from jobmill.llm import queries as q


@pytest.mark.parametrize("name, words", [("Acme Foods Pvt. Ltd.", "acme foods"), ("ACME FOODS S.A.", "acme foods"), ("Acme Foods (formerly X Works)", "acme foods"), ("acmefoods.example", "acmefoods"), ("The Acme Foods Group", "acme foods"), ("Acme Steel & Alloys AG", "acme steel alloys"), ("", ""), (None, "")])
def test_company(name, words):
    assert " ".join(e.company_words(name)) == words


@pytest.mark.parametrize(
    "title, parts",
    [
        ("Senior Data Engineer, Night Owl", ("senior data engineer", "night owl")), ("Hiring: Data Eng. (Sr.) - Night Owl #REQ", ("senior data engineer", "night owl")), ("DATA ENGINEER, JNR", ("junior data engineer", "")),
        ("Front End Engr | Hybrid", ("frontend engineer", "")), ("UX Researcher 3-6 Yrs", ("ux researcher", "")), ("Priinc. Cook", ("principal cook", "")), ("Cook (Jnn), Night Owl", ("junior cook", "night owl")), ("SRE", ("site reliability engineer", "")), ("ML Engineer, Siaff", ("staff machine learning engineer", "")), (None, ("", "")), ("", ("", "")),
    ],
)
def test_role(title, parts):
    assert e.role_parts(title) == parts


@pytest.mark.parametrize("place, parts", [("Wien, Austria", ["wien", "austria"]), ("東京 / Remote", ["東京"]), ("India - Hitec City, Hyderabad", ["india", "hitec city", "hyderabad"]), (" MONTRÉAL (Hybrid)", ["montreal"]), ("Remote", []), ("", []), (None, []), ("Leeds, UK", ["leeds", "united kingdom"])])
def test_place(place, parts):
    assert places.parts(place) == parts


COLUMNS = "job_id string, company string, role string, site string, location string, posted_at timestamp, salary_min_lpa double, years_required int, role_level string, slips int"


def jobs(spark, rows):
    from datetime import datetime

    at = lambda d: datetime(2026, 1, d) if d else None
    return spark.createDataFrame([(i, c, r, s, l, at(d), None, None, None, 1) for i, c, r, s, l, d in rows], COLUMNS)


def test_pairs(spark):
    rows = [
        ("a1", "Acme Foods Ltd", "Senior Data Engineer", "ats:x", "Pune, India", 1), ("b1", "acmefoods.example", "Sr Data Engr", "naukri", "Pune (Hybrid)", 2), ("c1", "Acme Fodos", "Data Engineer, Snr", "indeed", None, 2),
        ("a2", "Acme Foods Ltd", "Senior Data Engineer", "ats:x", "Paris, France", 20), ("b2", "Acme Foods", "Senior Data Engineer", "indeed", "Paris 9e", 21), ("a3", "Acme Foods Ltd", "Data Engineer", "ats:x", "Pune, India", 1),
        ("a1", "Acme Foods Ltd", "Senior Data Engineer", "ats:x", "Pune, India", 1), (None, "Acme Foods", "Senior Data Engineer", "indeed", "Pune", 1), ("z1", None, "Senior Data Engineer", "indeed", "Pune", 1), ("z2", "Acme Foods", None, "indeed", "Pune", 1), ("d1", "Acme Foods", "Senior Data Engineer", None, "Pune", 1), ("e1", "Jobs at Acme Foods via Hirely", "Senior Data Engineer", "linkedin", "Pune", 2),
    ]
    df = jobs(spark, rows)
    got = {(r.job_id_a, r.job_id_b) for r in e.match_openings(df, F.col("site").startswith("ats:")).collect()}
    assert got == {("a1", "b1"), ("a1", "c1"), ("b1", "c1"), ("a2", "b2"), ("a1", "e1"), ("b1", "e1"), ("c1", "e1")}
    assert e.match_openings(df.limit(0), F.col("site").startswith("ats:")).count() == 0


def own():
    return F.col("site").startswith("ats:")


def found(df):
    return {(r.job_id_a, r.job_id_b) for r in e.match_openings(df, own()).collect()}


def test_another_city_is_another_opening_whatever_its_name(spark):
    rows = [(f"{s}{k}", "Acme Foods", "Data Engineer", site, place, 1) for k, place in enumerate(("Oslo, Norway", "Milan, Italy", "Stockholm")) for s, site in (("a", "linkedin"), ("b", "naukri"))]
    assert found(jobs(spark, rows)) == {("a0", "b0"), ("a1", "b1"), ("a2", "b2")}
    assert found(jobs(spark, [r for r in rows if r[0] in ("a0", "b1")] + [("x", "Acme Foods", "Data Engineer", "ats:x", "Stockholm, Sweden", 1)])) == set()


def test_other_names_of_a_city_are_learned(spark):
    rows = [(f"{s}{k}", f"Acme{chr(97 + k) * 6} Foods", "Data Engineer", site, place, 1) for k in range(8) for s, site, place in (("a", "ats:x", "Mumbai, Maharashtra, India"), ("b", "naukri", "Bombay"), ("c", "indeed", "Andheri, Mumbai"), ("d", "linkedin", "Bombbay"))]
    want = {(f"{x}{k}", f"{y}{k}") for k in range(8) for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")}
    assert found(jobs(spark, rows)) == want


def test_a_firm_within_a_long_name(spark):
    name = " ".join(f"word{n}" for n in range(24)) + " Acme Foods"
    rows = [("a", "Acme Foods", "Cook", "ats:x", "Pune, India", 1), ("b", name, "Cook", "naukri", "Pune", 1)]
    assert found(jobs(spark, rows)) == {("a", "b")}


def test_roles_that_no_board_lists_are_held_against_each_other(spark):
    rows = [("a", "Acme Foods", "Beekeeping Instructor", "indeed", "Pune", 1), ("b", "Acme Foods", "Beekeping Instructor", "naukri", "Pune", 1), ("c", "Acme Foods", "Beekeeping Inspector", "linkedin", "Pune", 1), ("o", "Acme Foods", "Cook", "ats:x", "Pune, India", 1)]
    assert found(jobs(spark, rows)) == {("a", "b")}


def test_classes(spark, sf):
    df = spark.read.parquet(f"{sf}/all_jobs.parquet")
    rows = e.openings(df, own()).collect()
    assert len({r.job_id for r in rows}) == len(rows) and all(0.5 <= r.sure <= 1 for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.opening] = sizes.get(r.opening, 0) + 1
    assert all(sizes[r.opening] == r.records for r in rows)
    at = {r.job_id: r.opening for r in rows}
    pairs = [(r.job_id_a, r.job_id_b) for r in q.p2_found(spark, sf).collect()]
    assert all(at.get(a) == at.get(b) for a, b in pairs)


def test_the_model_learns_from_labels_and_holds_to_the_prior_without():
    import pandas as pd

    class Labels:  # as much of a DataFrame as train() uses
        def __init__(self, rows):
            self.rows = rows

        orderBy = limit = lambda self, *_: self

        def toPandas(self):
            return pd.DataFrame(self.rows, columns=[*e.FEATURES, "label", "order"])

    assert list(e.train(Labels([]))) == pytest.approx(e.PRIOR)
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (4000, len(e.FEATURES))).astype(float)
    p = 1 / (1 + np.exp(-(3 * x[:, 4] - 2 * x[:, 8])))
    w = e.train(Labels([[*r, int(rng.random() < q), 0] for r, q in zip(x, p)]))
    got = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert abs(got.mean() - p.mean()) < 0.03 and np.abs(got - p).mean() < 0.08


def test_link_forms_prefers_what_is_listed(spark):
    typed = spark.createDataFrame([("k", "", f, 1, [f], []) for f in ("brahixjorsab", "brahnxjorsab", "irkzorharqui", "irkzorhavqui", "nothingnear", "")], "kind string, scope string, form string, n long, heads array<string>, parts array<string>")
    listed = spark.createDataFrame([("k", "brahixjorsab", "brahixjorsabtravel", 3)], "kind string, form string, name string, weight long")
    got = {r.form: (r.name, r.slips) for r in e.link_forms(typed, listed).collect()}
    assert got["brahixjorsab"] == ("brahixjorsabtravel", 0) and got["brahnxjorsab"] == ("brahixjorsabtravel", 1)
    assert got["irkzorharqui"][0] == got["irkzorhavqui"][0] and got["nothingnear"] == ("nothingnear", 0)


def test_bands_find_what_is_near():
    hits = sum(bool({(k, h) for k, h in enumerate(e.signature(a))} & {(k, h) for k, h in enumerate(e.signature(b))}) for a, b in [("brahixjorsab", "brahnxjorsab"), ("croasbrulreztravel", "crosabrulreztravel"), ("dataengineer", "dataengineeer"), ("brafengolorchard", "brasengolorchard")])
    assert hits == 4


def test_jobs_are_consistent(spark, sf):
    pairs = q.p2_found(spark, sf).collect()
    site = {r.job_id: r.site for r in spark.read.parquet(f"{sf}/all_jobs.parquet").select("job_id", "site").collect()}
    assert pairs and len(pairs) == len(set(pairs))
    assert all(r.job_id_a < r.job_id_b and site[r.job_id_a] != site[r.job_id_b] for r in pairs)


def test_logistic():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = e.fit_logistic(x, y)
    assert np.allclose(w, [0.5, 2, -1], atol=0.25)


def test_variants_meet_where_names_are_two_slips_apart():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        name = "".join(rnd.choice("abcdef") for _ in range(rnd.randint(5, 12)))
        typed = list(name)
        for _ in range(2 if len(name) > 6 else 1):
            i, kind = rnd.randrange(len(typed)), rnd.randrange(4)
            if kind == 0:
                typed[i] = rnd.choice("xyz")
            elif kind == 1:
                typed.insert(i, rnd.choice("xyz"))
            elif kind == 2:
                del typed[i]
            elif i:
                typed[i - 1], typed[i] = typed[i], typed[i - 1]
        assert set(places.variants("".join(typed))) & set(places.variants(name)) or edits_of("".join(typed), name) > 2


def edits_of(a, b):
    from jobmill.llm.canonical import edits

    return edits(a, b, 5)
