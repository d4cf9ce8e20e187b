"""Queries over every term, those with signs, several words or other scripts included."""

import __spark_entry__


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


TEXTS = [
    (1, "We use C++, Node.js and .NET here.\nNode.js again; Über-Café daily"),
    (2, "cloud  console, net and node js; machine-learning; caféx ★ c; 大阪でkotlinの経験"),
    (3, None),
]


def test_gap_terms_all_checks_every_asked_term(spark, tmp_path):
    asked = ["C++", "c#", ".NET", "net", "asp.net", "Node.js", "cloud console", "Cloud cons​ole", "cloud storage", "machine learning", "über-café", "uber", "x", "c", "★", "☆", " ", None, "Node.js and .NET here", "rust", "kotlin", "経験", "東京"]
    sf = tables(spark, tmp_path, all_jobs=([("a", asked), ("b", None)], "job_id string, required_skills array<string>"), documents=(TEXTS, "doc_id long, text string"))
    got = [r.token for r in __spark_entry__.queries()["gap_terms_all"](spark, sf).collect()]
    assert sorted(got) == sorted(["c#", "asp.net", "cloud storage", "uber", "x", "☆", "rust", "東京"])


def test_gap_terms_all_has_the_rows_of_gap_terms(spark, sf):
    queries = __spark_entry__.queries()
    some, whole = ({r.token for r in queries[n](spark, sf).collect()} for n in ("gap_terms", "gap_terms_all"))
    assert some < whole


def test_boundary_terms_with_signs(spark, tmp_path):
    terms = [(t,) for t in ("C++", ".NET", "Node.js", "C", "net", "★", "A B", "machine-learning", "rust", "kotlin", None)]
    sf = tables(spark, tmp_path, skill_registry=(terms, "term string"), documents=(TEXTS, "doc_id long, text string"))
    queries = __spark_entry__.queries()
    assert {r.term: r.docs for r in queries["boundary_term_hits_all"](spark, sf).collect()} == {"c++": 1, ".net": 1, "node.js": 1, "c": 1, "net": 2, "★": 1, "machine-learning": 1, "kotlin": 1}
    first = {(r.doc_id, r.term): (r.first_place, r.times) for r in queries["first_occurrence_all"](spark, sf).collect()}
    assert first[1, "node.js"] == (4, 2) and first[1, "c++"] == (3, 1) and first[2, "★"] == (10, 1)
