"""Queries that answer every row, not the first few."""

import __spark_entry__


def test_every_company_has_a_row(spark, sf):
    companies = spark.read.parquet(f"{sf}/all_jobs.parquet").where("company is not null").select("company").distinct().count()
    assert companies > 100
    assert __spark_entry__.queries()["company_pay"](spark, sf).count() == companies


def test_every_fiftieth_vector_is_searched_for(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    got = __spark_entry__.queries()["cosine_topk_all"](spark, sf).collect()
    assert {r.query_id for r in got} == ids and len(got) == 20 * len(ids)
    assert all(r.vec_id == r.query_id for r in got if r.cos > 0.9999)
