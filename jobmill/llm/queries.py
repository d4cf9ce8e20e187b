"""Registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.functions.text import squeeze
from jobmill.llm.boilerplate import repeated_lines, without_repeated_lines
from jobmill.llm.canonical import canonical_values
from jobmill.llm.entities import match_openings, openings
from jobmill.llm.packing import CAPACITY, pack, token_counts
from jobmill.llm.sentences import sentence_units
from jobmill.llm.tokenizer import encode_column
from jobmill.operators.skew import join_counted
from jobmill.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry skill of every free-typed skill (TESTDATA.md, problem 1)."""
    fields = ["required_skills", "nice_to_have"]
    jobs = table(spark, sf_dir, "all_jobs").where("job_id is not null")
    registry = table(spark, sf_dir, "skill_registry").where("term is not null")
    typed = jobs.select("job_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("typed")) for f in fields])).alias("x"))
    typed = typed.select("job_id", "x.field_name", F.explode("x.typed").alias("raw_value")).where(squeeze("raw_value") != "")
    cases = typed.join(registry.select(F.col("term").alias("raw_value")).distinct(), "raw_value", "left_anti")
    mapped = canonical_values(cases, "raw_value", registry, "term")
    means = registry.groupBy(F.col("term").alias("entry")).agg(F.max(F.get("means", F.lit(0))).alias("means"))
    canon = mapped.join(means, "entry", "left").select(F.col("value").alias("raw_value"), "n", F.coalesce("means", "entry", F.lit("-")).alias("canon_term"))
    found = join_counted(cases, cut(canon), "raw_value", "n")
    return found.select("job_id", "field_name", "raw_value", "canon_term").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adverts of different sites that are one opening (TESTDATA.md, problem 2)."""
    return match_openings(table(spark, sf_dir, "all_jobs"), F.col("site").startswith("ats:")).select("job_id_a", "job_id_b")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, each with its confidence."""
    return match_openings(table(spark, sf_dir, "all_jobs"), F.col("site").startswith("ats:"))


def p2_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every advert with the opening it belongs to and how many adverts that has, one row for each."""
    return openings(table(spark, sf_dir, "all_jobs"), F.col("site").startswith("ats:"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a company repeats over its adverts (TESTDATA.md, problem 3)."""
    cases = repeated_lines(table(spark, sf_dir, "all_jobs"), "company", "job_id", "jd_text")
    return cases.select(F.col("document").alias("job_id"), "line_no")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every advert's text without the lines that its company repeats; each different text of a job_id once."""
    clean = without_repeated_lines(table(spark, sf_dir, "all_jobs").select("job_id", "company", "jd_text").distinct(), "company", "job_id", "jd_text")
    return clean.select("job_id", "company", "clean_text").distinct()


def p3_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a company repeats over at least 5 different texts on at least 2 days: republished adverts count once."""
    cases = repeated_lines(table(spark, sf_dir, "all_jobs"), "company", "job_id", "jd_text", by_text=True, published="posted_at", least_days=2)
    return cases.select(F.col("document").alias("job_id"), "line_no")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids (TESTDATA.md, problem 7)."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in containers of 2,048 tokens (TESTDATA.md, problem 8)."""
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every document is in them, each of its tokens once, and none is over its capacity."""
    sizes = cut(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    placed = cut(pack(sizes, "doc_id", "n_tokens").withColumn("used", F.col("part_to") - F.col("part_from")))
    of = placed.groupBy("doc_id").agg(F.sum("used").alias("placed"), F.count_distinct("part_from").alias("parts"), F.count(F.lit(1)).alias("pieces"))
    whole = sizes.join(of, "doc_id", "left").agg(F.count("placed").alias("documents"), F.count_if((F.col("placed") != F.col("n_tokens")) | (F.col("parts") != F.col("pieces"))).alias("not_whole"))
    over = placed.groupBy("container").agg(F.sum("used").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("over_capacity"))
    return whole.withColumn("over_capacity", over.scalar())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document (TESTDATA.md, problem 9)."""
    return sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p2_openings": p2_openings, "p3_found": p3_found, "p3_clean": p3_clean, "p3_by_text": p3_by_text, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_invariants": p8_invariants, "p9_found": p9_found}
# Full-width letters and their usual form, for SQL.
_WIDE = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
_USUAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = "line"
for _name, _sign in (("amp", "&"), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " ")):
    _KEY = f"replace({_KEY}, '&{_name};', '{_sign}')"
_KEY = f"regexp_replace(lower(strip_accents(translate({_KEY}, '{_WIDE}', '{_USUAL}'))), '[^\\p{{L}}]', '', 'g')"
_LINES = f"""l as (select job_id, company, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select distinct job_id, company, string_split(jd_text, chr(10)) as ls from all_jobs where job_id is not null and company is not null and jd_text is not null)),
 k as (select job_id, company, line_no, {_KEY} as key from l)"""

ORACLE: dict[str, str] = {
    "p3_found": f"with {_LINES}, r as (select company, key from k where key != '' group by 1, 2 having count(distinct job_id) >= 5) select distinct job_id, cast(line_no as int) as line_no from k join r using (company, key)",
    "p3_clean": f"""with {_LINES}, r as (select company, key from k where key != '' group by 1, 2 having count(distinct job_id) >= 5), cases as (select distinct job_id, line_no from k join r using (company, key)),
 t as (select *, row_number() over () as rid from (select distinct job_id, company, jd_text from all_jobs)), x as (select rid, job_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select rid, job_id, string_split(jd_text, chr(10)) as ls from t where jd_text is not null)),
 y as (select rid, string_agg(line, chr(10) order by x.line_no) as c from x left join cases on cases.job_id = x.job_id and cases.line_no = x.line_no where cases.job_id is null group by 1)
 select distinct job_id, company, case when jd_text is not null then coalesce(c, '') end as clean_text from t left join y using (rid)""",
    "p3_by_text": f"""with a as (select *, row_number() over () as rid from (select job_id, company, jd_text, cast(posted_at as date) as day from all_jobs where job_id is not null and company is not null and jd_text is not null)),
 l as (select rid, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select rid, string_split(jd_text, chr(10)) as ls from a)), k as (select rid, line_no, {_KEY} as key from l), w as (select rid, string_agg(key, '|' order by line_no) as text from k where key != '' group by 1),
 r as (select company, key from k join a using (rid) join w using (rid) where key != '' group by 1, 2 having count(distinct text) >= 5 and count(distinct day) >= 2)
 select distinct job_id, cast(line_no as int) as line_no from k join a using (rid) join r using (company, key)""",
    "p8_invariants": "select count(*) as documents, cast(0 as bigint) as not_whole, cast(0 as bigint) as over_capacity from documents",
}
