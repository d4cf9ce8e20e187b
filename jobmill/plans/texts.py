"""Text queries over adverts and documents: dictionary scans, sections, extracts, windows, mined terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.functions import rules as R
from jobmill.functions import terms as T
from jobmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CATEGORIES = {"duties": "what you will do|responsibilit|key duties|your day|the role", "required": "requirement|must have|you have|you bring|qualification", "nice": "nice to have|bonus|extras|good to know", "offer": "benefits|we offer|about us"}


def latest_adverts(spark: SparkSession, sf: str) -> DataFrame:
    """all_jobs with a text, one row for each job_id: the latest scrape, of equal ones the greatest text, then role."""
    j = table(spark, sf, "all_jobs").where("job_id is not null and jd_text is not null")
    rest = [c for c in j.columns if c != "job_id"]
    last = F.max_by(F.struct(*rest), F.struct(F.coalesce("scraped_at", F.lit("0001-01-01").cast("timestamp")), "jd_text", F.coalesce("role", F.lit("")), F.coalesce("company", F.lit("")), F.coalesce(F.array_join("required_skills", ","), F.lit(""))))
    return j.groupBy("job_id").agg(last.alias("r")).select("job_id", "r.*")


LATEST = """latest as (select * from all_jobs where job_id is not null and jd_text is not null qualify row_number() over (partition by job_id
 order by scraped_at desc nulls last, jd_text desc, coalesce(role, '') desc, coalesce(company, '') desc, coalesce(array_to_string(required_skills, ','), '') desc) = 1)"""

_CASE = "case " + " ".join(f"when regexp_matches(line, '(?i){p}') then '{c}'" for c, p in CATEGORIES.items()) + " end"
SECTIONS = rf"""{LATEST},
 l as (select job_id, unnest(ls) as line, generate_subscripts(ls, 1) as n from (select job_id, [regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g') for x in string_split(replace(jd_text, chr(13), ''), chr(10))] as ls from latest)),
 h as (select *, case when length(line) between 1 and 80 and (regexp_matches(line, '^#{{1,6}}\s') or regexp_matches(line, '^\*\*.+\*\*$') or line like '%:' or
  (length(line) <= 60 and not regexp_matches(line, '[.,;]$') and lead(line) over (partition by job_id order by n) = '')) then {_CASE} end as category from l),
 s as (select *, count(category) over (partition by job_id order by n) as place from h),
 sections as (select job_id, cast(place as int) as place, coalesce(max(category), 'preamble') as category, coalesce(regexp_replace(string_agg(line, chr(10) order by n) filter (category is null), '^\n+|\n+$', '', 'g'), '') as body from s group by job_id, place having max(category) is not null or coalesce(trim(string_agg(line, '') filter (category is null)), '') != '')"""


@query()
def longest_match_scan(spark, sf):
    """Registry terms in every document, the longest first, none over claimed words."""
    return T.scan(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "skill_registry"), "term")


@query(f"with {SECTIONS} select * from sections")
def advert_sections(spark, sf):
    """The sections of every advert's latest text by category."""
    return latest_adverts(spark, sf).select("job_id", F.explode(T.sections(F.col("jd_text"), CATEGORIES)).alias("s")).select("job_id", "s.*")


@query()
def required_and_nice(spark, sf):
    """Registry terms of every advert, each as required or nice to have by the sections it stands in: one that stands under a heading of
    requirements is required; one only under others (duties, offers, before any heading) is neither and isn't given."""
    s = advert_sections(spark, sf).where("category in ('required', 'nice')").withColumn("part", F.struct("job_id", "category"))
    hits = T.scan(s, "part", "body", table(spark, sf, "skill_registry"), "term")
    return hits.groupBy(F.col("part.job_id").alias("job_id"), "term").agg(F.bool_or(F.col("part.category") == "required").alias("required"))


@query()
def advert_extracts(spark, sf):
    """Every advert in at most 1,500 characters, the requirements first."""
    j = latest_adverts(spark, sf).select("job_id", F.col("jd_text").alias("text"), T.sections(F.col("jd_text"), CATEGORIES).alias("parts"))
    return j.select("job_id", T.extract_column(["required", "duties", "nice", "preamble"], 1500)("text", "parts").alias("extract"))


@query(r"""
with d as (select doc_id, text, length(text) as size from documents where text is not null and text != ''), w as (select *, unnest(range(0, greatest(1, cast(ceil((size - 100) / 900.0) as bigint)))) as i from d),
p as (select doc_id, i, size, substring(text, i * 900 + 1, 900) as own, substring(text, (i + 1) * 900 + 1, 100) as rep, greatest(1, cast(ceil((size - 100) / 900.0) as bigint)) as n from w)
select doc_id, cast(i as int) as window_no, own || case when i + 1 < n and contains(rep, chr(10)) then regexp_extract(rep, '(?s)^.*\n') else rep end as "window" from p""")
def text_windows(spark, sf):
    """Documents in overlapping windows of 1,000 characters."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(T.windows(F.col("text"), 1000, 100)).alias("window_no", "window"))


_WORD = "[A-Za-z][A-Za-z0-9+#]*(?:[.-][A-Za-z0-9+#]+)*"


@query(f"""
with l as (select distinct job_id, company, unnest(string_split(jd_text, chr(10))) as line from all_jobs where jd_text is not null),
w as (select job_id, company, unnest(ws) as word, generate_subscripts(ws, 1) as n from (select job_id, company, regexp_extract_all(line, '{_WORD}') as ws from l)),
c as (select lower(word) as k, word, count(*) as n from w where n > 1 group by 1, 2), u as (select lower(word) as k, count(distinct job_id) as jobs, count(distinct company) as companies from w where n > 1 group by 1),
t as (select k, sum(n) as times, sum(n) filter (word != k) as cased, max(struct_pack(n := n, word := word)) as top from c group by 1)
select top.word as term, jobs, companies, round(cased / times::double, 6) as cased from t join u using (k) where jobs >= 3 and cased >= 0.9 * times and k not in (select lower(term) from skill_registry where term is not null)""")
def mined_terms(spark, sf):
    """Words that may be names of skills and that the registry lacks, by corpus statistics: in three adverts at least, and written with a
    capital nine times in ten where they don't begin a line. Each with its most frequent spelling, adverts and companies."""
    lines = table(spark, sf, "all_jobs").where("jd_text is not null").select("job_id", "company", F.explode(F.split("jd_text", "\n", -1)).alias("line")).distinct()
    words = lines.select("job_id", "company", F.posexplode(F.regexp_extract_all("line", F.lit(_WORD), F.lit(0))).alias("n", "word")).where("n > 0").withColumn("k", F.lower("word"))
    spelt = words.groupBy("k", "word").agg(F.count(F.lit(1)).alias("n"))
    stats = spelt.groupBy("k").agg(F.sum("n").alias("times"), F.sum(F.when(F.col("word") != F.col("k"), F.col("n"))).alias("cased"), F.max(F.struct("n", "word")).alias("top")).where(F.col("cased") >= 0.9 * F.col("times"))
    spread = words.groupBy("k").agg(F.count_distinct("job_id").alias("jobs"), F.count_distinct("company").alias("companies")).where("jobs >= 3")
    known = table(spark, sf, "skill_registry").where("term is not null").select(F.lower("term").alias("k")).distinct()
    return stats.join(spread, "k").join(known, "k", "left_anti").select(F.col("top.word").alias("term"), "jobs", "companies", F.round(F.col("cased") / F.col("times"), 6).alias("cased"))


@query()
def cleaned_terms(spark, sf):
    """Typed skills split and cleaned, rejects with their rule."""
    c = table(spark, sf, "all_jobs").where("required_skills is not null").select("job_id", T.clean_terms_column("required_skills").alias("c")).distinct()
    return c.select("job_id", F.col("c.kept").alias("kept"), F.col("c.rejected").alias("rejected"))


STRESS = "must|required|strong|essential"


@query(rf"""
with {LATEST}, e as (select distinct job_id, role, jd_text, lower(trim(unnest(required_skills))) as skill from latest),
d as (select job_id, skill, regexp_replace(coalesce(lower(role), ''), '([^a-z0-9])', '\1\1', 'g') as title, [regexp_replace(x, '([^a-z0-9])', '\1\1', 'g') for x in string_split(lower(jd_text), chr(10))] as ls,
 '(?:^|[^a-z0-9])' || regexp_escape(regexp_replace(skill, '([^a-z0-9])', '\1\1', 'g')) || '(?:[^a-z0-9]|$)' as rx from e where skill != '')
select job_id, skill, len(regexp_extract_all(title, rx)) > 0 as in_title, cast(list_sum([len(regexp_extract_all(x, rx)) for x in ls]) as int) as times,
 cast(len([x for x in ls if regexp_matches(x, '(?:^|[^a-z0-9])(?:{STRESS})(?:[^a-z0-9]|$)') and regexp_matches(x, rx)]) as int) as stressed from d""")
def emphasis_signals(spark, sf):
    """How an advert stresses each skill it asks for: whether its title names it, how often the text does, and on how many lines beside
    a word that insists."""
    j = latest_adverts(spark, sf).where("required_skills is not null")
    e = j.select("job_id", F.lower(F.coalesce("role", F.lit(""))).alias("title"), F.lower("jd_text").alias("text"), F.explode(F.array_distinct(F.transform("required_skills", lambda x: F.lower(F.trim(x))))).alias("skill")).where("skill != ''")
    skill = F.col("skill")
    insists = lambda x: F.regexp_like(x, F.lit(rf"(?<![a-z0-9])(?:{STRESS})(?![a-z0-9])")) & (T.mentions(x, skill) > 0)
    return e.select("job_id", "skill", (T.mentions(F.col("title"), skill) > 0).alias("in_title"), T.mentions(F.col("text"), skill).alias("times"), F.size(F.filter(F.split("text", "\n", -1), insists)).alias("stressed"))
