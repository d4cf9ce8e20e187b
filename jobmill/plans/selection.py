"""What is picked for an advert, ranges, bounds, budgets and bodies of single postings, each with its SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.functions import rules as R
from jobmill.functions import terms as T
from jobmill.operators import relational as O
from jobmill.operators.nested import flatten
from jobmill.operators.selection import pick_items, range_join
from jobmill.plans.checklists import _SHOWN, checklist, shown_lines, trimmed
from jobmill.plans.texts import CATEGORIES, LATEST, SECTIONS, latest_adverts
from jobmill.session import table
from jobmill.sources.boards import read_details

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query()
def picked_lines(spark, sf):
    """For each advert the five lines that show most of its checklist's weight, the first line of its text always among them."""
    weights = checklist(spark, sf).groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "weight")))).alias("weights"))
    shown = shown_lines(spark, sf).groupBy("job_id", "line_no").agg(F.collect_set("skill").alias("covers"))
    items = shown.join(weights, "job_id").withColumns({"pinned": F.col("line_no") == 1, "must": F.map_keys("weights")})
    return pick_items(items, "job_id", "line_no", "covers", "weights", 5, pinned="pinned", must="must")


_BLOCKS = rf"""{SECTIONS}, sk as (select distinct job_id, lower(trim(unnest(required_skills))) as skill from latest), n as (select job_id, count(*) as n from sk where skill != '' group by 1),
 blocks as (select s.job_id, s.place, s.category, n.n as asked, count(*) filter (regexp_matches(regexp_replace(lower(s.body), '([^a-z0-9])', '\1\1', 'g'), '(?:^|[^a-z0-9])' || regexp_escape(regexp_replace(sk.skill, '([^a-z0-9])', '\1\1', 'g')) || '(?:[^a-z0-9]|$)')) as shown
  from sections s join sk on sk.job_id = s.job_id and sk.skill != '' join n on n.job_id = s.job_id group by 1, 2, 3, 4)"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(job_id, place, category, asked, shown) of every section of an advert: how many of the skills it requires the section shows."""
    j = latest_adverts(spark, sf).select("job_id", F.array_distinct(F.transform(trimmed("required_skills"), lambda x: F.lower(x))).alias("skills"), F.explode(T.sections(F.col("jd_text"), CATEGORIES)).alias("s")).where("size(skills) > 0")
    body = F.lower("s.body")
    shown = F.size(F.filter("skills", lambda x: F.contains(body, x) & (T.mentions(body, x) > 0)))
    return j.select("job_id", "s.place", "s.category", F.size("skills").cast("long").alias("asked"), shown.cast("long").alias("shown"))


@query(f"with {_BLOCKS} select job_id, place, category, round(shown / asked::double, 6) as coverage from blocks")
def block_coverage(spark, sf):
    """The share of an advert's required skills that each of its sections shows."""
    return blocks(spark, sf).select("job_id", "place", "category", F.round(F.col("shown") / F.col("asked"), 6).alias("coverage"))


@query(f"with {_BLOCKS} select job_id, place, category from blocks qualify row_number() over (partition by job_id order by round(shown / asked::double, 2) desc, category = 'required' desc, place) = 1")
def lead_sections(spark, sf):
    """Each advert's leading section: the best covered one (to two digits), then one of requirements, then the first."""
    order = F.struct(F.round(F.col("shown") / F.col("asked"), 2), F.col("category") == "required", -F.col("place"))
    return blocks(spark, sf).groupBy("job_id").agg(F.max_by(F.struct("place", "category"), order).alias("b")).select("job_id", "b.*")


@query(f"""with {_SHOWN}, a as (select distinct job_id, lower(trim(unnest(required_skills))) as skill from latest), k as (select distinct lower(term) as skill from skill_registry)
select case when s.skill is not null then 'found' when k.skill is not null then 'known' else 'invisible' end as outcome, count(*) as n from a left join (select distinct job_id, skill from shown) s on s.job_id = a.job_id and s.skill = a.skill left join k on k.skill = a.skill where a.skill != '' group by 1""")
def recall_split(spark, sf):
    """Required skills by what reading the text would make of them: found in it, known to the registry only, or invisible."""
    a = latest_adverts(spark, sf).select("job_id", F.explode(F.array_distinct(F.transform(trimmed("required_skills"), lambda x: F.lower(x)))).alias("skill"))
    s = shown_lines(spark, sf).select("job_id", "skill", F.lit(True).alias("s")).distinct()
    k = table(spark, sf, "skill_registry").select(F.lower("term").alias("skill"), F.lit(True).alias("k")).distinct()
    outcome = F.when(F.col("s"), "found").when(F.col("k"), "known").otherwise("invisible")
    return a.join(s, ["job_id", "skill"], "left").join(k, "skill", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select event_id as range_id, user_id, epoch_us(ts) as from_us from events where event_type = 'purchase')
select e.event_id, range_id from events e join r on r.user_id = e.user_id and epoch_us(e.ts) >= from_us and epoch_us(e.ts) < from_us + 3600000000""")
def events_in_ranges(spark, sf):
    """Events within an hour from a purchase of the same user on: a range join by pieces of time."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    r = e.where("event_type = 'purchase'").select(F.col("event_id").alias("range_id"), "user_id", F.col("at").alias("from_us"), (F.col("at") + 3600 * 10**6).alias("to_us"))
    return range_join(e.select("event_id", "user_id", "at"), r, ["user_id"], "at", "from_us", "to_us", 3600 * 10**6).select("event_id", "range_id")


_TIMES = "case when applicants_count is null then 1.0 when applicants_count <= 10 then 1.5 when applicants_count <= 100 then 1.5 + (applicants_count - 10) * (-0.5 / 90) when applicants_count <= 400 then 1.0 + (applicants_count - 100) * (-0.5 / 300) else 0.5 end"


@query(f"select job_id, bool_and(least(coalesce(len(required_skills), 0) / 10.0, 1.0) * ({_TIMES}) < 0.4) as hopeless from all_jobs where job_id is not null group by 1")
def bound_prunes(spark, sf):
    """Whether an advert can't reach a bar even at best: its greatest share times its multiplier stays below."""
    share = F.least(F.coalesce(F.when(F.col("required_skills").isNotNull(), F.size("required_skills")), F.lit(0)) / 10.0, F.lit(1.0))
    best = share * R.piecewise(F.col("applicants_count"), [(10, 1.5), (100, 1.0), (400, 0.5)], 1.0)
    return table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(F.bool_and(best < 0.4).alias("hopeless"))


@query("""
with e as (select event_id, strftime(ts, '%Y-%m-%d') as day, value, case when value >= 80 then 'keep' when value >= 40 then 'ask' when value >= 10 then 'scan' else 'drop' end as band from events),
r as (select *, row_number() over (partition by day, band order by value desc, event_id) as n from e)
select event_id, band, case when band = 'ask' and n > 50 then 'scan' else band end as route from r""")
def banded_routes(spark, sf):
    """Rows routed by bands of a score; a day's asking is kept within 50, the best first, the rest goes one band down; ranks by ranges."""
    v = F.col("value")
    band = F.when(v >= 80, "keep").when(v >= 40, "ask").when(v >= 10, "scan").otherwise("drop")
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (-v).alias("down"), band.alias("band"))
    r = O.running_total(e, ["day", "band"], ["down", "event_id"], F.lit(1), "n")
    return r.select("event_id", "band", F.when((F.col("band") == "ask") & (F.col("n") > 50), "scan").otherwise(F.col("band")).alias("route"))


@query("""
with o as (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as n from orders where o_orderstatus = 'O')
select o_orderkey, n <= 500 as done from o""")
def budgeted_backlog(spark, sf):
    """A backlog worked off in order up to a budget of 500 rows; the others stay."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    return O.running_total(o, [], ["o_orderdate", "o_orderkey"], F.lit(1), "n").select("o_orderkey", (F.col("n") <= 500).alias("done"))


@query("""
with p as (select distinct * from list_polls), h as (select ats, count(*) filter (error_text is not null) / count(*)::double as failing from p group by 1)
select ats, round(failing, 6) as failing, failing <= 0.1 as open from h""")
def source_health(spark, sf):
    """Sources by how many of their polls fail; one that fails too often is closed for the run."""
    p = table(spark, sf, "list_polls").distinct().groupBy("ats").agg((F.count("error_text") / F.count(F.lit(1))).alias("f"))
    return p.select("ats", F.round("f", 6).alias("failing"), (F.col("f") <= 0.1).alias("open"))


@query(r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\([-_*#.+!()\[\]])', '\1', 'g'), '[\x{2010}-\x{2015}\x{2212}]', '-', 'g'), '[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]', ' ', 'g')) as digest from documents where text is not null""")
def clean_texts(spark, sf):
    """Texts without Markdown's escapes, with one kind of dash and of blank; their letters are left as they are. Given as digests."""
    t = F.regexp_replace("text", r"\\([-_*#.+!()\[\]])", "$1")
    t = F.regexp_replace(F.regexp_replace(t, "[\u2010-\u2015\u2212]", "-"), "[\u00a0\u2000-\u200a\u202f\u3000]", " ")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(t).alias("digest"))


@query("""
with k as (select distinct lower(term) as known from skill_registry where label = 'approve' and regexp_matches(term, '^[A-Za-z0-9+#]+$')), n as (select distinct lower(trim(unnest(required_skills))) as term from all_jobs),
w as (select term, unnest(list_distinct(regexp_split_to_array(term, '[^a-z0-9+#]+'))) as word from n where term != '') select term, known from w join k on word = known where term != known""")
def term_suggestions(spark, sf):
    """Typed terms with the approved one-word terms that stand in them."""
    k = table(spark, sf, "skill_registry").where("label = 'approve'").where(F.col("term").rlike("^[A-Za-z0-9+#]+$")).select(F.lower("term").alias("known")).distinct()
    n = table(spark, sf, "all_jobs").select(F.explode("required_skills").alias("x")).select(F.lower(F.trim("x")).alias("term")).where("term != ''").distinct()
    w = n.select("term", F.explode(F.array_distinct(F.split("term", "[^a-z0-9+#]+", -1))).alias("known"))
    return w.join(k, "known").where("term != known").select("term", "known")


@query(f"""
with {LATEST}, k as (select distinct lower(term) as skill from skill_registry where label = 'approve' and regexp_matches(term, '^[A-Za-z0-9+#]+$')), w as (select distinct job_id, unnest(regexp_split_to_array(lower(jd_text), '[^a-z0-9+#]+')) as skill from latest),
h as (select distinct job_id, lower(trim(unnest(list_concat(coalesce(required_skills, []), coalesce(nice_to_have, []))))) as skill from latest) select job_id, skill from w join k using (skill) where not exists (select 1 from h where h.job_id = w.job_id and h.skill = w.skill)""")
def pool_skills(spark, sf):
    """Approved one-word terms that an advert's text names and its lists lack."""
    j = latest_adverts(spark, sf)
    k = table(spark, sf, "skill_registry").where("label = 'approve'").where(F.col("term").rlike("^[A-Za-z0-9+#]+$")).select(F.lower("term").alias("skill")).distinct()
    w = j.select("job_id", F.explode(F.array_distinct(F.split(F.lower("jd_text"), "[^a-z0-9+#]+", -1))).alias("skill")).join(k, "skill")
    none = F.array().cast("array<string>")
    h = j.select("job_id", F.explode(F.concat(F.coalesce("required_skills", none), F.coalesce("nice_to_have", none))).alias("x")).select("job_id", F.lower(F.trim("x")).alias("skill"))
    return w.join(h, ["job_id", "skill"], "left_anti").select("job_id", "skill")


@query("""
select poll_no, lower(trim(id)) as posting_id, cast(i - 1 as int) as ordinal, b.text as title, i = 1 as first from (select poll_no, id, unnest(lists) as b, generate_subscripts(lists, 1) as i from (select distinct poll_no, id, lists from lever_list where lists is not null and poll_no is not null and id is not null))""")
def flattened_blocks(spark, sf):
    """The blocks of nested postings as rows with their place, and whether it is the first."""
    rows = table(spark, sf, "lever_list").where("lists is not null and poll_no is not null and id is not null").select("poll_no", "id", "lists").distinct()
    return flatten(rows, ["poll_no", "id"], "lists")["lists"].select("poll_no", F.lower(F.trim("id")).alias("posting_id"), "ordinal", F.col("text").alias("title"), (F.col("ordinal") == 0).alias("first"))


@query("""
with c as (select lower(trim(unnest(required_skills))) as term, job_id from all_jobs), n as (select term, count(distinct job_id) as jobs from c where term != '' group by 1), r as (select lower(term) as term, bool_and(label != 'reject') as active from skill_registry where term is not null group by 1)
select coalesce(n.term, r.term) as term, coalesce(jobs, 0) as jobs, coalesce(active, true) as active from n full join r on n.term = r.term""")
def vocabulary_upsert(spark, sf):
    """Counts of terms laid over the known ones: new terms come in as active, known ones keep whether they are."""
    n = table(spark, sf, "all_jobs").select("job_id", F.explode("required_skills").alias("x")).select("job_id", F.lower(F.trim("x")).alias("term")).where("term != ''").groupBy("term").agg(F.count_distinct("job_id").alias("jobs"))
    r = table(spark, sf, "skill_registry").where("term is not null").groupBy(F.lower("term").alias("term")).agg(F.bool_and(F.col("label") != "reject").alias("active"))
    return n.join(r, "term", "full_outer").select("term", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("active", F.lit(True)).alias("active"))


NARROW, WIDE = "[ijlt.,:;'|!]", "[mwMW@]"  #: characters half as wide, and half as wide again


@query(f"select distinct role, length(role) - 0.5 * len(regexp_extract_all(role, '{NARROW.replace(chr(39), chr(39) * 2)}')) + 0.5 * len(regexp_extract_all(role, '{WIDE}')) <= 30 as fits from all_jobs where role is not null")
def line_widths(spark, sf):
    """Whether a title fits on a line of 30 characters' width, narrow and wide ones counted as such."""
    width = F.length("role") - 0.5 * F.regexp_count("role", F.lit(NARROW)) + 0.5 * F.regexp_count("role", F.lit(WIDE))
    return table(spark, sf, "all_jobs").where("role is not null").select("role", (width <= 30).alias("fits")).distinct()


@query("""
select job_id, bool_or(required_skills is not null and role_level is not null) as complete, max(case when required_skills is not null and role_level is not null then len(required_skills) end) as skills from all_jobs where job_id is not null group by 1""")
def rebuilt_parses(spark, sf):
    """Parses rebuilt from stored columns; null where one of them is missing."""
    parse = F.when(F.col("required_skills").isNotNull() & F.col("role_level").isNotNull(), F.struct("required_skills", "role_level"))
    j = table(spark, sf, "all_jobs").where("job_id is not null").select("job_id", parse.alias("p"))
    return j.groupBy("job_id").agg(F.bool_or(F.col("p").isNotNull()).alias("complete"), F.max(F.when(F.col("p").isNotNull(), F.size("p.required_skills"))).cast("long").alias("skills"))


@query("""
with s as (select distinct id, name, company.name as company, releaseddate, location.city as city, location.country as country from smartrecruiters_list)
select nullif(trim(id), '') as posting_id, nullif(trim(name), '') as title, nullif(trim(company), '') as company, nullif(trim(releaseddate), '') as posted, nullif(concat_ws(', ', nullif(trim(city), ''), nullif(trim(country), '')), '') as location from s where nullif(trim(id), '') is not null""")
def posting_details(spark, sf):
    """Pages of single postings with their data as JSON-LD, read back."""
    s = table(spark, sf, "smartrecruiters_list").select("id", "name", F.col("company.name").alias("company"), "releaseddate", F.col("location.city").alias("city"), F.col("location.country").alias("country")).distinct()
    address = F.struct(F.col("city").alias("addressLocality"), F.col("country").alias("addressCountry"))
    data = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("name").alias("title"), F.col("releaseddate").alias("datePosted"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.struct(address.alias("address")).alias("jobLocation")))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script></head><body>x</body></html>"))
    return read_details(s.select(F.col("id").alias("posting_id"), page.alias("body"))).where("trim(posting_id) != ''").select(F.trim("posting_id").alias("posting_id"), "title", "company", "posted", "location")
