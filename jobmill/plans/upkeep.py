"""Keys, coverage, retention and routing over the job tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobmill.functions import rules as R
from jobmill.functions.terms import norm
from jobmill.operators import relational as O
from jobmill.plans.relational import term_places
from jobmill.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_strategy(name: str, f: Callable[[DataFrame], DataFrame], replace: bool = False, into: dict | None = None) -> None:
    """Adds a way of parsing adverts to STRATEGIES (or to `into`); a name that is taken is an error unless `replace`."""
    known = STRATEGIES if into is None else into
    if name in known and not replace:
        raise ValueError(f"{name} is registered already")
    known[name] = f


def route(df: DataFrame, by: Column, default: str, strategies: dict | None = None) -> DataFrame:
    """Every row through the strategy that `by` names; unknown and null names go to `default`."""
    known = STRATEGIES if strategies is None else strategies
    named = df.withColumn("route", F.when(by.isin(list(known)), by).otherwise(default))
    parts = [f(named.where(F.col("route") == name)) for name, f in known.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
with u as (select job_url, regexp_extract(lower(job_url), '^https?://([^/?#]+)', 1) as host, regexp_extract(job_url, '^https?://[^/]+/([^/?#]+)', 1) as part from all_jobs where job_url is not null)
select case when host like '%greenhouse%' then 'greenhouse' when host like '%lever%' then 'lever' when host like '%ashby%' then 'ashby' when host like '%smartrecruiters%' then 'smartrecruiters' else 'other' end as ats, lower(part) as board_id, count(*) as n from u group by 1, 2""")
def board_from_url(spark, sf):
    """Board type and id from addresses."""
    u = table(spark, sf, "all_jobs").where("job_url is not null").select(F.regexp_extract(F.lower("job_url"), "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("job_url", "^https?://[^/]+/([^/?#]+)", 1).alias("part"))
    ats = F.lit("other")
    for a in ("smartrecruiters", "ashby", "lever", "greenhouse"):
        ats = F.when(F.contains("host", F.lit(a)), a).otherwise(ats)
    return u.groupBy(ats.alias("ats"), F.lower("part").alias("board_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with j as (select distinct job_id, site, company from all_jobs where company is not null), k as (select distinct regexp_replace(lower(company_key), '[^a-z0-9]', '', 'g') as k from ats_boards where company_key is not null)
select site, count(*) as jobs, count(*) filter (where site like 'ats:%' or regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(company), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '( (inc|llp|llc|ltd|limited|private|pvt|gmbh|ag|corp|s a|co))+$', ''), ' ', '', 'g') in (select k from k)) as covered from j group by 1""")
def coverage_or_join(spark, sf):
    """Jobs covered by their link or by their company's key."""
    j = table(spark, sf, "all_jobs").where("company is not null").select("job_id", "site", "company").distinct().withColumn("k", R.company_key(F.col("company")))
    k = table(spark, sf, "ats_boards").where("company_key is not null").select(R.phrase_key(F.regexp_replace("company_key", "[+#]", "")).alias("k"), F.lit(True).alias("known")).distinct()
    c = F.count_if(F.col("site").startswith("ats:") | F.coalesce("known", F.lit(False)))
    return j.join(k, "k", "left").groupBy("site").agg(F.count(F.lit(1)).alias("jobs"), c.alias("covered"))


@query("""
with m as (select max(polled_at) as newest from list_polls) select ats, count(*) as kept, count(distinct board_id) as boards from (select distinct * from list_polls) p, m where polled_at >= newest - interval 60 days or error_text is null group by 1""")
def prune_polls(spark, sf):
    """Failed polls are forgotten after 60 days, all others kept."""
    p = table(spark, sf, "list_polls").distinct()
    newest = p.agg(F.max("polled_at").alias("newest")).scalar()
    kept = p.withColumn("newest", newest).where("polled_at >= newest - interval 60 days or error_text is null")
    return kept.groupBy("ats").agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("board_id").alias("boards"))


@query("""
with p as (select distinct poll_no, board_id, polled_at from list_polls where complete and not not_modified and error_text is null and ats = 'greenhouse'),
l as (select distinct p.board_id, p.polled_at, cast(g.id as varchar) as posting from p join greenhouse_list g using (poll_no)), s as (select board_id, posting, max(polled_at) as seen from l group by 1, 2),
c as (select s.*, (select min(polled_at) from p where p.board_id = s.board_id and p.polled_at > s.seen) as closed from s), m as (select max(polled_at) as newest from p)
select board_id, posting, closed is not null as closed from c, m where closed is null or closed >= newest - interval 60 days""")
def prune_old(spark, sf):
    """Postings that have been closed for more than 60 days are forgotten, all others kept."""
    p = table(spark, sf, "list_polls").where("complete and not not_modified and error_text is null and ats = 'greenhouse'").select("poll_no", "board_id", "polled_at").distinct()
    seen = p.join(table(spark, sf, "greenhouse_list").select("poll_no", F.col("id").cast("string").alias("posting")).distinct(), "poll_no").groupBy("board_id", "posting").agg(F.max("polled_at").alias("seen"))
    polls = p.groupBy("board_id").agg(F.sort_array(F.collect_set("polled_at")).alias("polls"))
    closed = F.get(F.filter("polls", lambda t: t > F.col("seen")), F.lit(0))
    newest = p.agg(F.max("polled_at").alias("newest")).scalar()
    state = seen.join(polls, "board_id").select("board_id", "posting", closed.alias("at")).withColumn("newest", newest)
    return state.where("at is null or at >= newest - interval 60 days").select("board_id", "posting", F.col("at").isNotNull().alias("closed"))


@query("""
with o as (select job_id, min(lower(trim(company))) as c, min(lower(trim(role))) as r, min(epoch_us(scraped_at)) as seen from all_jobs where company is not null and role is not null and scraped_at is not null group by 1),
h as (select c, r, min(seen) as head_seen, count(*) as members from o group by 1, 2)
select o.job_id, o.seen = h.head_seen as is_head, o.seen - h.head_seen <= 2592000000000 as in_time, h.members from o join h using (c, r)""")
def late_members(spark, sf):
    """Which members of a group come within 30 days of its head and are added to it."""
    o = table(spark, sf, "all_jobs").where("company is not null and role is not null and scraped_at is not null").groupBy("job_id").agg(F.min(F.lower(F.trim("company"))).alias("c"), F.min(F.lower(F.trim("role"))).alias("r"), F.min(F.unix_micros("scraped_at")).alias("seen"))
    h = o.groupBy("c", "r").agg(F.min("seen").alias("head_seen"), F.count(F.lit(1)).alias("members"))
    return o.join(h, ["c", "r"]).select("job_id", (F.col("seen") == F.col("head_seen")).alias("is_head"), (F.col("seen") - F.col("head_seen") <= 30 * 86400 * 10**6).alias("in_time"), "members")


@query("""
select b.ats, b.board_id, not exists (select 1 from list_polls p where p.ats = b.ats and p.board_id = b.board_id and p.polled_at >= b.polled_at - interval 12 hours) as stale from (select ats, board_id, max(polled_at) as polled_at from ats_boards group by 1, 2) b""")
def stale_cache(spark, sf):
    """Boards without a poll that is fresh enough."""
    b = table(spark, sf, "ats_boards").groupBy("ats", "board_id").agg(F.max("polled_at").alias("at"))
    p = table(spark, sf, "list_polls").groupBy("ats", "board_id").agg(F.max("polled_at").alias("last"))
    return b.join(p, ["ats", "board_id"], "left").select("ats", "board_id", (~F.coalesce(F.col("last") >= F.col("at") - F.expr("interval 12 hours"), F.lit(False))).alias("stale"))


@query("""
with p as (select job_id, bool_or(parse_mode is null) as pending from all_jobs where job_id is not null group by 1), d as (select distinct job_id from all_jobs where outcome is not null)
select p.pending, d.job_id is not null as judged, count(*) as n from p left join d using (job_id) group by 1, 2""")
def requeue_pending(spark, sf):
    """Handed-off rows by whether a verdict exists: those without one are sent again."""
    j = table(spark, sf, "all_jobs").where("job_id is not null")
    return j.groupBy("job_id").agg(F.bool_or(F.col("parse_mode").isNull()).alias("pending"), F.bool_or(F.col("outcome").isNotNull()).alias("judged")).groupBy("pending", "judged").agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select term, row_number() over (order by term) - 1 as place, count(*) over () as size from (select distinct term from skill_registry where term is not null))
select term, place, cast((place + size - 7 % size) % size as bigint) as turn from t""")
def rotation_ring(spark, sf):
    """A ring of terms read from a pointer: each term's turn, ranked by ranges."""
    t = table(spark, sf, "skill_registry").where("term is not null").select("term").distinct()
    placed = O.running_total(t, [], ["term"], F.lit(1), "n").withColumn("size", t.agg(F.count(F.lit(1))).scalar()).select("term", (F.col("n") - 1).cast("long").alias("place"), "size")
    return placed.select("term", "place", ((F.col("place") + F.col("size") - F.lit(7) % F.col("size")) % F.col("size")).alias("turn"))


@query("""
with p as (select job_id, [trim(x) for x in string_split(lower(location), '/') if trim(x) != ''] as parts from all_jobs where job_id is not null and location is not null)
select job_id, bool_and(len(parts) > 0 and len([x for x in parts if contains(x, 'india') or contains(x, 'remote')]) < len(parts)) as elsewhere from p group by 1""")
def places_every_part(spark, sf):
    """Places of which not every part is wanted."""
    parts = F.filter(F.transform(F.split(F.lower("location"), "/", -1), lambda x: F.trim(x)), lambda x: x != "")
    p = table(spark, sf, "all_jobs").where("job_id is not null and location is not null").withColumn("parts", parts)
    wanted = F.forall("parts", lambda x: F.contains(x, F.lit("india")) | F.contains(x, F.lit("remote")))
    return p.groupBy("job_id").agg(F.bool_and((F.size("parts") > 0) & ~wanted).alias("elsewhere"))


@query("""
select o_orderkey, case when o_totalprice < 50000 then 'small' when o_totalprice < 150000 then 'middle' when o_totalprice < 300000 then 'large' else 'huge' end as band from orders""")
def range_bands(spark, sf):
    """A range join with a fixed list of half-open ranges, done in the row."""
    bands = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.lit(n).alias("name")) for a, b, n in ((0, 5e4, "small"), (5e4, 1.5e5, "middle"), (1.5e5, 3e5, "large"), (3e5, 1e18, "huge"))])
    hit = F.get(F.filter(bands, lambda b: (F.col("o_totalprice") >= b["low"]) & (F.col("o_totalprice") < b["high"])), F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", hit["name"].alias("band"))


@query("""
with w as (select doc_id, unnest(words) as word, unnest(generate_series(1, len(words))) as place from (select doc_id, [x for x in regexp_split_to_array(lower(text), '[^a-z0-9+#]+') if x != ''] as words from documents where text is not null)),
t as (select distinct lower(term) as term from skill_registry where regexp_matches(term, '^[A-Za-z0-9]+$'))
select doc_id, word as term, min(place) as first_place, count(*) as times from w join t on word = term group by 1, 2""")
def first_occurrence(spark, sf):
    """Where each term of ASCII letters and digits first stands in a text; first_occurrence_all has every single-word term."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.filter(F.split(F.lower("text"), "[^a-z0-9+#]+"), lambda x: x != "")).alias("p", "word"))
    t = table(spark, sf, "skill_registry").where(F.col("term").rlike("^[A-Za-z0-9]+$")).select(F.lower("term").alias("term")).distinct()
    return d.join(t, F.col("word") == F.col("term")).groupBy("doc_id", "term").agg((F.min("p") + 1).cast("long").alias("first_place"), F.count(F.lit(1)).alias("times"))


@query()
def first_occurrence_all(spark, sf):
    """Where each single-word term first stands in a text, signs at and between its words included; places count words."""
    return term_places(spark, sf).groupBy("doc_id", "term").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("times"))


@query("""
select 'job_id' as key, count(*) as repeated, cast(sum(n) as bigint) as rows from (select job_id, count(*) as n from all_jobs group by 1 having count(*) > 1)
union all select 'poll_no', count(*), cast(coalesce(sum(n), 0) as bigint) from (select poll_no, count(*) as n from list_polls group by 1 having count(*) > 1)
union all select 'board', count(*), cast(coalesce(sum(n), 0) as bigint) from (select ats, lower(board_id), count(*) as n from ats_boards group by 1, 2 having count(*) > 1)""")
def key_violations(spark, sf):
    """Keys that aren't unique."""
    def one(name, df, *key):
        r = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return r.agg(F.lit(name).alias("key"), F.count(F.lit(1)).alias("repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))

    return one("job_id", table(spark, sf, "all_jobs"), "job_id").unionByName(one("poll_no", table(spark, sf, "list_polls"), "poll_no")).unionByName(one("board", table(spark, sf, "ats_boards"), "ats", F.lower("board_id")))


@query("""
with c as (select source, lang, count(*) as n from documents group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, lang nulls first) as place, sum(n) over (partition by source) as total from c)
select source, lang, n, round(n / total::double, 6) as share from r where place <= 2""")
def top_of_group(spark, sf):
    """The two most frequent languages of each source, with their shares."""
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source")
    r = c.withColumns({"place": F.row_number().over(w.orderBy(F.desc("n"), F.col("lang").asc_nulls_first())), "total": F.sum("n").over(w)})
    return r.where("place <= 2").select("source", "lang", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""
select job_id, round(max(case when c is not null then least(1.0, c / 10.0) end) * 0.6 + max(case when applicants_count is null then 0.5 else 1.0 / (1 + applicants_count / 100.0) end) * 0.4, 6)::double as score from (select job_id, len(required_skills)::double as c, applicants_count from all_jobs where job_id is not null) group by 1""")
def blended_score(spark, sf):
    """A capped count blended with a competition factor; unknown parts neutral."""
    c = F.when(F.col("required_skills").isNotNull(), F.size("required_skills").cast("double"))
    a = F.when(F.col("applicants_count").isNull(), 0.5).otherwise(1.0 / (1 + F.col("applicants_count") / 100.0))
    g = table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(F.max(F.when(c.isNotNull(), F.least(F.lit(1.0), c / 10.0))).alias("x"), F.max(a).alias("y"))
    return g.select("job_id", F.round(F.col("x") * 0.6 + F.col("y") * 0.4, 6).alias("score"))


@query("""
select job_id, case when parse_mode in ('llm', 'dictionary') then parse_mode else 'dictionary' end as route,
cast(max(case when parse_mode = 'llm' then coalesce(len(required_skills), 0) else coalesce(len(list_distinct([lower(trim(x)) for x in required_skills if trim(x) != ''])), 0) end) as int) as skills from all_jobs where job_id is not null group by 1, 2""")
def parse_routes(spark, sf):
    """Every advert through the strategy for its parse mode; unparsed ones by the dictionary."""
    own: dict[str, Callable[[DataFrame], DataFrame]] = {}
    trimmed = F.array_distinct(F.filter(F.transform("required_skills", lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    register_strategy("llm", lambda d: d.select("job_id", "route", F.coalesce("required_skills", F.array().cast("array<string>")).alias("skills")), into=own)
    register_strategy("dictionary", lambda d: d.select("job_id", "route", F.coalesce(trimmed, F.array().cast("array<string>")).alias("skills")), into=own)
    routed = route(table(spark, sf, "all_jobs").where("job_id is not null"), F.col("parse_mode"), "dictionary", own)
    return routed.groupBy("job_id", "route").agg(F.max(F.size("skills")).alias("skills"))


_RAW = ("lever", "ashby", "smartrecruiters")


@query("""
with r as (select raw from lever_list union all select raw from ashby_list union all select raw from smartrecruiters_list),
t as (select raw from r where raw is not null and json_valid(raw))
select j.key as key, j.atom ->> '$' as text, count(*) as n from t, json_tree(t.raw) as j where j.type = 'VARCHAR' and j.key is not null and not suffix(j.fullkey, ']') group by 1, 2""")
def json_strings(spark, sf):
    """Every string under a name in the raw records of the three lists that keep them, however deep it lies."""
    raw = None
    for name in _RAW:
        part = table(spark, sf, f"{name}_list").where("raw is not null").select(F.expr("try_parse_json(raw)").alias("v"))
        raw = part if raw is None else raw.unionByName(part)
    level, out = cut(raw.where("v is not null").select(F.to_json("v").alias("v"))), []
    while True:  # a level deeper each time, until nothing nested is left; a record has as many levels as its text says
        below = level.select(F.explode(O.children(F.col("v"))).alias("x")).select("x.*")
        below = cut(below)
        out.append(below.where("kind = 'STRING' and key is not null").select("key", "text"))
        level = below.where("kind = 'NESTED'").select(F.col("text").alias("v"))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, out).groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(StringType())
def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(norm, na_action="ignore")


@query()
def normal_texts(spark, sf):
    """Texts in normal form, each distinct text once."""
    d = table(spark, sf, "documents").where("text is not null")
    once = d.groupBy(F.md5("text").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))
    return once.select("doc_id", "copies", _normal("text").alias("normal"))
