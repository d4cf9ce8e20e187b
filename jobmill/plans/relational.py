"""Joins, aggregates, windows, orders and sets over the whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmill.functions import rules as R
from jobmill.operators import relational as O
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


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds `words` of a text (letters, marks and digits of any script, + and #) and `gaps`, what stands before, between and after them."""
    return df.withColumns({"words": F.regexp_extract_all(text, F.lit(f"({R.WORD})"), 1), "gaps": F.split(text, R.WORD, -1)})


FILTER = 1 << 20  #: places of the filter that runs are thinned by; more terms thin less, and the join after it is exact


def wanted_runs(texts: DataFrame, terms: DataFrame, run: str, between: str | None = None) -> DataFrame:
    """The runs of `words` in texts that may be a term: texts' columns without words and gaps, run (with the gaps as they are,
    or `between`), before and after (the gaps around it) and place (from 1).

    terms: `words`, `size` (how many) and their `run`. Whatever is a term's run is kept; others are thinned by a filter
    of fixed size over first words and whole runs.
    """
    terms = terms.where("size > 0")
    place = lambda c: F.crc32(F.encode(c, "utf-8")) % FILTER
    sizes = sorted(r[0] for r in terms.select("size").distinct().collect())
    firsts, wholes = bytearray(FILTER), bytearray(FILTER)
    for bits, c in ((firsts, F.get("words", F.lit(0))), (wholes, F.col(run))):
        for r in terms.select(place(c)).distinct().toLocalIterator():
            bits[r[0]] = 1

    @F.pandas_udf("array<struct<run:string,before:string,after:string,place:bigint>>")
    def runs(words: pd.Series, gaps: pd.Series) -> pd.Series:
        out, memo = [], {}
        for w, g in zip(words, gaps):
            found = []
            for i, x in enumerate(w):
                if x not in memo:
                    memo[x] = firsts[zlib.crc32(x.encode()) % FILTER]
                if memo[x]:
                    for n in sizes:
                        if i + n > len(w):
                            break
                        text = between.join(w[i : i + n]) if between is not None else x + "".join(g[k] + w[k] for k in range(i + 1, i + n))
                        if wholes[zlib.crc32(text.encode()) % FILTER]:
                            found.append({"run": text, "before": g[i], "after": g[i + n], "place": i + 1})
            out.append(found)
        return pd.Series(out)

    rest = [c for c in texts.columns if c not in ("words", "gaps")]
    return texts.withColumn("r", runs.asNondeterministic()("words", "gaps")).select(*rest, F.explode("r").alias("r")).select(*rest, "r.*")


def term_places(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, term, place) of every single-word term of the registry in every text, once for each place (the word it begins at).

    A term is found where its words stand with the same signs between them and at its edges; only at an edge that is a
    word must another word not go on. Terms of signs alone are found wherever they stand, at the next word's place.
    """
    t = table(spark, sf, "skill_registry").select(F.lower(R.visible(F.trim("term"))).alias("term")).where(r"term != '' and not term rlike '(?U)\\s'").distinct()
    t = cut(with_words(t, "term").select("term", "words", F.size("words").alias("size"), F.get("gaps", F.lit(0)).alias("lead"), F.get("gaps", F.size("words")).alias("trail"), F.regexp_extract("term", f"{R.WORD}(?:.*{R.WORD})?", 0).alias("run")))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", R.visible(F.lower("text")).alias("text"))
    r = wanted_runs(with_words(d, "text").drop("text"), t, "run")
    out = [r.join(t.where("size > 0"), "run").where(F.endswith("before", "lead") & F.startswith("after", "trail")).select("doc_id", "term", "place")]
    signs = d.join(F.broadcast(t.where("size = 0").select("term")), F.contains(F.col("text"), F.col("term")))
    pieces = F.split("text", F.concat(F.lit(r"\Q"), "term", F.lit(r"\E")), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: (F.regexp_count(F.array_join(F.slice("parts", F.lit(1), i), " "), F.lit(R.WORD)) + 1).cast("long"))
    out.append(signs.withColumn("parts", pieces).select("doc_id", "term", F.explode(ends).alias("place")))
    return reduce(DataFrame.unionByName, out)


@query("""
select r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as orders
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderdate >= date '1995-01-01' group by 1, 2 order by revenue desc, r_name, c_mktsegment limit 20""")
def region_revenue(spark, sf):
    """The flagship: five tables joined, aggregated, ordered with an explicit tie rule."""
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    joined = (
        t["lineitem"].join(t["orders"].where("o_orderdate >= date '1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return joined.groupBy("r_name", "c_mktsegment").agg(revenue, F.count_distinct("o_orderkey").alias("orders")).orderBy(F.desc("revenue"), "r_name", "c_mktsegment").limit(20)


@query("""
select o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') as day, printf('%.2f', o_totalprice) as price, left(c_name, 8) as snippet
from orders join customer on o_custkey = c_custkey""")
def verdict_inner_join(spark, sf):
    """An inner join projected to display fields."""
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("%.2f", F.col("o_totalprice").cast("double")).alias("price"), F.left("c_name", F.lit(8)).alias("snippet"))


@query("""
select c_custkey, count(o_orderkey) as orders, max(s_name) as local_supplier from customer left join orders on o_custkey = c_custkey
left join (select s_nationkey, min(s_name) as s_name from supplier group by 1) on s_nationkey = c_nationkey group by 1""")
def optional_verdicts(spark, sf):
    """Two left joins."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").join(s, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("s_name").alias("local_supplier"))


@query("""
select c_custkey, c_name from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def backlog_double_anti(spark, sf):
    """Rows with neither of two verdicts."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return O.backlog(table(spark, sf, "customer"), ["c_custkey"], o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'")).select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def already_processed_semi(spark, sf):
    """Keys that are already known, by a semi join."""
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("""
with last as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events),
deltas as (select event_type, 1 as d from events union all select event_type, -1 from last where n = 1)
select event_type, cast(sum(d) as bigint) as n from deltas group by 1""")
def status_counts_overlay(spark, sf):
    """Counts with queued changes laid over them."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    last = O.pick(e, ["user_id"], F.desc("ts"), F.desc("event_id"))
    return e.select("event_type", F.lit(1).alias("d")).unionByName(last.select("event_type", F.lit(-1).alias("d"))).groupBy("event_type").agg(F.sum("d").alias("n"))


@query("""
with s as (select distinct job_id, trim(lower(unnest(required_skills))) as skill from all_jobs), n as (select count(distinct job_id) as jobs from all_jobs)
select skill, count(*) as n, round(count(*) / max(jobs)::double, 6) as share, count(*) >= 0.05 * max(jobs) as alert from s, n where skill != '' group by skill order by n desc, skill limit 15""")
def month_stats(spark, sf):
    """Exploded arrays counted, shares against a threshold, top 15 with ties by name."""
    jobs = table(spark, sf, "all_jobs")
    s = jobs.select("job_id", F.explode("required_skills").alias("raw")).select("job_id", F.trim(F.lower("raw")).alias("skill")).where("skill != ''").distinct()
    total = jobs.agg(F.count_distinct("job_id").alias("jobs")).scalar()
    c = s.groupBy("skill").agg(F.count(F.lit(1)).alias("n")).withColumn("jobs", total)
    return c.select("skill", "n", F.round(F.col("n") / F.col("jobs"), 6).alias("share"), (F.col("n") >= 0.05 * F.col("jobs")).alias("alert")).orderBy(F.desc("n"), "skill").limit(15)


@query("""
with s as (select job_id, trim(unnest(list_concat(coalesce(required_skills, []), coalesce(nice_to_have, [])))) as term from all_jobs),
k as (select distinct job_id, term, regexp_replace(lower(term), '[^a-z0-9+#]', '', 'g') as term_key from s where length(term) between 2 and 30 and array_length(string_split(term, ' ')) <= 3),
c as (select term_key, count(distinct job_id) as jobs from k where term_key != '' group by 1 having count(distinct job_id) >= 3),
m as (select term_key, term, count(*) as n, row_number() over (partition by term_key order by count(*) desc, term desc) as r from k group by 1, 2)
select c.term_key, m.term, c.jobs from c join m on c.term_key = m.term_key and m.r = 1""")
def vocab_rebuild(spark, sf):
    """Terms by how many jobs name them, with a floor; the most frequent spelling, ties by the larger one."""
    jobs = table(spark, sf, "all_jobs")
    both = F.concat(F.coalesce("required_skills", F.array().cast("array<string>")), F.coalesce("nice_to_have", F.array().cast("array<string>")))
    s = jobs.select("job_id", F.explode(both).alias("raw")).select("job_id", F.trim("raw").alias("term"))
    k = s.where(F.length("term").between(2, 30) & (F.size(F.split("term", " ", -1)) <= 3)).withColumn("term_key", R.phrase_key(F.col("term"))).where("term_key != ''").distinct()
    c = k.groupBy("term_key").agg(F.count_distinct("job_id").alias("jobs")).where("jobs >= 3")
    m = k.groupBy("term_key", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term_key").agg(F.max(F.struct("n", "term")).alias("top"))
    return c.join(m, "term_key").select("term_key", F.col("top.term").alias("term"), "jobs")


@query("""
select ats, board_id, case tier when 'hot' then 0 when 'active' then 1 when 'new' then 2 else 3 end as priority,
row_number() over (partition by ats order by case tier when 'hot' then 0 when 'active' then 1 when 'new' then 2 else 3 end, next_poll_at nulls first, polled_at nulls first, board_id) as place from ats_boards where poll""")
def due_order_nulls(spark, sf):
    """Due boards by priority, undated first."""
    p = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "active", 1).when(F.col("tier") == "new", 2).otherwise(3)
    due = table(spark, sf, "ats_boards").where("poll").select("ats", "board_id", p.alias("priority"), "next_poll_at", "polled_at")
    return O.running_total(due, ["ats"], ["priority", "next_poll_at", "polled_at", "board_id"], F.lit(1), "place").select("ats", "board_id", "priority", "place")


@query("select doc_id, n_chars, source from documents order by n_chars desc, doc_id limit 200")
def topk_limit(spark, sf):
    """Top k with an explicit tie rule, planned as a bounded heap for each partition."""
    return table(spark, sf, "documents").select("doc_id", "n_chars", "source").orderBy(F.desc("n_chars"), "doc_id").limit(200)


@query("""
with u as (select o_custkey as k, 'open' as slice, 1 as p from orders where o_orderstatus = 'O' union all select o_custkey, 'filled', 2 from orders where o_orderstatus = 'F'),
r as (select k, slice, row_number() over (partition by k order by p) as n from u) select slice, count(*) as n from r where n = 1 group by 1""")
def union_all_slices(spark, sf):
    """A union of slices, the first verdict of each key kept."""
    o = table(spark, sf, "orders")
    u = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.lit("open").alias("slice"), F.lit(1).alias("p"))
    u = u.unionByName(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit("filled").alias("slice"), F.lit(2).alias("p")))
    return u.groupBy("k").agg(F.min_by("slice", "p").alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("""
select 'both' as kind, company from (select company from all_jobs where site like 'ats:%' intersect select company from all_jobs where site = 'linkedin')
union all select 'board_only', company from (select company from all_jobs where site like 'ats:%' except select company from all_jobs where site = 'linkedin')""")
def set_ops(spark, sf):
    """Intersection and difference of two selections."""
    c = table(spark, sf, "all_jobs").select("company", "site")
    a, b = c.where("site like 'ats:%'").select("company"), c.where("site = 'linkedin'").select("company")
    return a.intersect(b).select(F.lit("both").alias("kind"), "company").unionByName(a.subtract(b).select(F.lit("board_only").alias("kind"), "company"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_per_key(spark, sf):
    """The last row of each key."""
    return O.pick(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("""
with o as (select job_id, min(epoch_us(scraped_at)) as seen, min(lower(trim(company))) as c, min(lower(trim(role))) as r from all_jobs where company is not null and role is not null and scraped_at is not null group by 1)
select job_id, coalesce(seen - lag(seen) over (partition by c, r order by seen, job_id) <= 5184000000000, false) as repeat_of_earlier from o""")
def first_copy_lookback(spark, sf):
    """Whether the same company and role was seen in the 60 days before."""
    j = table(spark, sf, "all_jobs").where("company is not null and role is not null and scraped_at is not null")
    o = j.groupBy("job_id").agg(F.min(F.unix_micros("scraped_at")).alias("at"), F.min(F.lower(F.trim("company"))).alias("c"), F.min(F.lower(F.trim("role"))).alias("r"))
    before = F.lag("at").over(Window.partitionBy("c", "r").orderBy("at", "job_id"))
    return o.select("job_id", F.coalesce(F.col("at") - before <= 60 * 86400 * 10**6, F.lit(False)).alias("repeat_of_earlier"))


@query("""
with f as (select user_id, event_type, min(event_id) as first_id from events group by 1, 2)
select user_id, event_type, first_id, row_number() over (partition by user_id order by first_id) as seen_so_far from f""")
def running_new_keywords(spark, sf):
    """What each row adds to everything before it: the first occurrence of a type by user, with a running count."""
    f = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return f.withColumn("seen_so_far", F.row_number().over(Window.partitionBy("user_id").orderBy("first_id")))


@query("""
select doc_id, lang, turn from (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as turn from documents)
order by turn, lang nulls first limit 60""")
def stratified_round_robin(spark, sf):
    """A sample taken in turn from the languages, in an order given by a digest."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return O.round_robin(d, "lang", F.struct(F.md5(F.col("doc_id").cast("string")), "doc_id"), 60).select("doc_id", "lang", "turn")


@query("""
with r as (select o_orderpriority as p, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as a, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as b from orders)
select p, round(corr(a::double, b::double), 4) as rho from r group by 1""")
def ordinal_spearman(spark, sf):
    """Rank correlation on ordinal ranks."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p"), "o_totalprice", "o_orderdate", "o_orderkey")
    r = O.running_total(o, ["p"], ["o_totalprice", "o_orderkey"], F.lit(1), "a")
    r = O.running_total(r.select("p", "o_orderdate", "o_orderkey", "a"), ["p"], ["o_orderdate", "o_orderkey"], F.lit(1), "b")
    return r.groupBy("p").agg(F.round(F.corr("a", "b"), 4).alias("rho"))


@query("""
with s as (select l_returnflag as flag, l_quantity::double as v, row_number() over (partition by l_returnflag order by l_quantity) as r, count(*) over (partition by l_returnflag) as n from lineitem where l_quantity is not null)
select flag, p as percent, max(v) as value from s, (select unnest([5, 25, 50, 75, 95, 99]) as p) where r = greatest(1, ceil(p * n / 100.0)) group by 1, 2""")
def nearest_rank_percentiles(spark, sf):
    """Exact nearest-rank percentiles by group, from counts of distinct values."""
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("v"))
    return O.nearest_rank(d, "v", [5, 25, 50, 75, 95, 99], ["flag"])


@query("""
select case when n_chars < 200 then '0-199' when n_chars < 500 then '200-499' when n_chars < 1000 then '500-999' when n_chars < 5000 then '1000-4999' else '5000+' end as bucket, count(*) as docs, round(median(n_chars), 2) as median_chars
from documents where n_chars is not null group by 1""")
def bucketed_medians(spark, sf):
    """Medians by bucket."""
    n = F.col("n_chars")
    b = F.when(n < 200, "0-199").when(n < 500, "200-499").when(n < 1000, "500-999").when(n < 5000, "1000-4999").otherwise("5000+")
    return table(spark, sf, "documents").where("n_chars is not null").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.median("n_chars"), 2).alias("median_chars"))


@query("""
with g as (select a.w, b.cut from (select unnest([0.2, 0.5, 0.8]) as w) a, (select unnest([0.3, 0.6]) as cut) b)
select g.w::double as weight, g.cut::double as threshold, count(*) as n, cast(count(*) filter (where g.w::double * (l_discount::double * 10) + (1 - g.w::double) * (l_tax::double * 10) >= g.cut::double) as bigint) as passed
from lineitem, g group by 1, 2""")
def param_grid(spark, sf):
    """One aggregate for each of a fixed set of parameter combinations, in one pass without multiplying the rows."""
    x, y = F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10
    grid = [(w, c) for w in (0.2, 0.5, 0.8) for c in (0.3, 0.6)]
    sums = [F.count_if(F.lit(w) * x + (1 - F.lit(w)) * y >= c).alias(f"g{i}") for i, (w, c) in enumerate(grid)]
    one = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("threshold"), F.col("n"), F.col(f"g{i}").alias("passed")) for i, (w, c) in enumerate(grid)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("""
select job_id, round(max(case when applicants_count is null then 1.0 when applicants_count <= 10 then 1.5 when applicants_count <= 100 then 1.5 + (applicants_count - 10) * (-0.5 / 90) when applicants_count <= 400 then 1.0 + (applicants_count - 100) * (-0.5 / 300) else 0.5 end)::double, 6) as multiplier
from all_jobs where job_id is not null group by 1""")
def piecewise_multiplier(spark, sf):
    """Straight lines between anchors; a missing count is neutral."""
    m = R.piecewise(F.col("applicants_count"), [(10, 1.5), (100, 1.0), (400, 0.5)], 1.0)
    return table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(F.round(F.max(m), 6).alias("multiplier"))


@query("""
with h as (select job_id, (epoch_us(scraped_at) - epoch_us(posted_at)) / 3600000000.0 as hours from all_jobs)
select band::double as band, count(*) as n from (select case when hours is null then 0.5 when hours <= 24 then 1.0 when hours <= 72 then 0.8 when hours <= 168 then 0.6 when hours <= 720 then 0.3 else 0.1 end as band from h) group by 1""")
def recency_bands(spark, sf):
    """Scores by age band, undated rows neutral."""
    hours = (F.unix_micros("scraped_at") - F.unix_micros("posted_at")) / 3600000000.0
    return table(spark, sf, "all_jobs").groupBy(R.bands(hours, [(24, 1.0), (72, 0.8), (168, 0.6), (720, 0.3)], 0.1, 0.5).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select vec_id, round(0.7 * greatest(0.0, least(1.0, (embedding[1]::double + 0.5) / 1.0)) + 0.3 * least(label, 4) / 4.0, 5)::double as blended from embeddings""")
def clamp_and_blend(spark, sf):
    """A similarity scaled to 0..1 and blended with a capped count."""
    s = R.scaled(F.col("embedding")[0].cast("double"), -0.5, 0.5)
    return table(spark, sf, "embeddings").select("vec_id", F.round(0.7 * s + 0.3 * F.least("label", F.lit(4)) / 4.0, 5).alias("blended"))


@query("""
with q as (select embedding as q from embeddings where vec_id = (select min(vec_id) from embeddings)), s as (select vec_id, label, round(list_dot_product(embedding::double[], q::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q::double[], q::double[]))), 4) as cos from embeddings, q)
select vec_id, label, cos from s order by cos desc, vec_id limit 20""")
def cosine_topk(spark, sf):
    """The nearest vectors to one query vector; cosine_topk_all has all queries."""
    e = table(spark, sf, "embeddings")
    q = e.orderBy("vec_id").limit(1).select("embedding").scalar()
    return e.withColumn("q", q).select("vec_id", "label", F.round(R.cosine(F.col("embedding"), F.col("q")), 4).alias("cos")).orderBy(F.desc("cos"), "vec_id").limit(20)


@query("""
with s as (select q.vec_id as query_id, e.vec_id, e.label, round(list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 4) as cos from embeddings e, embeddings q where q.vec_id % 50 = 0)
select query_id, vec_id, label, cos from s qualify row_number() over (partition by query_id order by cos desc, vec_id) <= 20""")
def cosine_topk_all(spark, sf):
    """The 20 nearest vectors to every vector whose id is divisible by 50, blocks of queries against blocks of all rows."""
    e = table(spark, sf, "embeddings").where("vec_id is not null")

    def blocks(df: DataFrame, side: str) -> DataFrame:
        n = df.count() // 1000 + 1
        rows = F.collect_list(F.struct("vec_id", "label", F.coalesce("embedding", F.array().cast("array<float>")).alias("v")))
        return df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("b")).agg(rows.alias(side)).drop("b")

    def unit(rows) -> np.ndarray:
        m = np.zeros((len(rows), max((len(r["v"]) for r in rows), default=0)))
        for x, r in zip(m, rows):
            x[: len(r["v"])] = r["v"]
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def nearest(frames):
        for frame in frames:
            for qs, es in zip(frame["q"], frame["e"]):
                a, b = unit(qs), unit(es)
                wide = min(a.shape[1], b.shape[1])
                cos = np.round(a[:, :wide] @ b[:, :wide].T, 4) + 0.0
                ids = np.array([r["vec_id"] for r in es])
                for q, row in zip(qs, cos):
                    top = np.lexsort((ids, -row))[:20]
                    yield pd.DataFrame({"query_id": q["vec_id"], "vec_id": ids[top], "label": pd.array([es[k]["label"] for k in top], dtype="Int32"), "cos": row[top]})

    near = blocks(e.where("vec_id % 50 = 0"), "q").crossJoin(blocks(e, "e")).mapInPandas(nearest, "query_id long, vec_id long, label int, cos double")
    return near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "vec_id"))).where("n <= 20").drop("n")


@query("select label, cast(i - 1 as int) as dim, round(avg(embedding[i]::double), 4) + 0.0::double as mean, count(*) as n from embeddings, (select unnest(generate_series(1, 64)) as i) where i <= len(embedding) group by 1, 2")
def mean_vector_by_label(spark, sf):
    """Mean vectors by label, one row for each dimension."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg((F.round(F.avg(F.col("x").cast("double")), 4) + F.lit(0.0)).alias("mean"), F.count(F.lit(1)).alias("n"))


_REASON = """case when lower(location) like '%united states%' or lower(location) like '%singapore%' then 'region' when years_required > 8 then 'years'
 when lower(trim(role_level)) in ('principal', 'staff') then 'level' when regexp_matches(lower(role), '(^|[^a-z])(manager|officer)($|[^a-z])') then 'title' when jd_text is null or trim(jd_text) = '' then 'no_text' end"""


@query(f"select reason, count(*) as n from (select {_REASON} as reason from all_jobs) group by 1")
def reason_first_match(spark, sf):
    """Rows by the first of several ordered rejections; null passes every one."""
    reason = R.first_reason(
        ("region", R.contains_any(F.col("location"), ["united states", "singapore"])),
        ("years", F.col("years_required") > 8),
        ("level", F.lower(F.trim("role_level")).isin("principal", "staff")),
        ("title", F.lower("role").rlike("(^|[^a-z])(manager|officer)($|[^a-z])")),
        ("no_text", F.col("jd_text").isNull() | (F.trim("jd_text") == "")),
    )
    return table(spark, sf, "all_jobs").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select job_id, bool_or(coalesce(years_required > 5, false)) as too_senior, bool_or(coalesce(job_type != 'fulltime', false)) as other_type,
bool_or(coalesce(case when lower(experience_range) like '%fresher%' then 0 else try_cast(regexp_extract(experience_range, '([0-9]+)', 1) as int) end > 5, false)) as range_too_high from all_jobs where job_id is not null group by 1""")
def null_passes_filters(spark, sf):
    """Predicates under which an unknown value is never a rejection."""
    j = table(spark, sf, "all_jobs").where("job_id is not null")
    flags = {"too_senior": F.col("years_required") > 5, "other_type": F.col("job_type") != "fulltime", "range_too_high": R.experience_floor(F.col("experience_range")) > 5}
    return j.groupBy("job_id").agg(*[F.bool_or(R.rejects(p)).alias(n) for n, p in flags.items()])


@query("""
select case when regexp_matches(lower(role), 'chief|head of|vp ') then 'exec' when regexp_matches(lower(role), 'manager|mgr') then 'manager' when regexp_matches(lower(role), 'engineer|engr|developer|architect|data|security|robotic') then 'tech'
when regexp_matches(lower(role), 'sales|finance|market|recruit|payroll|office') then 'nontech' else 'unclear' end as family, count(*) as n from all_jobs group by 1""")
def title_family(spark, sf):
    """Titles by a ladder of patterns in a fixed order."""
    r = F.lower("role")
    f = F.when(r.rlike("chief|head of|vp "), "exec").when(r.rlike("manager|mgr"), "manager").when(r.rlike("engineer|engr|developer|architect|data|security|robotic"), "tech").when(r.rlike("sales|finance|market|recruit|payroll|office"), "nontech")
    return table(spark, sf, "all_jobs").groupBy(F.coalesce(f, F.lit("unclear")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with w as (select distinct doc_id, unnest([x for x in regexp_split_to_array(lower(text), '[^a-z0-9+#]+') if x != '']) as word from documents where text is not null),
t as (select distinct lower(term) as term from skill_registry where regexp_matches(term, '^[A-Za-z0-9]+$'))
select term, count(*) as docs from w join t on word = term group by 1""")
def boundary_term_hits(spark, sf):
    """Terms of ASCII letters and digits standing whole in texts: texts exploded to words, one equi join with the terms; boundary_term_hits_all has every single-word term."""
    d = table(spark, sf, "documents").where("text is not null")
    w = d.select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9+#]+"), lambda x: x != ""))).alias("word"))
    t = table(spark, sf, "skill_registry").where(F.col("term").rlike("^[A-Za-z0-9]+$")).select(F.lower("term").alias("term")).distinct()
    return w.join(t, F.col("word") == F.col("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


@query()
def boundary_term_hits_all(spark, sf):
    """Every single-word term standing whole in texts, signs at and between its words included (C++, .NET, Node.js)."""
    return term_places(spark, sf).groupBy("term").agg(F.count_distinct("doc_id").alias("docs"))


@query("""
with w as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[^a-z0-9+#]+') if x != ''] as words from documents where text is not null),
t as (select distinct term, regexp_replace(lower(term), '[^a-z0-9+#]', '', 'g') as k, len([x for x in regexp_split_to_array(lower(term), '[^a-z0-9+#]+') if x != '']) as n from skill_registry where len([x for x in regexp_split_to_array(lower(term), '[^a-z0-9+#]+') if x != '']) > 1),
s as (select distinct n from t), g as (select distinct doc_id, array_to_string(words[i : i + n - 1], '') as k from (select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from w, s where len(words) >= n))
select term, count(*) as docs from g join t using (k) group by 1""")
def ngram_key_containment(spark, sf):
    """Terms of several words found in texts by an equi join on the keys of word runs, of every length that a term has."""
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9+#]+", -1), lambda x: x != "")
    t = table(spark, sf, "skill_registry").select("term", split("term").alias("words")).where("size(words) > 1").distinct()
    t = cut(t.select("term", "words", F.size("words").alias("size"), F.array_join("words", "").alias("run")))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", split("text").alias("words"))
    runs = wanted_runs(d.withColumn("gaps", F.array_repeat(F.lit(""), F.size("words") + 1)), t, "run", "")
    return runs.select("doc_id", "run").distinct().join(t.select("term", "run"), "run").groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


_OWN_WORDS = "[x for x in regexp_split_to_array(lower(coalesce(location, '')), '[^a-z0-9]+') if x != '']"


@query(f"""
with o as (select *, regexp_replace(lower(trim(company)), '[^a-z0-9]+', ' ', 'g') as c, trim(regexp_replace(lower(coalesce(role, '')), '[^a-z0-9]+', ' ', 'g')) as title, epoch_us(scraped_at) as seen from all_jobs where job_id is not null and jd_text is not null and company is not null
 qualify row_number() over (partition by job_id order by scraped_at desc nulls last, jd_text desc, coalesce(role, '') desc, company desc, coalesce(location, '') desc) = 1),
w as (select job_id, c, title, seen, [x for x in regexp_split_to_array(lower(jd_text), '[^a-z0-9]+') if x != '' and not list_contains({_OWN_WORDS}, x)] as ws from o),
g as (select job_id, c, title, seen, array_to_string(list_sort(list_distinct(case when len(ws) >= 3 then [array_to_string(ws[i : i + 2], ' ') for i in generate_series(1, len(ws) - 2)] else [array_to_string(ws, ' ')] end)), chr(31)) as fp from w where len(ws) > 0)
select job_id, first_value(job_id) over (partition by c, title, md5(fp) order by seen, job_id) as head, count(*) over (partition by c, title, md5(fp)) as members from g""")
def sibling_clusters(spark, sf):
    """Adverts of a company and title with the same three-word runs once their own place's words are left out, as one row for each
    with its class: the first member and the size. The same text for another city is a sibling, an empty one never is."""
    j = table(spark, sf, "all_jobs").where("job_id is not null and jd_text is not null and company is not null")
    order = F.struct(F.coalesce(F.unix_micros("scraped_at"), F.lit(-(2**62))), "jd_text", F.coalesce("role", F.lit("")), "company", F.coalesce("location", F.lit("")))
    o = j.groupBy("job_id").agg(F.max_by(F.struct("company", "role", "location", "jd_text", F.unix_micros("scraped_at").alias("at")), order).alias("r")).select("job_id", "r.*")
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", -1), lambda x: x != "")
    own = words("location")
    s = o.select("job_id", "at", F.regexp_replace(F.lower(F.trim("company")), "[^a-z0-9]+", " ").alias("c"), F.trim(F.regexp_replace(F.lower(F.coalesce("role", F.lit(""))), "[^a-z0-9]+", " ")).alias("title"), F.array_except(own, F.array(F.lit(""))).alias("own"), words("jd_text").alias("ws"))
    s = s.withColumn("ws", F.filter("ws", lambda x: ~F.array_contains("own", x))).where("size(ws) > 0")
    s = s.select("job_id", "c", "title", "at", F.md5(F.array_join(F.array_sort(R.ngrams(F.col("ws"), 3)), "\x1f")).alias("fp"))
    heads = s.groupBy("c", "title", "fp").agg(F.min(F.struct(F.coalesce("at", F.lit(2**62)), "job_id")).alias("first"), F.count(F.lit(1)).alias("members"))
    return s.join(heads, ["c", "title", "fp"]).select("job_id", F.col("first.job_id").alias("head"), "members")


@query("""
with d as (select lang as c, md5(text) as id, min(text) as t, count(*) as jobs from documents where text is not null and lang is not null group by 1, 2),
w as (select c, id, jobs, [x for x in regexp_split_to_array(lower(t), '[^a-z0-9]+') if x != ''] as ws from d),
g as (select c, id, jobs, list_distinct(case when len(ws) >= 5 then [array_to_string(ws[i : i + 4], ' ') for i in generate_series(1, len(ws) - 4)] else [array_to_string(ws, ' ')] end) as s from w where len(ws) > 0)
select a.c as lang, a.id as id_a, b.id as id_b, a.jobs as copies_a, b.jobs as copies_b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double, 6) as jaccard
from g a join g b on a.c = b.c and a.id < b.id where len(list_intersect(a.s, b.s)) >= 0.8 * len(list_distinct(list_concat(a.s, b.s)))""")
def shingle_jaccard(spark, sf):
    """Pairs of different documents of one language whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Copies are one text with their number. Prefix filter: shingles in order of their rarity, the first fifth (and one) of each
    text; texts that share none of these can't be so similar. The prefixes are joined, candidates verified exactly.
    """
    d = table(spark, sf, "documents").where("text is not null and lang is not null").groupBy("lang", F.md5("text").alias("id")).agg(F.min("text").alias("t"), F.count(F.lit(1)).alias("copies"))
    ws = d.withColumn("ws", F.filter(F.split(F.lower("t"), "[^a-z0-9]+", -1), lambda x: x != "")).where("size(ws) > 0")
    g = cut(ws.select("lang", "id", "copies", F.array_sort(F.transform(R.ngrams(F.col("ws"), 5), lambda x: F.xxhash64(x))).alias("s")))
    return O.jaccard_pairs(g, ["lang"], "id", "s", 0.8).select("lang", "id_a", "id_b", "copies_a", "copies_b", F.round("jaccard", 6).alias("jaccard"))


@query("""
select job_id, max(y) as years from (select job_id, cast(regexp_extract(line, '([0-9]{1,2})\\+? ?(?:years|yrs)', 1) as int) as y from (select job_id, unnest(string_split(lower(jd_text), chr(10))) as line from all_jobs where jd_text is not null)
 where regexp_matches(line, '[0-9]{1,2}\\+? ?(?:years|yrs)')) group by 1""")
def years_extract(spark, sf):
    """The years an advert asks for: the first number of a line, the greatest line."""
    lines = table(spark, sf, "all_jobs").where("jd_text is not null").select("job_id", F.explode(F.split(F.lower("jd_text"), "\n")).alias("line"))
    y = F.regexp_extract("line", r"([0-9]{1,2})\+? ?(?:years|yrs)", 1)
    return lines.where(F.col("line").rlike(r"[0-9]{1,2}\+? ?(?:years|yrs)")).groupBy("job_id").agg(F.max(y.cast("int")).alias("years"))


@query("""
with l as (select doc_id, line_no, line, case when regexp_matches(line, '^#+ ') then regexp_replace(line, '^#+ ', '') end as heading from
 (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line, unnest(generate_series(1, len(string_split(replace(text, chr(13), ''), chr(10))))) as line_no from documents where text is not null)),
c as (select doc_id, line, heading, last_value(heading ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from l)
select section, count(*) as lines, count(distinct doc_id) as docs from c where heading is null and trim(line) != '' group by 1""")
def section_split(spark, sf):
    """Lines under the last heading above them."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    h = d.withColumn("heading", F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ ", "")))
    c = O.carry_forward(h, "heading", ["doc_id"], "line_no", "section")
    return c.where("heading is null and trim(line) != ''").groupBy("section").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("docs"))


@query("""
select host, first_path, min(job_url) as example, count(*) as n from (select job_url, regexp_extract(job_url, '^https?://([^/?#]+)', 1) as host, regexp_extract(job_url, '^https?://[^/]+/([^/?#]*)', 1) as first_path from all_jobs where job_url is not null) group by 1, 2""")
def host_groups_any_value(spark, sf):
    """URLs by host and first path segment, with one representative."""
    u = table(spark, sf, "all_jobs").where("job_url is not null").select("job_url", F.regexp_extract("job_url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("job_url", "^https?://[^/]+/([^/?#]*)", 1).alias("first_path"))
    return u.groupBy("host", "first_path").agg(F.min("job_url").alias("example"), F.count(F.lit(1)).alias("n"))


@query("""
select p.poll_no, p.ats, case when p.error_text is not null then 'failed' when p.not_modified then 'unchanged' when not p.complete then 'partial' when p.n_listed = 0 then 'empty' else 'full' end as kind,
case when p.error_text in ('http_404') then false when p.error_text is null then true end as hit from (select distinct * from list_polls) p""")
def poll_probes(spark, sf):
    """Polls classified, with a three-valued hit: errors that may pass leave it null."""
    p = table(spark, sf, "list_polls").distinct()
    kind = F.when(F.col("error_text").isNotNull(), "failed").when(F.col("not_modified"), "unchanged").when(~F.col("complete"), "partial").when(F.col("n_listed") == 0, "empty").otherwise("full")
    return p.select("poll_no", "ats", kind.alias("kind"), F.when(F.col("error_text") == "http_404", False).when(F.col("error_text").isNull(), True).alias("hit"))


@query("""
with p as (select distinct poll_no, ats, board_id, polled_at from list_polls where complete and not not_modified and error_text is null),
l as (select distinct poll_no, cast(id as varchar) as posting from greenhouse_list), x as (select p.board_id, p.polled_at, l.posting from p join l using (poll_no) where p.ats = 'greenhouse'),
last as (select board_id, max(polled_at) as latest from p where ats = 'greenhouse' group by 1)
select x.board_id, posting, count(*) as times_seen, max(x.polled_at) < max(last.latest) as closed from x join last using (board_id) group by 1, 2""")
def ledger_states(spark, sf):
    """Each posting's state: how often it was seen, and whether a later complete list lacks it."""
    p = table(spark, sf, "list_polls").where("complete and not not_modified and error_text is null and ats = 'greenhouse'").select("poll_no", "board_id", "polled_at").distinct()
    l = table(spark, sf, "greenhouse_list").select("poll_no", F.col("id").cast("string").alias("posting")).distinct()  # noqa: E741
    last = p.groupBy("board_id").agg(F.max("polled_at").alias("at"))
    x = p.join(l, "poll_no").groupBy("board_id", "posting").agg(F.count(F.lit(1)).alias("times_seen"), F.max("polled_at").alias("seen"))
    return x.join(last, "board_id").select("board_id", "posting", "times_seen", (F.col("seen") < F.col("at")).alias("closed"))


@query("""
select board_id, ats, label, epoch_us(polled_at) + case label when 'hot' then 1 when 'active' then 3 else 12 end * 3600000000 as next_us from
(select *, case when coalesce(fits_7d, 0) > 0 then 'hot' when coalesce(target_posted_7d, 0) > 0 then 'active' else 'quiet' end as label from ats_boards) """)
def tier_schedule(spark, sf):
    """Boards labelled by their week's activity, with the next due time."""
    label = F.when(F.coalesce("fits_7d", F.lit(0)) > 0, "hot").when(F.coalesce("target_posted_7d", F.lit(0)) > 0, "active").otherwise("quiet")
    hours = F.when(F.col("label") == "hot", 1).when(F.col("label") == "active", 3).otherwise(12)
    return table(spark, sf, "ats_boards").withColumn("label", label).select("board_id", "ats", "label", (F.unix_micros("polled_at") + hours.cast("long") * 3600000000).alias("next_us"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def daily_budget_window(spark, sf):
    """Counts by tumbling day."""
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
with g as (select user_id, epoch_us(ts) as t_us, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 1800000000 then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by t_us, event_id rows unbounded preceding) as session from g)
select user_id, cast(session as bigint) as session, count(*) as events, cast(max(t_us) - min(t_us) as bigint) as length_us from s group by 1, 2""")
def sessionize(spark, sf):
    """Sessions by gaps of half an hour."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", at.alias("at"))
    s = e.withColumn("fresh", F.when(F.col("at") - F.lag("at").over(w) <= 1800000000, 0).otherwise(1)).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("at") - F.min("at")).alias("length_us"))


@query("""
with s as (select user_id, max(struct_pack(t_us := epoch_us(ts), id := event_id, kind := event_type)) as m from events where event_type in ('click', 'purchase', 'view') group by 1) select user_id, m.kind as status from s""")
def lww_status(spark, sf):
    """The last write of each key wins, by event time."""
    e = table(spark, sf, "events").where("event_type in ('click', 'purchase', 'view')")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


_REFRESHED = ("applicants_count", "salary_min_lpa", "role_level")


@query("""
with w as (select *, min(scraped_at) over (partition by job_id) as first_at, max(scraped_at) over (partition by job_id) as last_at from all_jobs where job_id is not null and scraped_at is not null)
select job_id, coalesce(max(applicants_count) filter (where scraped_at = last_at), max(applicants_count) filter (where scraped_at = first_at)) as applicants_count,
coalesce(max(salary_min_lpa) filter (where scraped_at = last_at), max(salary_min_lpa) filter (where scraped_at = first_at)) as salary_min_lpa,
coalesce(max(role_level) filter (where scraped_at = last_at), max(role_level) filter (where scraped_at = first_at)) as role_level from w group by 1""")
def upsert_coalesce(spark, sf):
    """The first scrape of every job refreshed by its last, never by a blank."""
    j = table(spark, sf, "all_jobs").where("job_id is not null and scraped_at is not null")
    us = F.unix_micros("scraped_at")
    value = lambda c: F.coalesce(F.max_by(c, F.struct(us, c)), F.max_by(c, F.struct(-us, c)))  # noqa: E731  # of equal times the greatest, nulls last
    return j.groupBy("job_id").agg(*[value(c).alias(c) for c in _REFRESHED])


@query("""
with o as (select ats, lower(board_id) as board, max(n_listed) as n from list_polls group by 1, 2), w as (select ats, lower(board_id) as board, max(target_posted_7d) as n from ats_boards group by 1, 2)
select ats, board, case when not exists (select 1 from o where o.ats = u.ats and o.board = u.board) then 'insert' when not exists (select 1 from w where w.ats = u.ats and w.board = u.board) then 'deactivate'
when (select n from o where o.ats = u.ats and o.board = u.board) is not distinct from (select n from w where w.ats = u.ats and w.board = u.board) then 'unchanged' else 'update' end as action from (select ats, board from o union select ats, board from w) u""")
def snapshot_diff_apply(spark, sf):
    """The action for each board that brings what the polls know to what the registry wants."""
    o = table(spark, sf, "list_polls").groupBy("ats", F.lower("board_id").alias("board")).agg(F.max("n_listed").alias("n"))
    w = table(spark, sf, "ats_boards").groupBy("ats", F.lower("board_id").alias("board")).agg(F.max("target_posted_7d").alias("n"))
    return O.diff(o, w, ["ats", "board"], ["n"])


@query()
def fuzzy_title_join(spark, sf):
    """Portal titles with the most similar title of the same company's own board (ratio of matching blocks)."""
    j = table(spark, sf, "all_jobs").select(R.company_key(F.col("company")).alias("company_key"), F.lower(F.trim("role")).alias("title"), "site")
    return O.similar_titles(j.where("site not like 'ats:%'"), j.where("site like 'ats:%'"), "company_key", "title")


@query("""
select R.company_key as company_key, count(*) as rows, count(distinct company) as spellings from (select company, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(company), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '( (inc|llp|llc|ltd|limited|private|pvt|gmbh|ag|corp|s a|co))+$', ''), ' ', '', 'g') as company_key from all_jobs where company is not null) R group by 1""")
def company_keys(spark, sf):
    """Companies under one key, with how many spellings each has."""
    k = table(spark, sf, "all_jobs").where("company is not null").select("company", R.company_key(F.col("company")).alias("company_key"))
    return k.groupBy("company_key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("company").alias("spellings"))


@query("""
select b.ats, k as place, cast(sum(v) as bigint) as n from (select ats, unnest(map_keys(locations)) as k, unnest(map_values(locations)) as v from ats_boards where locations is not null) b group by 1, 2""")
def map_counts(spark, sf):
    """Map columns exploded and summed."""
    m = table(spark, sf, "ats_boards").where("locations is not null").select("ats", F.explode("locations").alias("place", "v"))
    return m.groupBy("ats", "place").agg(F.sum("v").alias("n"))


@query("""
select ats, count(*) as boards, count(*) filter (where poll) as polled, count(*) filter (where poll_error is not null) as failing, count(*) filter (where tier = 'hot') as hot, cast(sum(coalesce(fits_7d, 0)) as bigint) as fits, cast(max(target_posted_7d) as int) as most from ats_boards group by 1""")
def board_report(spark, sf):
    """Several conditional counts in one pass."""
    return table(spark, sf, "ats_boards").groupBy("ats").agg(
        F.count(F.lit(1)).alias("boards"), F.count_if("poll").alias("polled"), F.count("poll_error").alias("failing"), F.count_if(F.col("tier") == "hot").alias("hot"), F.sum(F.coalesce("fits_7d", F.lit(0))).alias("fits"), F.max("target_posted_7d").alias("most")
    )


@query("""
with b as (select user_id, event_type, count(*) as n, max(value) as best from events group by 1, 2),
k as (select user_id from b group by 1 having count(*) = (select count(distinct event_type) from b))
select event_type as variant, count(*) as ids, round(avg(n), 4) as mean_n, max(n) as most, round(avg(best), 4) as mean_best from b where user_id in (select user_id from k) group by 1""")
def variant_compare(spark, sf):
    """Variants (event types) side by side, over the ids (users) that every variant has."""
    b = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
    variants = b.agg(F.count_distinct("event_type").alias("n")).scalar()
    rows = b.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "n", "best")).alias("v")).where(F.size("v") == variants).select(F.explode("v").alias("v")).select("v.*")
    return rows.groupBy(F.col("event_type").alias("variant")).agg(F.count(F.lit(1)).alias("ids"), F.round(F.avg("n"), 4).alias("mean_n"), F.max("n").alias("most"), F.round(F.avg("best"), 4).alias("mean_best"))


_LEVEL = "case when regexp_matches(lower(role), '(^|[^a-z])(senior|sr|snr)($|[^a-z])') then 'senior' when regexp_matches(lower(role), '(^|[^a-z])(junior|jr|jnr)($|[^a-z])') then 'junior' when regexp_matches(lower(role), '(^|[^a-z])lead($|[^a-z])') then 'lead' when regexp_matches(lower(role), '(^|[^a-z])staff($|[^a-z])') then 'staff' when regexp_matches(lower(role), '(^|[^a-z])princ') then 'principal' else 'mid' end"


def _level():
    r = F.lower("role")
    edge = lambda w: r.rlike(f"(^|[^a-z]){w}($|[^a-z])")
    return F.when(edge("(senior|sr|snr)"), "senior").when(edge("(junior|jr|jnr)"), "junior").when(edge("lead"), "lead").when(edge("staff"), "staff").when(r.rlike("(^|[^a-z])princ"), "principal").otherwise("mid")


@query(f"select role_level as gold, {_LEVEL} as predicted, count(*) as n from all_jobs where role_level is not null group by 1, 2")
def gold_confusion(spark, sf):
    """Predicted against given labels."""
    return table(spark, sf, "all_jobs").where("role_level is not null").groupBy(F.col("role_level").alias("gold"), _level().alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with r as (select job_id, max({_LEVEL}) as after, max(role_level) as before from all_jobs group by 1) select before, after, count(*) as flips from r where before is distinct from after group by 1, 2""")
def replay_flips(spark, sf):
    """Verdicts that change between two replays."""
    r = table(spark, sf, "all_jobs").groupBy("job_id").agg(F.max(_level()).alias("after"), F.max("role_level").alias("before"))
    return r.where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count(F.lit(1)).alias("flips"))


@query("""
with k as (select distinct job_id, lower(trim(unnest(required_skills))) as token from all_jobs), t as (select distinct lower(term) as token from skill_registry where label = 'approve'),
c as (select job_id, count(*) as asked, count(*) filter (where token in (select token from t)) as covered from k where token != '' group by 1)
select job_id, asked, covered, round(covered / asked::double, 6) as coverage from c""")
def coverage_share(spark, sf):
    """The share of what a job asks for that a list covers."""
    k = table(spark, sf, "all_jobs").select("job_id", F.explode("required_skills").alias("raw")).select("job_id", F.lower(F.trim("raw")).alias("token")).where("token != ''").distinct()
    t = table(spark, sf, "skill_registry").where("label = 'approve'").select(F.lower("term").alias("token"), F.lit(1).alias("one")).distinct()
    c = k.join(t, "token", "left").groupBy("job_id").agg(F.count(F.lit(1)).alias("asked"), F.count("one").alias("covered"))
    return c.withColumn("coverage", F.round(F.col("covered") / F.col("asked"), 6))


@query("""
with a as (select distinct lower(trim(unnest(required_skills))) as token from all_jobs), s as (select distinct unnest([x for x in regexp_split_to_array(lower(text), '[^a-z0-9+#]+') if x != '']) as token from documents where text is not null)
select token from a where regexp_matches(token, '^[a-z0-9]+$') and token not in (select token from s)""")
def gap_terms(spark, sf):
    """Terms of one plain ASCII word that are asked for and shown nowhere; gap_terms_all has every term."""
    a = table(spark, sf, "all_jobs").select(F.explode("required_skills").alias("raw")).select(F.lower(F.trim("raw")).alias("token")).where(F.col("token").rlike("^[a-z0-9]+$")).distinct()
    s = table(spark, sf, "documents").where("text is not null").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9+#]+"))).alias("token")).distinct()
    return a.join(s, "token", "left_anti")


@query()
def gap_terms_all(spark, sf):
    """Every term that is asked for and shown nowhere: its words, in whatever script, stand in no text as a run.

    Signs between words don't count, + and # belong to words, and so does a dot before the first (.net isn't net);
    invisible characters are left out. Terms without any word must stand in a text as they are.
    """
    a = table(spark, sf, "all_jobs").select(F.explode("required_skills").alias("raw")).select(F.lower(F.trim("raw")).alias("token")).where("token != ''").distinct()
    a = with_words(a.withColumn("shape", R.visible(F.col("token"))), "shape")
    dot = F.when(F.endswith(F.get("gaps", F.lit(0)), F.lit(".")), ".").otherwise("")
    a = cut(a.select("token", "words", F.size("words").alias("size"), F.array_join("words", " ").alias("run"), F.concat(dot, F.array_join("words", " ")).alias("key")))
    d = table(spark, sf, "documents").where("text is not null").select(R.visible(F.lower("text")).alias("text"))
    runs = wanted_runs(with_words(d, "text").drop("text"), a, "run", " ")
    keys = F.when(F.endswith("before", F.lit(".")), F.array("run", F.concat(F.lit("."), "run"))).otherwise(F.array("run"))
    shown = runs.select(F.explode(keys).alias("key")).distinct()
    signs = a.where("size = 0").select("token")
    seen = d.join(F.broadcast(signs), F.contains(F.col("text"), R.visible(F.col("token")))).select("token").distinct()
    return a.where("size > 0").join(shown, "key", "left_anti").select("token").unionByName(signs.join(seen, "token", "left_anti"))


@query("""
with p as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as n, count(*) over (partition by p_brand) as size from part)
select p_partkey, p_brand, case when n = 1 then 1.0::double when size > 1 then round(0.4 / (size - 1), 8)::double end as weight from p""")
def comparable_split(spark, sf):
    """A weight split between the first of a group and its mates."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    groups = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("size"))
    return p.join(groups, "p_brand").select("p_partkey", "p_brand", F.when(F.col("p_partkey") == F.col("first"), F.lit(1.0)).when(F.col("size") > 1, F.round(0.4 / (F.col("size") - 1), 8)).alias("weight"))


@query("""
with b as (select l_orderkey, min(l_shipdate) as first_day, max(l_shipdate) as last_day from lineitem group by 1)
select o_orderkey, coalesce(o_orderdate < first_day, false) as before_all, strftime(o_orderdate + interval 1 month, '%Y-%m-%d') as due from orders left join b on l_orderkey = o_orderkey""")
def deadline_ranges(spark, sf):
    """A date against a range, and a calendar month added with the end of the month kept."""
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_day"))
    j = table(spark, sf, "orders").join(b, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce(F.col("o_orderdate") < F.col("first_day"), F.lit(False)).alias("before_all"), F.date_format(F.add_months("o_orderdate", 1), "yyyy-MM-dd").alias("due"))


@query("""
select job_id, min(trim(regexp_replace(lower(role), '[^a-z0-9]+', ' ', 'g'))) as title_key, max(len(list_distinct([trim(x) for x in string_split(lower(location), ',') if trim(x) != '']))) as place_parts from all_jobs where job_id is not null group by 1""")
def scalar_normalisers(spark, sf):
    """Normal forms of titles and places."""
    title = F.trim(F.regexp_replace(F.lower("role"), "[^a-z0-9]+", " "))
    parts = F.array_distinct(F.filter(F.transform(F.split(F.lower("location"), ",", -1), lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(F.min(title).alias("title_key"), F.max(F.when(F.col("location").isNotNull(), F.size(parts)).cast("long")).alias("place_parts"))


@query("""
select lower(b.board_id) as board, count(*) as copies, count(distinct b.board_id) as spellings, bool_or(p.board_id is not null) as polled from ats_boards b left join (select distinct lower(board_id) as board_id, ats from list_polls) p on p.board_id = lower(b.board_id) and p.ats = b.ats group by 1""")
def case_insensitive_match(spark, sf):
    """Keys matched regardless of case."""
    p = table(spark, sf, "list_polls").select(F.lower("board_id").alias("pb"), F.col("ats").alias("pa")).distinct()
    b = table(spark, sf, "ats_boards").withColumn("board", F.lower("board_id")).join(p, (F.col("pb") == F.col("board")) & (F.col("pa") == F.col("ats")), "left")
    return b.groupBy("board").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("board_id").alias("spellings"), F.bool_or(F.col("pb").isNotNull()).alias("polled"))


@query("""
select company, count(distinct job_id) as jobs, round(min(salary_min_lpa), 2) as low, round(max(salary_max_lpa), 2) as high, round(avg(salary_min_lpa), 4) as mean_low from all_jobs where company is not null group by 1""")
def company_pay(spark, sf):
    """Pay by company, a row for every company."""
    a = table(spark, sf, "all_jobs").where("company is not null").groupBy("company")
    return a.agg(F.count_distinct("job_id").alias("jobs"), F.round(F.min("salary_min_lpa"), 2).alias("low"), F.round(F.max("salary_max_lpa"), 2).alias("high"), F.round(F.avg("salary_min_lpa"), 4).alias("mean_low"))


@query()
def beam_set_cover(spark, sf):
    """For each advert's latest text the few lines that show the most of the skills it asks for, each as a whole word."""
    from jobmill.plans.texts import latest_adverts

    skills = F.array_distinct(F.filter(F.transform("required_skills", lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    j = latest_adverts(spark, sf).where("required_skills is not null").select("job_id", F.lower("jd_text").alias("text"), skills.alias("skills"))
    lines = j.select("job_id", "skills", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    shown = lines.select("job_id", "line_no", F.filter("skills", lambda s: R.has_term(F.col("line"), s)).alias("shown")).where(F.size("shown") > 0)
    return O.set_cover(shown, "job_id", "line_no", "shown")
