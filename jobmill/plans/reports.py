"""Reports, evaluation, projections and row predicates over the whole tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmill.functions import rules as R
from jobmill.operators import relational as O
from jobmill.plans.texts import LATEST, latest_adverts
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


# --- evaluation -------------------------------------------------------------------------------------------------


@query("""
with n as (select o_orderpriority as p, count(*) filter (where o_totalprice >= 150000) as n from orders group by 1),
r as (select o_orderpriority as p, epoch_us(o_orderdate) as v, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey) as r from orders)
select p, n as passed, v as equivalent from n join r using (p) where r = n""")
def equivalent_cut(spark, sf):
    """The cut on another scale (the date) that as many rows of a group pass as pass the old one (the price); ranks by ranges."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p"), "o_totalprice", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("newest"), "o_orderkey")
    n = o.groupBy("p").agg(F.count_if(F.col("o_totalprice") >= 150000).alias("passed"))
    r = O.running_total(o.select("p", "newest", "o_orderkey"), ["p"], ["newest", "o_orderkey"], F.lit(1), "r")
    return r.join(n, "p").where("r = passed").select("p", "passed", (-F.col("newest")).alias("equivalent"))


@query("""
with r as (select o_orderpriority as p, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as r, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderkey, round((r - 1) / (n - 1)::double, 6) as percentile from r where n > 1""")
def percentile_ranks(spark, sf):
    """Every row's ordinal percentile rank in its group, from 0 to 1; ranks by ranges."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p"), "o_totalprice", "o_orderkey")
    n = o.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    r = O.running_total(o, ["p"], ["o_totalprice", "o_orderkey"], F.lit(1), "r")
    return r.join(n, "p").select("o_orderkey", F.round((F.col("r") - 1) / (F.col("n") - 1), 6).alias("percentile"))


@query("""
with a as (select user_id, sum(value) as v, count(*) as n from events where ts < timestamp '2024-01-16' group by 1), b as (select user_id, sum(value) as v, count(*) as n from events where ts >= timestamp '2024-01-16' group by 1)
select user_id, round(b.v - a.v, 4) as d_value, b.n - a.n as d_events, (a.v >= 500) != (b.v >= 500) as flipped from a join b using (user_id)""")
def result_deltas(spark, sf):
    """Two result sets joined on their id: what changed in each row, and which verdicts flip."""
    e = table(spark, sf, "events").select("user_id", F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False)).alias("old"), "value")
    side = lambda s: e.where(F.col("old") == (s == "a")).groupBy("user_id").agg(F.sum("value").alias(f"v_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    j = side("a").join(side("b"), "user_id")
    return j.select("user_id", F.round(F.col("v_b") - F.col("v_a"), 4).alias("d_value"), (F.col("n_b") - F.col("n_a")).alias("d_events"), ((F.col("v_a") >= 500) != (F.col("v_b") >= 500)).alias("flipped"))


@query("""
with g as (select distinct job_id, regexp_replace(lower(trim(unnest(required_skills))), '[^a-z0-9+#]', '', 'g') as k from all_jobs), p as (select distinct job_id, regexp_replace(lower(trim(unnest(nice_to_have))), '[^a-z0-9+#]', '', 'g') as k from all_jobs),
m as (select g.job_id, g.k as gold, min(struct_pack(far := case when p.k = g.k then 0 else 1 end, size := -length(p.k), k := p.k)) as best from g join p on p.job_id = g.job_id and (p.k = g.k or (length(p.k) >= 4 and contains(g.k, p.k)) or (length(g.k) >= 4 and contains(p.k, g.k))) where g.k != '' and p.k != '' group by 1, 2),
n as (select job_id, count(*) as gold from g where k != '' group by 1)
select n.job_id, n.gold, count(m.gold) as matched, count(*) filter (best.far = 0) as exact from n left join m on m.job_id = n.job_id group by 1, 2""")
def gold_matches(spark, sf):
    """Two lists of terms held against each other: each gold term takes its best counterpart (the same key, or else the longest that
    contains it or lies in it); how many are matched, and how many exactly."""
    def keys(c: str, name: str) -> DataFrame:
        return table(spark, sf, "all_jobs").select("job_id", F.explode(c).alias("x")).select("job_id", R.phrase_key(F.trim("x")).alias(name)).where(F.col(name) != "").distinct()

    g, p = keys("required_skills", "g"), keys("nice_to_have", "p")
    inside = lambda a, b: (F.length(b) >= 4) & F.contains(F.col(a), F.col(b))
    m = g.join(p, "job_id").where((F.col("g") == F.col("p")) | inside("g", "p") | inside("p", "g")).groupBy("job_id", "g").agg(F.min(F.struct(F.when(F.col("g") == F.col("p"), 0).otherwise(1).alias("far"), (-F.length("p")).alias("size"), "p")).alias("best"))
    n = g.groupBy("job_id").agg(F.count(F.lit(1)).alias("gold"))
    both = n.join(m.select("job_id", "best"), "job_id", "left")
    return both.groupBy("job_id", "gold").agg(F.count("best").alias("matched"), F.count_if(F.col("best.far") == 0).alias("exact"))


@query(f"""
with {LATEST}, s as (select coalesce(len(required_skills), 0) as skills, length(jd_text) as size, outcome, years_required from latest)
select 'adverts' as metric, '' as part, count(*)::double as value from s union all select 'outcome', coalesce(outcome, '-'), count(*) from s group by 2 union all select 'skills', cast(skills as varchar), count(*) from s group by 2
union all select 'years', coalesce(cast(years_required as varchar), '-'), count(*) from s group by 2 union all select 'mean_size', '', round(avg(size), 4) from s union all select 'longest', '', max(size) from s""")
def run_summary(spark, sf):
    """Many metrics of a run in one long table: counts, histograms and means, from one pass over one grouped set."""
    s = latest_adverts(spark, sf).select(F.coalesce(F.size("required_skills"), F.lit(0)).alias("skills"), F.length("jd_text").alias("size"), F.coalesce("outcome", F.lit("-")).alias("outcome"), F.coalesce(F.col("years_required").cast("string"), F.lit("-")).alias("years"))
    s = s.withColumn("skills", F.when(F.col("skills") < 0, 0).otherwise(F.col("skills")))
    cube = cut(s.groupBy("skills", "outcome", "years").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest")))
    one = lambda metric, value: cube.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("part"), "value")
    by = lambda c: cube.groupBy(F.col(c).cast("string").alias("part")).agg(F.sum("n").cast("double").alias("value")).select(F.lit(c).alias("metric"), "part", "value")
    return reduce(DataFrame.unionByName, [one("adverts", F.coalesce(F.sum("n"), F.lit(0))), by("outcome"), by("skills"), by("years"), one("mean_size", F.round(F.sum("total") / F.sum("n"), 4)), one("longest", F.max("longest"))])


@query("""
with m as (select distinct site, case when jd_text is null then 'null' when trim(jd_text) = '' then 'blank' end as reason, company, job_id from all_jobs where jd_text is null or trim(jd_text) = '')
select site, reason, count(*) as rows, count(distinct company) as companies, list_sort(list(distinct job_id))[1:3] as samples from m group by 1, 2""")
def missing_texts(spark, sf):
    """Adverts without a text by source and reason, with how many companies they concern and the first three of them."""
    reason = F.when(F.col("jd_text").isNull(), "null").when(F.trim("jd_text") == "", "blank")
    m = table(spark, sf, "all_jobs").select("site", reason.alias("reason"), "company", "job_id").where("reason is not null").distinct()
    counts = m.groupBy("site", "reason").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("company").alias("companies"))
    ids = O.pick_n(m.where("job_id is not null").select("site", "reason", "job_id").distinct(), ["site", "reason"], ["job_id"], 3).groupBy("site", "reason").agg(F.array_sort(F.collect_list("job_id")).alias("samples"))
    return counts.join(ids, ["site", "reason"], "left").select("site", "reason", "rows", "companies", "samples")


@query("""
with k as (select distinct regexp_replace(lower(company_key), '[^a-z0-9]', '', 'g') as k from ats_boards where company_key is not null),
c as (select company, count(distinct job_id) as jobs from all_jobs where company is not null and site not like 'ats:%' group by 1)
select company, jobs from c where regexp_replace(lower(company), '[^a-z0-9]', '', 'g') not in (select k from k) order by jobs desc, company limit 5""")
def uncovered_companies(spark, sf):
    """The five companies with the most adverts that no board has."""
    k = table(spark, sf, "ats_boards").where("company_key is not null").select(F.regexp_replace(F.lower("company_key"), "[^a-z0-9]", "").alias("k")).distinct()
    c = table(spark, sf, "all_jobs").where("company is not null and site not like 'ats:%'").groupBy("company").agg(F.count_distinct("job_id").alias("jobs"))
    return c.withColumn("k", F.regexp_replace(F.lower("company"), "[^a-z0-9]", "")).join(k, "k", "left_anti").orderBy(F.desc("jobs"), "company").limit(5).select("company", "jobs")


@query("""
with t as (select trim(unnest(required_skills)) as term, 1 as weight from all_jobs union all select trim(unnest(nice_to_have)), 1 from all_jobs union all select term, 2 from skill_registry)
select lower(term) as term, cast(sum(weight) as bigint) as n from t where trim(term) != '' group by 1""")
def pending_terms(spark, sf):
    """Terms counted over three sources, each row by its source's weight."""
    j = table(spark, sf, "all_jobs")
    parts = [j.select(F.explode(c).alias("term"), F.lit(1).alias("w")) for c in ("required_skills", "nice_to_have")] + [table(spark, sf, "skill_registry").select("term", F.lit(2).alias("w"))]
    return reduce(DataFrame.unionByName, parts).select(F.lower(F.trim("term")).alias("term"), "w").where("term != ''").groupBy("term").agg(F.sum("w").alias("n"))


# --- vectors and arrays ------------------------------------------------------------------------------------------


@query("""
select label, cast(i - 1 as int) as dim, round(sum((vec_id % 7 + 1) * embedding[i]::double) / sum(vec_id % 7 + 1), 4) + 0.0::double as mean from embeddings, (select unnest(generate_series(1, 64)) as i) where i <= len(embedding) group by 1, 2""")
def weighted_mean_vector(spark, sf):
    """Mean vectors by label, each vector by its weight, one row for each dimension."""
    e = table(spark, sf, "embeddings").select("label", (F.pmod("vec_id", F.lit(7)) + 1).alias("w"), F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg((F.round(F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w"), 4) + F.lit(0.0)).alias("mean"))


@query("""
select a.vec_id, [round(coalesce(b.embedding[i]::double, 0) + a.embedding[i]::double, 5) + 0.0::double for i in generate_series(1, len(a.embedding))] as total from embeddings a left join embeddings b on b.vec_id = a.vec_id - 1""")
def vector_sums(spark, sf):
    """Each vector plus the one before it, element by element; an absent vector changes nothing."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    plus = F.zip_with(F.col("embedding"), F.coalesce("before", F.array().cast("array<float>")), lambda x, y: F.round(x.cast("double") + F.coalesce(y.cast("double"), F.lit(0.0)), 5) + F.lit(0.0))
    return e.join(b, "vec_id", "left").select("vec_id", F.slice(plus, F.lit(1), F.size("embedding")).alias("total"))


@query("select vec_id, len(embedding) as size, round(embedding[1]::double, 4) + 0.0::double as first, round(embedding[len(embedding)]::double, 4) + 0.0::double as last from embeddings")
def vector_texts(spark, sf):
    """Vectors written as JSON text and read back."""
    e = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("text")).select("vec_id", F.from_json("text", "array<double>").alias("v"))
    end = lambda i: F.round(F.get("v", i), 4) + F.lit(0.0)
    return e.select("vec_id", F.size("v").cast("long").alias("size"), end(F.lit(0)).alias("first"), end(F.size("v") - 1).alias("last"))


@query("select distinct job_id, unnest(required_skills) as required, unnest(nice_to_have) as nice from all_jobs where required_skills is not null and nice_to_have is not null")
def parallel_arrays(spark, sf):
    """Two arrays exploded side by side; the shorter one is filled with nulls."""
    j = table(spark, sf, "all_jobs").where("required_skills is not null and nice_to_have is not null")
    return j.select("job_id", F.explode(F.arrays_zip(F.col("required_skills").alias("required"), F.col("nice_to_have").alias("nice"))).alias("x")).select("job_id", "x.required", "x.nice").distinct()


@query("select job_id, bool_or(len(list_intersect([lower(x) for x in required_skills if x is not null], (select list(distinct lower(term)) from skill_registry where label = 'domain'))) > 0) as domain from all_jobs where required_skills is not null and job_id is not null group by 1")
def array_membership(spark, sf):
    """Whether any of an array's values is on a list; by a join on the values, so that the list may have any size."""
    j = table(spark, sf, "all_jobs").where("required_skills is not null and job_id is not null")
    keys = table(spark, sf, "skill_registry").where("label = 'domain' and term is not null").select(F.lower("term").alias("x"), F.lit(True).alias("on")).distinct()
    v = j.select("job_id", F.explode_outer("required_skills").alias("x")).select("job_id", F.lower("x").alias("x"))
    return v.join(keys, "x", "left").groupBy("job_id").agg(F.bool_or(F.coalesce("on", F.lit(False))).alias("domain"))


# --- joins, unions and orders -----------------------------------------------------------------------------------


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey and (c_acctbal > 9000 or n_regionkey = 1)")
def or_predicate_join(spark, sf):
    """An equi join with a further predicate of either of two conditions."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, (F.col("c_nationkey") == F.col("n_nationkey")) & ((F.col("c_acctbal") > 9000) | (F.col("n_regionkey") == 1))).select("c_custkey", "n_name")


@query(f"with {LATEST}, b as (select lower(ats) as ats, lower(board_id) as board, max(board_name) as name from ats_boards group by 1, 2) select l.job_id, coalesce(nullif(trim(l.job_url), ''), 'job:' || l.job_id) as link, coalesce(b.name, l.company) as shown from latest l left join b on l.site = 'ats:' || b.ats and lower(split_part(l.job_id, '-', 2)) = b.board")
def coalesced_links(spark, sf):
    """Adverts with the first usable link and name of several: their own or what the board has."""
    b = table(spark, sf, "ats_boards").groupBy(F.concat(F.lit("ats:"), F.lower("ats")).alias("site"), F.lower("board_id").alias("board")).agg(F.max("board_name").alias("name"))
    l = latest_adverts(spark, sf).withColumn("board", F.lower(F.split_part("job_id", F.lit("-"), F.lit(2))))  # noqa: E741
    return l.join(b, ["site", "board"], "left").select("job_id", F.coalesce(F.nullif(F.trim("job_url"), F.lit("")), F.concat(F.lit("job:"), "job_id")).alias("link"), F.coalesce("name", "company").alias("shown"))


@query("select distinct lower(p.ats) as ats, lower(p.board_id) as board from list_polls p where not exists (select 1 from ats_boards b where lower(b.ats) = lower(p.ats) and lower(b.board_id) = lower(p.board_id) and b.tier = 'hot')")
def unlisted_boards(spark, sf):
    """Boards that were polled but aren't on the hot list, regardless of case."""
    key = [F.lower("ats").alias("ats"), F.lower("board_id").alias("board")]
    return table(spark, sf, "list_polls").select(*key).distinct().join(table(spark, sf, "ats_boards").where("tier = 'hot'").select(*key).distinct(), ["ats", "board"], "left_anti")


@query("""
with s as (select term, 1 as source from skill_registry union all select unnest(required_skills), 2 from all_jobs union all select unnest(nice_to_have), 3 from all_jobs), t as (select lower(trim(term)) as k, source, trim(term) as term from s where trim(term) != '')
select k, min(struct_pack(source := source, term := term)).term as spelling, length(k) as size, min(source) as source from t group by 1""")
def term_sources_union(spark, sf):
    """The ordered union of three sources of terms: each term once, as the first source that has it spells it."""
    j = table(spark, sf, "all_jobs")
    s = reduce(DataFrame.unionByName, [table(spark, sf, "skill_registry").select("term", F.lit(1).alias("source")), j.select(F.explode("required_skills").alias("term"), F.lit(2).alias("source")), j.select(F.explode("nice_to_have").alias("term"), F.lit(3).alias("source"))])
    t = s.select(F.trim("term").alias("term"), "source").where("term != ''")
    return t.groupBy(F.lower("term").alias("k")).agg(F.min(F.struct("source", "term")).alias("m")).select("k", F.col("m.term").alias("spelling"), F.length("k").cast("long").alias("size"), "m.source")


@query("""
with o as (select p_partkey, p_brand, p_size > 45 as flagged, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part), f as (select p_brand, min(r) filter (flagged) as best from o group by 1)
select p_partkey, p_brand, cast(case when best is null or best <= 3 or (r > best) then r when r = best then 3 when r >= 3 then r + 1 else r end as bigint) as place from o join f using (p_brand)""")
def ordered_with_a_place_kept(spark, sf):
    """Rows of a group by price, with one flagged row sure of a place among the first three: the best one moves up to it."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") > 45).alias("flagged"), (-F.col("p_retailprice")).alias("down"))
    r = cut(O.running_total(p, ["p_brand"], ["down", "p_partkey"], F.lit(1), "r"))
    best = r.where("flagged").groupBy("p_brand").agg(F.min("r").alias("best"))
    place = F.when(F.col("best").isNull() | (F.col("best") <= 3) | (F.col("r") > F.col("best")), F.col("r")).when(F.col("r") == F.col("best"), 3).when(F.col("r") >= 3, F.col("r") + 1).otherwise(F.col("r"))
    return r.join(best, "p_brand", "left").select("p_partkey", "p_brand", place.cast("long").alias("place"))


@query("select doc_id, lang from documents order by md5(cast(doc_id as varchar)), doc_id limit 300")
def digest_sample(spark, sf):
    """A random sample of 300 rows that is the same at each run: the first in the order of a digest."""
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(300)


@query("""
with v as (select job_id, max(applicants_count) as a, max(salary_max_lpa) as s from all_jobs where job_id is not null group by 1) select job_id, coalesce(a, 0) as first_key, round(coalesce(s, -1.0), 4) as second_key from v order by coalesce(a, 0) desc, coalesce(s, -1.0) desc, job_id limit 50""")
def two_key_order(spark, sf):
    """The first 50 by two descending keys with a default each for nulls, ties by id."""
    v = table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(F.coalesce(F.max("applicants_count"), F.lit(0)).alias("first_key"), F.coalesce(F.max("salary_max_lpa"), F.lit(-1.0)).alias("s"))
    return v.orderBy(F.desc("first_key"), F.desc("s"), "job_id").limit(50).select("job_id", "first_key", F.round("s", 4).alias("second_key"))


# --- projections and predicates ---------------------------------------------------------------------------------


@query("""
with p as (select distinct location, list_distinct([upper(left(trim(x), 1)) || substring(trim(x), 2) for x in regexp_split_to_array(lower(regexp_replace(location, '\\(.*?\\)|remote', '', 'gi')), '[,/]') if trim(x) != '']) as parts, regexp_matches(lower(location), 'remote') as remote from all_jobs where location is not null),
o as (select location, remote, [x for x in regexp_split_to_array(lower(regexp_replace(location, '\\(.*?\\)|remote', '', 'gi')), '[,/]') if trim(x) != ''] as raw from p),
q as (select location, remote, [upper(left(trim(x), 1)) || substring(trim(x), 2) for x in raw] as ps from o)
select location, array_to_string(list_filter(list_transform(range(1, len(ps) + 1), lambda i: case when list_position(ps, ps[i]) = i then ps[i] end), lambda x: x is not null)[1:3], ', ') || case when remote then ' (Remote)' else '' end as shown from q""")
def clean_locations(spark, sf):
    """Places in readable form: at most three different parts, each with a capital, and whether they are remote."""
    text = F.lower(F.regexp_replace("location", r"(?i)\(.*?\)|remote", ""))
    parts = F.filter(F.transform(F.split(text, "[,/]", -1), lambda x: F.trim(x)), lambda x: x != "")
    capital = F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x))))
    shown = F.array_join(F.slice(F.array_distinct(capital), F.lit(1), F.lit(3)), ", ")
    remote = F.when(F.contains(F.lower("location"), F.lit("remote")), " (Remote)").otherwise("")
    return table(spark, sf, "all_jobs").where("location is not null").select("location").distinct().select("location", F.concat(shown, remote).alias("shown"))


@query("""
with b as (select distinct lower(trim(split_part(location, ',', 1))) as city from all_jobs where site like 'ats:%' and location is not null), w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as city from documents where text is not null)
select doc_id, city from w join b using (city) where regexp_matches(city, '^[a-z]+$')""")
def cities_named(spark, sf):
    """Cities of one word that boards name and that a document's text names too."""
    b = table(spark, sf, "all_jobs").where("site like 'ats:%' and location is not null").select(F.lower(F.trim(F.split_part("location", F.lit(","), F.lit(1)))).alias("city")).where(F.col("city").rlike("^[a-z]+$")).distinct()
    w = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+", -1))).alias("city"))
    return w.join(b, "city").select("doc_id", "city")


@query("""
select job_id, case len(s) when 0 then '' when 1 then s[1] else array_to_string(s[1:-2], ', ') || ' and ' || s[-1] end as prose from (select job_id, [trim(x) for x in max(required_skills) if trim(x) != ''] as s from all_jobs where job_id is not null and required_skills is not null group by 1)""")
def prose_lists(spark, sf):
    """Lists as prose: a, b and c."""
    j = table(spark, sf, "all_jobs").where("job_id is not null and required_skills is not null").groupBy("job_id").agg(F.max("required_skills").alias("s"))
    s = j.select("job_id", F.filter(F.transform("s", lambda x: F.trim(x)), lambda x: x != "").alias("s"))
    prose = F.when(F.size("s") == 0, "").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(F.concat(F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), ", "), F.lit(" and "), F.element_at("s", -1)))
    return s.select("job_id", prose.alias("prose"))


@query("select poll_no, left(trim(string_split(error_text, chr(10))[1]), 120) as short, count(*) as rows from list_polls where error_text is not null group by 1, 2")
def short_errors(spark, sf):
    """Errors by their first line, at most 120 characters."""
    return table(spark, sf, "list_polls").where("error_text is not null").groupBy("poll_no", F.left(F.trim(F.get(F.split("error_text", "\n", -1), F.lit(0))), F.lit(120)).alias("short")).agg(F.count(F.lit(1)).alias("rows"))


@query("""
with p as (select o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from orders group by 1)
select o_custkey, strftime(a, '%b %Y') || ' – ' || case when b >= timestamp '1998-01-01' then 'Present' else strftime(b, '%b %Y') end as period, cast(strftime(a, '%Y%m') as int) as sort_key from p""")
def short_periods(spark, sf):
    """Ranges of months for display ("Jun 1995 – Present"), with a key to sort by."""
    p = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    month = lambda c: F.date_format(c, "MMM yyyy")
    return p.select("o_custkey", F.concat(month("a"), F.lit(" – "), F.when(F.col("b") >= F.lit("1998-01-01").cast("timestamp"), "Present").otherwise(month("b"))).alias("period"), F.date_format("a", "yyyyMM").cast("int").alias("sort_key"))


@query("""
select job_id, bool_or(coalesce(site like 'ats:%', false)) as board, bool_or(coalesce(regexp_matches(job_url, '^https?://[^/]+\\.[^/]+/.+'), false)) as usable_link,
bool_or(coalesce(scraped_at - posted_at > interval 30 days, false)) as too_old, bool_or(coalesce(years_required <= 2 or lower(role_level) = 'junior' or regexp_matches(lower(role), '(^|[^a-z])(junior|jr|jnr|intern)([^a-z]|$)'), false)) as junior,
max(case when lower(job_type) like '%part%' then 'parttime' when lower(job_type) like '%contract%' then 'contract' when lower(job_type) like '%intern%' then 'internship' when lower(job_type) like '%full%' then 'fulltime' end) as employment from all_jobs where job_id is not null group by 1""")
def row_flags(spark, sf):
    """What a row's fields say: from a board, with a usable link, too old when it was seen, for beginners, and the type of employment."""
    low = F.lower("job_type")
    kind = F.when(F.contains(low, F.lit("part")), "parttime").when(F.contains(low, F.lit("contract")), "contract").when(F.contains(low, F.lit("intern")), "internship").when(F.contains(low, F.lit("full")), "fulltime")
    flags = {
        "board": F.col("site").startswith("ats:"), "usable_link": F.col("job_url").rlike(r"^https?://[^/]+\.[^/]+/.+"), "too_old": F.unix_micros("scraped_at") - F.unix_micros("posted_at") > 30 * 86400 * 10**6,
        "junior": R.rejects(F.col("years_required") <= 2) | R.rejects(F.lower("role_level") == "junior") | R.rejects(F.lower("role").rlike("(^|[^a-z])(junior|jr|jnr|intern)([^a-z]|$)")),
    }
    return table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(*[F.bool_or(R.rejects(p)).alias(n) for n, p in flags.items()], F.max(kind).alias("employment"))


@query("""
with b as (select company from all_jobs where company is not null group by 1 having count(distinct job_id) >= 100)
select job_id, bool_or(lower(trim(company)) in (select lower(trim(company)) from b)) as blocked from all_jobs where job_id is not null and company is not null group by 1""")
def blocked_companies(spark, sf):
    """Adverts of companies whose whole name is on a list (here: those with 100 adverts or more), regardless of case."""
    j = table(spark, sf, "all_jobs").where("job_id is not null and company is not null")
    names = j.groupBy("company").agg(F.count_distinct("job_id").alias("n")).where("n >= 100").select(F.lower(F.trim("company")).alias("k"), F.lit(True).alias("b")).distinct()
    return j.withColumn("k", F.lower(F.trim("company"))).join(names, "k", "left").groupBy("job_id").agg(F.bool_or(F.coalesce("b", F.lit(False))).alias("blocked"))


@query("""
with t as (select lower(trim(unnest(required_skills))) as term, company, job_id from all_jobs), c as (select term, count(distinct job_id) as jobs, count(distinct company) as companies from t where term is not null group by 1)
select term, jobs, companies, case when length(term) < 2 then 'short' when length(term) > 40 then 'long' when not regexp_matches(term, '[a-z]') then 'no_letter' when len(string_split(term, ' ')) > 4 then 'clause' when regexp_matches(term, '^[0-9]') then 'number' when companies < 2 then 'rare' end as rule from c where term != ''""")
def plausible_terms(spark, sf):
    """Candidate terms with the first rule that rejects each; null where none does."""
    t = table(spark, sf, "all_jobs").select("job_id", "company", F.explode("required_skills").alias("x")).select("job_id", "company", F.lower(F.trim("x")).alias("term")).where("term != ''")
    c = t.groupBy("term").agg(F.count_distinct("job_id").alias("jobs"), F.count_distinct("company").alias("companies"))
    rule = R.first_reason(("short", F.length("term") < 2), ("long", F.length("term") > 40), ("no_letter", ~F.col("term").rlike("[a-z]")), ("clause", F.size(F.split("term", " ", -1)) > 4), ("number", F.col("term").rlike("^[0-9]")), ("rare", F.col("companies") < 2))
    return c.select("term", "jobs", "companies", rule.alias("rule"))


@query("""
select job_id, reason, case reason when 'years' then 'asks for ' || years || ' years' when 'level' then 'level ' || level when 'no_text' then 'no text' end as detail from (select job_id, years, level, case when years > 8 then 'years' when level in ('principal', 'staff') then 'level' when not has_text then 'no_text' end as reason
 from (select job_id, max(years_required) as years, max(lower(trim(role_level))) as level, coalesce(bool_or(trim(jd_text) != ''), false) as has_text from all_jobs where job_id is not null group by 1)) where reason is not null""")
def verdict_details(spark, sf):
    """The first reason against an advert with its detail in words; adverts without one aren't given."""
    j = table(spark, sf, "all_jobs").where("job_id is not null").groupBy("job_id").agg(F.max("years_required").alias("years"), F.max(F.lower(F.trim("role_level"))).alias("level"), F.coalesce(F.bool_or(F.trim("jd_text") != ""), F.lit(False)).alias("has_text"))
    reason = R.first_reason(("years", F.col("years") > 8), ("level", F.col("level").isin("principal", "staff")), ("no_text", ~F.col("has_text")))
    detail = F.when(F.col("reason") == "years", F.format_string("asks for %d years", "years")).when(F.col("reason") == "level", F.concat(F.lit("level "), "level")).when(F.col("reason") == "no_text", "no text")
    return j.withColumn("reason", reason).where("reason is not null").select("job_id", "reason", detail.alias("detail"))


@query("""
with p as (select distinct ats, board_id, poll_no, polled_at from list_polls), g as (select *, polled_at - lag(polled_at) over (partition by ats, board_id order by polled_at, poll_no) as gap from p)
select ats, board_id, count(*) as polls, cast(max(epoch(gap)) as bigint) as longest_gap_s, cast(round(avg(epoch(gap))) as bigint) as mean_gap_s from g group by 1, 2""")
def poll_gaps(spark, sf):
    """How regularly each board was polled."""
    p = table(spark, sf, "list_polls").select("ats", "board_id", "poll_no", "polled_at").distinct()
    gap = F.unix_seconds("polled_at") - F.unix_seconds(F.lag("polled_at").over(Window.partitionBy("ats", "board_id").orderBy("polled_at", "poll_no")))
    g = p.withColumn("gap", gap)
    return g.groupBy("ats", "board_id").agg(F.count(F.lit(1)).alias("polls"), F.max("gap").alias("longest_gap_s"), F.round(F.avg("gap")).cast("long").alias("mean_gap_s"))
