"""What adverts ask for: terms resolved against the registry, typed, weighted, found in texts, and how far lines show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.functions import terms as T
from jobmill.plans.relational import wanted_runs
from jobmill.plans.texts import CATEGORIES, LATEST, SECTIONS, latest_adverts
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


def trimmed(array: str) -> Column:
    """The array's values without outer blanks, without nulls and blank ones."""
    return F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x != "")


@query("""
select job_id, list_transform(list_filter(list_transform(range(1, len(ts) + 1), lambda i: struct_pack(i := i, t := ts[i])), lambda x: list_position(list_transform(ts, lambda y: lower(y)), lower(x.t)) = x.i), lambda x: x.t) as tokens
from (select job_id, [trim(x) for x in regexp_split_to_array(max(role), '[,()]') if length(trim(x)) > 1] as ts from all_jobs where job_id is not null and role is not null group by 1)""")
def line_tokens(spark, sf):
    """A line split at commas and brackets into tokens of two characters or more, each once whatever its case, in order."""
    j = table(spark, sf, "all_jobs").where("job_id is not null and role is not null").groupBy("job_id").agg(F.max("role").alias("role"))
    ts = F.filter(F.transform(F.split("role", "[,()]", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    first = F.filter("ts", lambda t, i: F.array_position(F.transform("ts", lambda y: F.lower(y)), F.lower(t)) == i + 1)
    return j.withColumn("ts", ts).select("job_id", first.alias("tokens"))


@query("""
with r as (select term, coalesce(max(means[1]), term) as head from skill_registry where term is not null group by term),
k as (select term, head, regexp_replace(lower(term), '[^a-z0-9+#]', '', 'g') as key from r union select head, head, regexp_replace(lower(head), '[^a-z0-9+#]', '', 'g') from r),
f as (select head, list_sort(list_distinct(list(key))) as keys, min(key) as canonical from k where key != '' group by 1)
select r.term, r.head, f.keys, f.canonical from r join f using (head)""")
def term_families(spark, sf):
    """Every registry term with the keys of its whole family (what it stands for, and all that stand for the same) and the least one,
    which is the same for all of them."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9+#]", "")
    r = table(spark, sf, "skill_registry").where("term is not null").groupBy("term").agg(F.max(F.get("means", F.lit(0))).alias("m")).select("term", F.coalesce("m", "term").alias("head"))
    k = r.select("head", key("term").alias("key")).unionByName(r.select("head", key("head").alias("key"))).where("key != ''")
    f = k.groupBy("head").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.min("key").alias("canonical"))
    return r.join(f, "head").select("term", "head", "keys", "canonical")


@query("""
with r as (select lower(term) as k, coalesce(max(means[1]), min(term)) as skill from skill_registry where term is not null group by 1),
v as (select distinct job_id, 'required_skills' as field, lower(trim(unnest(required_skills))) as k from all_jobs union select distinct job_id, 'nice_to_have', lower(trim(unnest(nice_to_have))) from all_jobs)
select job_id, skill, bool_or(field = 'required_skills') as required from v join r using (k) where job_id is not null group by 1, 2""")
def registry_skills(spark, sf):
    """The registry's skills that an advert names as they are written there, whatever the case, and whether as required."""
    r = table(spark, sf, "skill_registry").where("term is not null").groupBy(F.lower("term").alias("k")).agg(F.coalesce(F.max(F.get("means", F.lit(0))), F.min("term")).alias("skill"))
    fields = F.array(F.struct(F.lit(True).alias("required"), F.col("required_skills").alias("v")), F.struct(F.lit(False).alias("required"), F.col("nice_to_have").alias("v")))
    v = table(spark, sf, "all_jobs").where("job_id is not null").select("job_id", F.explode(fields).alias("f")).select("job_id", "f.required", F.explode("f.v").alias("k")).select("job_id", "required", F.lower(F.trim("k")).alias("k"))
    return v.join(r, "k").groupBy("job_id", "skill").agg(F.bool_or("required").alias("required"))


TOOL = "[0-9+#.]|[a-z][A-Z]|^[A-Z]{2,}$"
_KIND_SQL = f"case when regexp_matches(trim(term), '{TOOL}') then 'tool' when contains(trim(term), ' ') then 'concept' else 'generic' end"


def kind_of(term: Column) -> Column:
    """tool, concept or generic, by how a term is spelt: with digits, signs or inner capitals; with several words; otherwise."""
    return F.when(F.regexp_like(F.trim(term), F.lit(TOOL)), "tool").when(F.contains(F.trim(term), F.lit(" ")), "concept").otherwise("generic")


@query(f"select term, {_KIND_SQL} as kind from skill_registry where term is not null")
def term_kinds(spark, sf):
    """The kind of every registry term."""
    return table(spark, sf, "skill_registry").where("term is not null").select("term", kind_of(F.col("term")).alias("kind"))


FACTORS = {"tool": 1.0, "concept": 0.8, "generic": 0.5}  #: how much a kind weighs
SHORT, POWER = 8, 2.0  #: lists shorter than this weigh their named terms more, by this power
_FACTOR_SQL = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in FACTORS.items()) + " end"

_CHECKLIST = f"""{LATEST},
 v as (select job_id, trim(unnest(required_skills)) as term, true as required from latest union all select job_id, trim(unnest(nice_to_have)), false from latest),
 t as (select job_id, lower(term) as token, min(term) as term, bool_or(required) as required from v where term != '' group by 1, 2),
 s as (select *, {_KIND_SQL} as kind, count(*) over (partition by job_id) as size from t),
 w as (select *, {_FACTOR_SQL} * case when required then 1.0 else 0.5 end * case when kind = 'tool' and size < {SHORT} then 1 + power(1 - size / {SHORT}.0, {POWER}) else 1.0 end as raw from s),
 checklist as (select job_id, token, required, kind, raw::double / sum(raw::double) over (partition by job_id) as weight from w)"""


def checklist(spark: SparkSession, sf: str) -> DataFrame:
    """(job_id, token, required, kind, weight) of what every advert asks for; an advert's weights sum to 1.

    A token weighs by its kind, half where it is only nice to have, and more for named tools in a short list.
    """
    j = latest_adverts(spark, sf)
    both = F.concat(F.transform(F.coalesce(trimmed("required_skills"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("term"), F.lit(True).alias("required"))),
                    F.transform(F.coalesce(trimmed("nice_to_have"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("term"), F.lit(False).alias("required"))))
    t = j.select("job_id", F.explode(both).alias("x")).select("job_id", "x.*").groupBy("job_id", F.lower("term").alias("token")).agg(F.min("term").alias("term"), F.bool_or("required").alias("required"))
    factor = F.lit(None).cast("double")
    for name, value in FACTORS.items():
        factor = F.when(F.col("kind") == name, value).otherwise(factor)
    whole = t.groupBy("job_id").agg(F.count(F.lit(1)).alias("size"))
    s = t.withColumn("kind", kind_of(F.col("term"))).join(whole, "job_id")
    boost = F.when((F.col("kind") == "tool") & (F.col("size") < SHORT), 1 + F.pow(1 - F.col("size") / float(SHORT), F.lit(POWER))).otherwise(1.0)
    w = s.withColumn("raw", factor * F.when(F.col("required"), 1.0).otherwise(0.5) * boost)
    return w.join(w.groupBy("job_id").agg(F.sum("raw").alias("sum")), "job_id").select("job_id", "token", "required", "kind", (F.col("raw") / F.col("sum")).alias("weight"))


@query(f"with {_CHECKLIST} select job_id, token, required, kind, round(weight, 6) as weight from checklist")
def job_checklists(spark, sf):
    """What every advert asks for, weighted."""
    return checklist(spark, sf).withColumn("weight", F.round("weight", 6))


@query(f"""with {_CHECKLIST}, k as (select distinct lower(term) as token from skill_registry where label = 'approve')
select job_id, round(sum(weight) filter (token in (select token from k)), 6) as covered, round(sum(weight) filter (required), 6) as required from checklist group by 1""")
def weighted_coverage(spark, sf):
    """The share of an advert's weight that the approved terms cover, and that its required terms have; null where none does."""
    k = table(spark, sf, "skill_registry").where("label = 'approve'").select(F.lower("term").alias("token"), F.lit(True).alias("known")).distinct()
    c = checklist(spark, sf).join(k, "token", "left")
    return c.groupBy("job_id").agg(F.round(F.sum(F.when(F.col("known"), F.col("weight"))), 6).alias("covered"), F.round(F.sum(F.when(F.col("required"), F.col("weight"))), 6).alias("required"))


_SHOWN = rf"""{LATEST}, e as (select distinct job_id, lower(trim(unnest(required_skills))) as skill, lower(jd_text) as text from latest),
 l as (select job_id, skill, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select job_id, skill, string_split(text, chr(10)) as ls from e where skill != '')),
 shown as (select job_id, skill, line_no from l where contains(line, skill) and regexp_matches(regexp_replace(line, '([^a-z0-9])', '\1\1', 'g'), '(?:^|[^a-z0-9])' || regexp_escape(regexp_replace(skill, '([^a-z0-9])', '\1\1', 'g')) || '(?:[^a-z0-9]|$)'))"""


def shown_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(job_id, skill, line_no) of every line of an advert's latest text that shows a skill it requires, as a whole word; from 1."""
    j = latest_adverts(spark, sf).select("job_id", F.array_distinct(F.transform(trimmed("required_skills"), lambda x: F.lower(x))).alias("skills"), F.posexplode(F.split(F.lower("jd_text"), "\n", -1)).alias("at", "line"))
    hits = F.filter("skills", lambda s: F.contains(F.col("line"), s) & (T.mentions(F.col("line"), s) > 0))
    return j.select("job_id", (F.col("at") + 1).cast("long").alias("line_no"), F.explode(hits).alias("skill"))


@query(f"""with {_SHOWN}, a as (select distinct job_id, lower(trim(unnest(required_skills))) as skill from latest), n as (select job_id, skill, count(*) as n from shown group by 1, 2)
select job_id, round(avg(least(coalesce(n, 0), 2) / 2.0), 6) as repetition, cast(count(n) as bigint) as found from a left join n using (job_id, skill) where skill != '' group by 1""")
def repetition_scores(spark, sf):
    """How well an advert's text repeats what it requires: the mean of the lines that show a skill, at most two, over two."""
    a = latest_adverts(spark, sf).select("job_id", F.explode(F.array_distinct(F.transform(trimmed("required_skills"), lambda x: F.lower(x)))).alias("skill"))
    n = shown_lines(spark, sf).groupBy("job_id", "skill").agg(F.count(F.lit(1)).alias("n"))
    return a.join(n, ["job_id", "skill"], "left").groupBy("job_id").agg(F.round(F.avg(F.least(F.coalesce("n", F.lit(0)), F.lit(2)) / 2.0), 6).alias("repetition"), F.count("n").alias("found"))


@query(f"with {_SHOWN}, f as (select job_id, skill, min(line_no) as line_no from shown group by 1, 2) select job_id, line_no, count(*) as adds, list_sort(list(skill)) as skills from f group by 1, 2")
def line_adds(spark, sf):
    """What each line of an advert shows that no line before it has."""
    f = shown_lines(spark, sf).groupBy("job_id", "skill").agg(F.min("line_no").alias("line_no"))
    return f.groupBy("job_id", "line_no").agg(F.count(F.lit(1)).alias("adds"), F.array_sort(F.collect_list("skill")).alias("skills"))


@query(f"with {_SHOWN}, a as (select distinct job_id, lower(trim(unnest(required_skills))) as skill from latest) select a.job_id, a.skill, s.skill is not null as grounded from a left join (select distinct job_id, skill from shown) s using (job_id, skill) where a.skill != ''")
def grounded_skills(spark, sf):
    """Whether the text of an advert bears out each skill that was read from it."""
    a = latest_adverts(spark, sf).select("job_id", F.explode(F.array_distinct(F.transform(trimmed("required_skills"), lambda x: F.lower(x)))).alias("skill"))
    return a.join(shown_lines(spark, sf).select("job_id", "skill", F.lit(True).alias("g")).distinct(), ["job_id", "skill"], "left").select("job_id", "skill", F.coalesce("g", F.lit(False)).alias("grounded"))


def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9+#]+", -1), lambda x: x != "")


_WORDS_SQL = "[x for x in regexp_split_to_array(lower({0}), '[^a-z0-9+#]+') if x != '']"
_RUNS = f"""d as (select doc_id, {_WORDS_SQL.format('text')} as ws from documents where text is not null),
 t as (select distinct term, {_WORDS_SQL.format('term')} as ts from skill_registry where term is not null),
 w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
 hits as (select w.doc_id, t.term, len(t.ts) as size, w.pos, array_to_string(t.ts, ' ') as run from w join t on w.word = t.ts[1] join d on d.doc_id = w.doc_id where len(t.ts) > 0 and d.ws[w.pos : w.pos + len(t.ts) - 1] = t.ts)"""


def term_runs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, term, size, at, run) of every registry term whose words stand in a document one after another; `at` is the first's place."""
    t = table(spark, sf, "skill_registry").where("term is not null").select("term", _words("term").alias("words")).where("size(words) > 0").distinct()
    t = cut(t.select("term", "words", F.size("words").cast("long").alias("size"), F.array_join("words", " ").alias("run")))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", _words("text").alias("words"))
    runs = wanted_runs(d.withColumn("gaps", F.array_repeat(F.lit(""), F.size("words") + 1)), t, "run", " ")
    return runs.select("doc_id", "run", F.col("place").alias("at")).join(t.select("term", "size", "run"), "run")


@query(f"with {_RUNS}, c as (select distinct doc_id, unnest(generate_series(pos, pos + size - 1)) as pos from hits where size > 1) select h.doc_id, h.term, count(*) as times from hits h left join c on c.doc_id = h.doc_id and c.pos = h.pos where h.size = 1 and c.pos is null group by 1, 2")
def hits_outside_longer_names(spark, sf):
    """Single-word terms where no longer term's words stand over them: a longer name never proves the word in it."""
    hits = cut(term_runs(spark, sf))
    covered = hits.where("size > 1").select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    return hits.where("size = 1").join(covered, ["doc_id", "at"], "left_anti").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("times"))


@query(f"""
with t as (select distinct term, list_distinct({_WORDS_SQL.format('term')}) as ts from skill_registry where term is not null), tw as (select term, len(ts) as n, unnest(ts) as word from t where len(ts) >= 3),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (select doc_id, {_WORDS_SQL.format('text')} as ws from documents where text is not null)),
p as (select doc_id, term, n, word, pos from w join tw using (word)), k as (select doc_id, term from p group by 1, 2 having count(distinct word) = max(n))
select distinct a.doc_id, a.term from p a join k on k.doc_id = a.doc_id and k.term = a.term join p b on b.doc_id = a.doc_id and b.term = a.term and b.pos between a.pos and a.pos + 8 + a.n - 1 group by a.doc_id, a.term, a.pos having count(distinct b.word) = max(a.n)""")
def near_hits(spark, sf):
    """Terms of three words or more of which all stand near each other in a document: within 8 + their number words, in any order."""
    t = table(spark, sf, "skill_registry").where("term is not null").select("term", F.array_distinct(_words("term")).alias("ts")).distinct().where("size(ts) >= 3")
    tw = t.select("term", F.size("ts").alias("n"), F.explode("ts").alias("word"))
    w = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(_words("text")).alias("at", "word"))
    p = w.join(tw, "word").groupBy("doc_id", "term", "n").agg(F.count_distinct("word").alias("m"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ps")).where("m = n")
    here = lambda x: F.size(F.array_distinct(F.transform(F.filter("ps", lambda y: y["at"].between(x["at"], x["at"] + 7 + F.col("n"))), lambda y: y["word"]))) == F.col("n")
    return p.where(F.exists("ps", here)).select("doc_id", "term")


@query(f"""
with r as (select distinct lower(term) as term, label from skill_registry where regexp_matches(term, '^[A-Za-z0-9+#]+$')), l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)),
w as (select distinct doc_id, line_no, unnest({_WORDS_SQL.format('line')}) as term from l), h as (select doc_id, line_no, term, label from w join r using (term)), x as (select doc_id, line_no, count(distinct term) filter (label = 'approve') as approved from h group by 1, 2)
select h.doc_id, h.term, bool_or(approved > 0) as shown from h join x using (doc_id, line_no) where label = 'sense' group by 1, 2""")
def sense_hits(spark, sf):
    """Words with several senses, and whether a line that has one names an approved term too, which shows that the skill is meant."""
    r = table(spark, sf, "skill_registry").where(F.col("term").rlike("^[A-Za-z0-9+#]+$")).select(F.lower("term").alias("term"), "label").distinct()
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    h = lines.select("doc_id", "line_no", F.explode(F.array_distinct(_words("line"))).alias("term")).join(r, "term")
    by_line = h.groupBy("doc_id", "line_no").agg(F.collect_set(F.when(F.col("label") == "sense", F.col("term"))).alias("terms"), F.bool_or(F.col("label") == "approve").alias("approved"))
    return by_line.select("doc_id", F.explode("terms").alias("term"), "approved").groupBy("doc_id", "term").agg(F.bool_or("approved").alias("shown"))


@query(f"with {SECTIONS}, dl as (select job_id, place, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select job_id, place, string_split(body, chr(10)) as ls from sections where category = 'duties')) select job_id, place, line_no, regexp_replace(line, '^[-*•–] *', '') as duty from dl where regexp_replace(line, '^[-*•–] *', '') != ''")
def duty_lines(spark, sf):
    """What an advert's duties are: the lines of those sections without their bullets."""
    s = latest_adverts(spark, sf).select("job_id", F.explode(T.sections(F.col("jd_text"), CATEGORIES)).alias("s")).where("s.category = 'duties'")
    l = s.select("job_id", "s.place", F.posexplode(F.split("s.body", "\n", -1)).alias("at", "line"))  # noqa: E741
    return l.select("job_id", "place", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("line", "^[-*•–] *", "").alias("duty")).where("duty != ''")


JOB_TYPES = {"internship": r"intern(ship)?s?", "contract": r"contract(or)?|freelance|temporary", "parttime": r"part[- ]?time", "fulltime": r"full[- ]?time|permanent"}
_TYPE_SQL = "case " + " ".join(f"when regexp_matches({{0}}, '(^|[^a-z])({p})([^a-z]|$)') then '{k}'" for k, p in JOB_TYPES.items()) + " end"


@query(f"with {LATEST} select job_id, coalesce({_TYPE_SQL.format('lower(role)')}, {_TYPE_SQL.format('lower(jd_text)')}) as kind from latest")
def job_types(spark, sf):
    """The type of job that an advert names, in its title or else in its text; null if it names none."""
    def of(c: str) -> Column:
        chain = None
        for name, pattern in JOB_TYPES.items():
            hit = F.regexp_like(F.lower(c), F.lit(rf"(^|[^a-z])({pattern})([^a-z]|$)"))
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain

    return latest_adverts(spark, sf).select("job_id", F.coalesce(of("role"), of("jd_text")).alias("kind"))


@query(f"""with {LATEST} select job_id, coalesce(lower(nullif(trim(role_level), '')), 'mid') as level, greatest(coalesce(years_required, 0), 0) as years, list_sort(list_distinct([lower(trim(x)) for x in coalesce(required_skills, []) if trim(x) != ''])) as required,
list_sort(list_distinct([lower(trim(x)) for x in coalesce(nice_to_have, []) if trim(x) != '' and not list_contains([lower(trim(y)) for y in coalesce(required_skills, []) if trim(y) != ''], lower(trim(x)))])) as nice from latest""")
def validated_parses(spark, sf):
    """Parses in valid form: no level is mid, no years are 0, nulls are empty lists, and what is required isn't nice to have too."""
    lower = lambda c: F.array_distinct(F.transform(F.coalesce(trimmed(c), F.array().cast("array<string>")), lambda x: F.lower(x)))
    j = latest_adverts(spark, sf)
    return j.select("job_id", F.coalesce(F.lower(F.nullif(F.trim("role_level"), F.lit(""))), F.lit("mid")).alias("level"), F.greatest(F.coalesce("years_required", F.lit(0)), F.lit(0)).alias("years"),
                    F.array_sort(lower("required_skills")).alias("required"), F.array_sort(F.array_except(lower("nice_to_have"), lower("required_skills"))).alias("nice"))
