"""The board readers over bodies that are made from the posting lists: what goes in by a board's format comes out as postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.sources.boards import BOARDS, posted_relative, read_html, read_json, read_xml
from jobmill.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FIELDS = ("posting_id", "title", "location", "country", "posted", "company", "employment_type", "level")


def nested(values: dict[str, Column]) -> Column:
    """A struct with each value at its JSON path ("$.a.b", "$.a[0]")."""
    tree: dict = {}
    for path, value in values.items():
        *way, last = path.removeprefix("$.").split(".")
        here = tree
        for name in way:
            here = here.setdefault(name, {})
        here[last] = value

    def build(node) -> Column:
        if not isinstance(node, dict):
            return node
        return F.struct(*[(F.array(build(v)) if k.endswith("[0]") else build(v)).alias(k.removesuffix("[0]")) for k, v in node.items()])

    return build(tree)


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """What a posting of smartrecruiters_list says, under neutral names."""
    s = table(spark, sf, "smartrecruiters_list")
    return s.select("poll_no", "board_id", "id", F.col("name").alias("title"), F.col("location.city").alias("city"), F.col("location.region").alias("region"), F.col("location.country").alias("country"), F.col("location.fulllocation").alias("place"),
                    F.col("company.name").alias("company"), F.col("releaseddate").alias("posted"), F.col("typeofemployment.label").alias("kind"), F.col("experiencelevel.label").alias("level"))


def bodies_of(spark: SparkSession, sf: str, ats: str) -> DataFrame:
    """A JSON body for each poll of smartrecruiters_list in the format of the board type: ats, board_id, body."""
    b = BOARDS[ats]
    columns = {"id": b.id, "title": b.title, "country": b.country, "posted": b.posted, "company": b.company, "kind": b.kind, "level": b.level}
    values = {paths[0]: F.col(c) for c, paths in columns.items() if paths and not paths[0].startswith("$.location.")}
    if b.place:
        values[b.place[0]] = F.col("place")
    elif b.place_parts:
        values |= dict(zip(b.place_parts, map(F.col, ("city", "region", "country"))))
    elif b.more_places:
        values[b.more_places] = F.array(nested(dict(zip(b.more_paths, map(F.col, ("city", "region", "country"))))))
    rows = listed(spark, sf).select("poll_no", "board_id", nested(values).alias("p")).groupBy("poll_no", "board_id").agg(F.collect_list("p").alias("rows"))
    body = F.col("rows") if b.root == "$" else nested({b.root: F.col("rows")})
    return rows.select(F.lit(ats).alias("ats"), "board_id", F.to_json(body).alias("body"))


def _sql(ats: str) -> str:
    b = BOARDS[ats]
    text = lambda c: f"nullif(trim({c}), '')"
    parts = "nullif(concat_ws(', ', " + ", ".join(map(text, ("location.city", "location.region", "location.country"))) + "), '')"
    place = text("location.fulllocation") if b.place else parts
    said = {"posting_id": "id", "title": "name", "country": "location.country", "posted": "releaseddate", "company": "company.name", "employment_type": "typeofemployment.label", "level": "experiencelevel.label"}
    paths = {"posting_id": b.id, "title": b.title, "country": b.country, "posted": b.posted, "company": b.company, "employment_type": b.kind, "level": b.level}
    known = {k: paths[k] and (not paths[k][0].startswith("$.location.") or paths[k][0] in b.place_parts) for k in paths}
    columns = ", ".join([f"coalesce({place}, '') as location"] + [f"{text(said[k]) if known[k] else 'null'} as {k}" for k in said])
    return f"select board_id, {columns} from smartrecruiters_list where {text('id')} is not null"


def _reader(ats: str):
    def read(spark: SparkSession, sf: str) -> DataFrame:
        return read_json(bodies_of(spark, sf, ats), ats).select("board_id", *FIELDS)

    read.__doc__ = f"The postings of smartrecruiters_list, written in the format of {ats} and read back by its reader."
    return read


for _ats in BOARDS:
    if _ats not in ("greenhouse", "lever", "ashby", "smartrecruiters"):
        QUERIES[f"board_{_ats}"] = _reader(_ats)
        ORACLE[f"board_{_ats}"] = _sql(_ats)


def _bodies(rows: DataFrame, ats: str, root: str | None, posting: Column) -> DataFrame:
    """A body for each poll of a list table."""
    grouped = rows.select("poll_no", "board_id", posting.alias("p")).groupBy("poll_no", "board_id").agg(F.collect_list("p").alias("rows"))
    return grouped.select(F.lit(ats).alias("ats"), "board_id", F.to_json(nested({root: F.col("rows")}) if root else F.col("rows")).alias("body"))


def board_greenhouse(spark: SparkSession, sf: str) -> DataFrame:
    """greenhouse_list as its bodies, read back; remote only where the place says so."""
    g = table(spark, sf, "greenhouse_list")
    bodies = _bodies(g, "greenhouse", "$.jobs", F.struct("id", "title", "company_name", "location", "absolute_url", "first_published", "updated_at", "content"))
    return read_json(bodies, "greenhouse").select("board_id", "posting_id", "title", "location", "remote", "posted", "url", "company")


ORACLE["board_greenhouse"] = r"""
select board_id, cast(id as varchar) as posting_id, nullif(trim(title), '') as title, coalesce(nullif(trim(location.name), ''), '') as location,
case when regexp_matches(lower(trim(location.name)), '\bremote\b') then true when regexp_matches(lower(trim(location.name)), '^(on-?site|hybrid)$') then false end as remote,
nullif(trim(first_published), '') as posted, nullif(trim(absolute_url), '') as url, nullif(trim(company_name), '') as company from greenhouse_list where id is not null"""


def board_lever(spark: SparkSession, sf: str) -> DataFrame:
    """lever_list as its bodies, read back; all its places, and the workplace as a remote flag."""
    rows = table(spark, sf, "lever_list")
    c = F.col("categories")
    where = F.when(c.isNotNull(), F.struct(c["commitment"].alias("commitment"), c["location"].alias("location"), c["alllocations"].alias("allLocations"), c["team"].alias("team")))
    posting = F.struct("id", "text", where.alias("categories"), "country", F.col("workplacetype").alias("workplaceType"), F.col("createdat").alias("createdAt"), F.col("hostedurl").alias("hostedUrl"), F.col("applyurl").alias("applyUrl"), F.col("descriptionplain").alias("descriptionPlain"))
    return read_json(_bodies(rows, "lever", None, posting), "lever").select("board_id", "posting_id", "title", "location", "country", "remote", "posted", "url", "employment_type", F.col("description").isNotNull().alias("described"))


ORACLE["board_lever"] = r"""
select board_id, nullif(trim(id), '') as posting_id, nullif(trim(text), '') as title,
array_to_string(list_transform(list_filter(list_transform(list_filter(list_zip(ps, range(len(ps))), lambda x: x[1] is not null and x[1] != '' and list_position(ps, x[1]) = x[2] + 1), lambda x: x[1]), lambda x: true), lambda x: x), ' / ') as location,
nullif(trim(country), '') as country, case when regexp_matches(lower(trim(workplacetype)), '\bremote\b') then true when regexp_matches(lower(trim(workplacetype)), '^(on-?site|hybrid)$') then false end as remote,
nullif(trim(createdat), '') as posted, coalesce(nullif(trim(hostedurl), ''), nullif(trim(applyurl), '')) as url, nullif(trim(categories.commitment), '') as employment_type, nullif(trim(descriptionplain), '') is not null as described
from (select *, list_concat([nullif(trim(categories.location), '')], list_transform(coalesce(categories.alllocations, []), lambda x: nullif(trim(x), ''))) as ps from lever_list) where nullif(trim(id), '') is not null"""


def board_ashby(spark: SparkSession, sf: str) -> DataFrame:
    """ashby_list as its bodies, read back; unlisted postings are left out, and the remote flag goes before the workplace."""
    rows = table(spark, sf, "ashby_list")
    a = F.col("address.postaladdress.addresscountry")
    address = F.when(a.isNotNull(), F.struct(F.struct(a.alias("addressCountry")).alias("postalAddress")))
    posting = F.struct("id", "title", F.col("employmenttype").alias("employmentType"), "location", F.col("publishedat").alias("publishedAt"), F.col("islisted").alias("isListed"), F.col("isremote").alias("isRemote"), F.col("workplacetype").alias("workplaceType"), address.alias("address"), F.col("joburl").alias("jobUrl"))
    return read_json(_bodies(rows, "ashby", "$.jobs", posting), "ashby").select("board_id", "posting_id", "title", "location", "country", "remote", "posted", "url", "employment_type")


ORACLE["board_ashby"] = r"""
select board_id, nullif(trim(id), '') as posting_id, nullif(trim(title), '') as title, coalesce(nullif(trim(location), ''), '') as location, nullif(trim(address.postaladdress.addresscountry), '') as country,
case when isremote then true else coalesce(case when regexp_matches(lower(trim(workplacetype)), '\bremote\b') then true when regexp_matches(lower(trim(workplacetype)), '^(on-?site|hybrid)$') then false end, isremote) end as remote,
nullif(trim(publishedat), '') as posted, nullif(trim(joburl), '') as url, nullif(trim(employmenttype), '') as employment_type from ashby_list where nullif(trim(id), '') is not null and (islisted is null or islisted)"""


def board_smartrecruiters(spark: SparkSession, sf: str) -> DataFrame:
    """smartrecruiters_list as its bodies, read back; the full place, or else its parts."""
    place = F.col("location")
    where = F.when(place.isNotNull(), F.struct(*[place[c].alias(c) for c in ("city", "region", "country", "remote")], place["fulllocation"].alias("fullLocation")))
    posting = F.struct("id", "name", "company", F.col("releaseddate").alias("releasedDate"), where.alias("location"), F.col("typeofemployment").alias("typeOfEmployment"), F.col("experiencelevel").alias("experienceLevel"))
    return read_json(_bodies(table(spark, sf, "smartrecruiters_list"), "smartrecruiters", "$.content", posting), "smartrecruiters").select("board_id", "posting_id", "title", "location", "country", "remote", "posted", "url", "company", "employment_type", "level")


ORACLE["board_smartrecruiters"] = r"""
select board_id, nullif(trim(id), '') as posting_id, nullif(trim(name), '') as title, coalesce(nullif(trim(location.fulllocation), ''), nullif(concat_ws(', ', nullif(trim(location.city), ''), nullif(trim(location.region), ''), nullif(trim(location.country), '')), ''), '') as location,
nullif(trim(location.country), '') as country, location.remote as remote, nullif(trim(releaseddate), '') as posted, 'https://jobs.smartrecruiters.com/' || board_id || '/' || trim(id) as url, nullif(trim(company.name), '') as company,
nullif(trim(typeofemployment.label), '') as employment_type, nullif(trim(experiencelevel.label), '') as level from smartrecruiters_list where nullif(trim(id), '') is not null"""


def _escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def board_xmlfeed(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of smartrecruiters_list as XML feeds, read back."""
    tags = {"referencenumber": "id", "title": "title", "city": "city", "state": "region", "country": "country", "date": "posted", "company": "company", "jobtype": "kind"}
    job = F.concat(F.lit("<job>"), *[F.concat(F.lit(f"<{t}>"), _escaped(F.col(c)), F.lit(f"</{t}>")) for t, c in tags.items()], F.lit("</job>"))
    feeds = listed(spark, sf).select("poll_no", "board_id", job.alias("j")).groupBy("poll_no", "board_id").agg(F.concat(F.lit("<source>"), F.array_join(F.collect_list("j"), ""), F.lit("</source>")).alias("body"))
    return read_xml(feeds.select(F.lit("xmlfeed").alias("ats"), "board_id", "body")).select("board_id", "posting_id", "title", "location", "country", "posted", "company", "employment_type")


ORACLE["board_xmlfeed"] = """
select board_id, nullif(trim(id), '') as posting_id, nullif(trim(name), '') as title, nullif(concat_ws(', ', nullif(trim(location.city), ''), nullif(trim(location.region), ''), nullif(trim(location.country), '')), '') as location,
nullif(trim(location.country), '') as country, nullif(trim(releaseddate), '') as posted, nullif(trim(company.name), '') as company, nullif(trim(typeofemployment.label), '') as employment_type from smartrecruiters_list where nullif(trim(id), '') is not null"""


def board_avature(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of greenhouse_list as HTML result pages, read back: one row for each posting of a board."""
    link = F.concat(F.lit('<li><a class="x" href="/careers/JobDetail/a/'), F.col("id").cast("string"), F.lit('">'), _escaped(F.col("title")), F.lit("</a></li>"))
    g = table(spark, sf, "greenhouse_list").where("id is not null and trim(title) != ''").groupBy("board_id", "id").agg(F.max("title").alias("title"))
    pages = g.groupBy("board_id").agg(F.array_join(F.collect_list(link), "\n").alias("body"))
    return read_html(pages.select(F.lit("avature").alias("ats"), "board_id", "body")).select("board_id", "posting_id", F.col("url").alias("link"))


ORACLE["board_avature"] = """
select board_id, cast(id as varchar) as posting_id, '/careers/JobDetail/a/' || cast(id as varchar) as link from greenhouse_list where id is not null and trim(title) != '' group by 1, 2, 3"""


def relative_dates(spark: SparkSession, sf: str) -> DataFrame:
    """"Posted 3 Days Ago" and its like as times before the poll that saw them."""
    p = table(spark, sf, "list_polls").where("polled_at is not null").select("poll_no", "polled_at", F.pmod("n_listed", F.lit(35)).alias("n")).distinct()
    said = F.when(F.col("n") == 0, "Posted Today").when(F.col("n") == 1, "Posted Yesterday").when(F.col("n") >= 30, "Posted 30+ Days Ago").when(F.col("n").isNotNull(), F.concat(F.lit("Posted "), F.col("n").cast("string"), F.lit(" Days Ago")))
    return p.select("poll_no", said.alias("said"), F.unix_micros(posted_relative(said, F.col("polled_at"))).alias("posted_us"))


ORACLE["relative_dates"] = """
with p as (select distinct poll_no, polled_at, n_listed % 35 as n from list_polls where polled_at is not null)
select poll_no, case when n = 0 then 'Posted Today' when n = 1 then 'Posted Yesterday' when n >= 30 then 'Posted 30+ Days Ago' when n is not null then 'Posted ' || n || ' Days Ago' end as said,
epoch_us(polled_at) - case when n >= 30 then 31 else n end * 86400000000 as posted_us from p"""

QUERIES |= {f.__name__: f for f in (board_greenhouse, board_lever, board_ashby, board_smartrecruiters, board_xmlfeed, board_avature, relative_dates)}
