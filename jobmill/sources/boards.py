"""Bodies of job boards (JSON, XML, HTML) into one posting schema.

Every board type is a declaration: where its array of postings lies and which paths each field is read from. The
bodies are parsed once as VARIANT and exploded in the JVM, so that a new type is a new declaration, not code.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.functions.html import html_text

POSTING = "ats string, board_id string, posting_id string, title string, location string, country string, remote boolean, posted string, url string, description string, company string, employment_type string, level string"


@dataclass(frozen=True)
class Board:
    """The declaration of one board type. Paths are alternatives in order; `{board}` and `{id}` stand in URLs."""

    root: str
    id: list[str]
    title: list[str]
    place: list[str] = field(default_factory=list)  #: alternatives
    place_parts: list[str] = field(default_factory=list)  #: joined by ", " where no alternative is given
    more_places: str | None = None  #: an array of further places
    more_paths: list[str] = field(default_factory=lambda: ["$"])  #: parts of each, joined by ", "
    country: list[str] = field(default_factory=list)
    remote_flag: list[str] = field(default_factory=list)  #: boolean paths
    workplace: list[str] = field(default_factory=list)  #: texts that say remote, onsite or hybrid
    posted: list[str] = field(default_factory=list)
    url: list[str] = field(default_factory=list)
    url_pattern: str | None = None
    html: list[str] = field(default_factory=list)  #: HTML parts of the description, joined
    plain: list[str] = field(default_factory=list)
    company: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    level: list[str] = field(default_factory=list)
    listed: str | None = None  #: a boolean path; false hides the posting
    blocks: str | None = None  #: an array of headed parts of the description
    block_paths: tuple[str, str] = ("$.text", "$.content")  #: heading and HTML of each
    owner: str | None = None  #: the path, from the body's root, of the company that all its postings have
    relative: bool = False  #: posted days are said as "Posted 3 Days Ago"


# The fields of each board type's public list format.
BOARDS = {
    "greenhouse": Board("$.jobs", ["$.id"], ["$.title"], ["$.location.name"], posted=["$.first_published"], url=["$.absolute_url"], html=["$.content"], company=["$.company_name"], workplace=["$.location.name"]),
    "lever": Board("$", ["$.id"], ["$.text"], ["$.categories.location"], more_places="$.categories.allLocations", country=["$.country"], workplace=["$.workplaceType"], posted=["$.createdAt"], url=["$.hostedUrl", "$.applyUrl"], plain=["$.descriptionPlain", "$.additionalPlain"], blocks="$.lists", kind=["$.categories.commitment"]),
    "ashby": Board("$.jobs", ["$.id"], ["$.title"], ["$.location"], more_places="$.secondaryLocations", more_paths=["$.location"], country=["$.address.postalAddress.addressCountry"], remote_flag=["$.isRemote"], workplace=["$.workplaceType"], posted=["$.publishedAt"], url=["$.jobUrl"], plain=["$.descriptionPlain"], html=["$.descriptionHtml"], kind=["$.employmentType"], listed="$.isListed"),
    "smartrecruiters": Board("$.content", ["$.id"], ["$.name"], ["$.location.fullLocation"], ["$.location.city", "$.location.region", "$.location.country"], country=["$.location.country"], remote_flag=["$.location.remote"], posted=["$.releasedDate"], url_pattern="https://jobs.smartrecruiters.com/{board}/{id}", company=["$.company.name"], kind=["$.typeOfEmployment.label"], level=["$.experienceLevel.label"]),
    "recruitee": Board("$.offers", ["$.id"], ["$.title"], ["$.location"], more_places="$.locations", more_paths=["$.name"], country=["$.country_code", "$.country"], remote_flag=["$.remote"], posted=["$.published_at", "$.created_at"], url=["$.careers_url"], html=["$.description", "$.requirements"], company=["$.company_name"], kind=["$.employment_type_code"]),
    "rippling": Board("$", ["$.uuid"], ["$.name"], ["$.workLocation.label"], workplace=["$.workLocation.label"], url=["$.url"]),
    "workable": Board("$.jobs", ["$.shortcode"], ["$.title"], [], ["$.city", "$.state", "$.country"], country=["$.country"], remote_flag=["$.telecommuting"], posted=["$.published_on"], url=["$.url"], kind=["$.employment_type"], owner="$.name"),
    "bamboohr": Board("$.result", ["$.id"], ["$.jobOpeningName"], [], ["$.location.city", "$.location.state", "$.atsLocation.country"], country=["$.atsLocation.country"], remote_flag=["$.isRemote"], url_pattern="https://{board}.bamboohr.com/careers/{id}", kind=["$.employmentType"]),
    "eightfold": Board("$.positions", ["$.id"], ["$.posting_name", "$.name"], ["$.location"], more_places="$.locations", workplace=["$.work_location_option"], posted=["$.t_create"], url=["$.canonicalPositionUrl"]),
    "oracle": Board("$.items[0].requisitionList", ["$.Id"], ["$.Title"], ["$.PrimaryLocation"], more_places="$.secondaryLocations", more_paths=["$.Name"], country=["$.PrimaryLocationCountry"], workplace=["$.WorkplaceType", "$.WorkplaceTypeCode"], posted=["$.PostedDate"], kind=["$.JobSchedule"]),
    "workday": Board("$.jobPostings", ["$.bulletFields[0]", "$.externalPath"], ["$.title"], ["$.locationsText"], workplace=["$.locationsText"], posted=["$.postedOn"], url=["$.externalPath"], relative=True),
    "amazon": Board("$.jobs", ["$.id_icims", "$.id"], ["$.title"], ["$.normalized_location", "$.location"], country=["$.country_code"], posted=["$.posted_date"], url=["$.job_path"], html=["$.description", "$.basic_qualifications", "$.preferred_qualifications"], company=["$.company_name"], kind=["$.job_schedule_type"]),
    "keka": Board("$", ["$.id"], ["$.title"], more_places="$.jobLocations", more_paths=["$.city", "$.state", "$.countryCode"], posted=["$.publishedOn"], url_pattern="https://{board}.keka.com/careers/jobdetails/{id}", html=["$.description"]),
    "successfactors": Board("$.jobSearchResult", ["$.response.id"], ["$.response.unifiedStandardTitle"], ["$.response.jobLocationShort[0]", "$.response.jobLocationShort", "$.response.custprimecity", "$.response.location"], posted=["$.response.unifiedStandardStart"]),
    "phenom": Board("$.refineSearch.data.jobs", ["$.jobId"], ["$.title"], ["$.location", "$.cityStateCountry"], country=["$.country"], posted=["$.postedDate"], url=["$.applyUrl"], kind=["$.type"]),
    "goldman": Board("$.data.roleSearch.items", ["$.externalSource.sourceId", "$.roleId"], ["$.jobTitle"], more_places="$.locations", more_paths=["$.city", "$.state", "$.country"], level=["$.corporateTitle"]),
}


def _text(of: str, *paths: str) -> Column:
    """The first path's text that isn't blank; a path whose first element is a path too holds no text where it is an array."""
    def one(p: str) -> Column:
        text = F.expr(f"nullif(trim(try_variant_get({of}, '{p}', 'string')), '')")
        return F.when(F.expr(f"try_variant_get({of}, '{p}', 'array<variant>')").isNull(), text) if f"{p}[0]" in paths else text

    return F.coalesce(F.lit(None).cast("string"), *map(one, paths))


def _joined(columns: list[Column], by: str) -> Column:
    return F.concat_ws(by, *columns)


def posted_relative(text: Column, now: Column) -> Column:
    """The time that "Posted Today", "Posted Yesterday", "Posted 3 Days Ago" or "30+ Days Ago" (a day more) mean, seen at `now`; else null."""
    t = F.lower(text)
    days = F.regexp_extract(t, r"(\d+)\+?\s+days?\s+ago", 1).try_cast("int") + F.when(F.contains(t, F.lit("+")), 1).otherwise(0)
    n = F.when(F.contains(t, F.lit("today")), 0).when(F.contains(t, F.lit("yesterday")), 1).otherwise(days)
    return now - F.make_dt_interval(n)


def read_json(bodies: DataFrame, ats: str) -> DataFrame:
    """The postings of the JSON bodies of one board type.

    bodies: ats, board_id, body; also polled_at where days are said relative to it ("Posted 3 Days Ago"). Texts that aren't JSON, roots of another shape, null bodies and postings without an
    id give no rows (see `bad_bodies`). Places are joined by " / " without repeats; remote is null where nothing is
    said; dates stay texts, for `to_instants`.
    """
    b = BOARDS[ats]
    at = F.col("polled_at") if "polled_at" in bodies.columns else F.lit(None).cast("timestamp")
    v = bodies.where(F.col("ats") == ats).select("board_id", at.alias("polled_at"), F.expr("try_parse_json(body)").alias("v"))
    owner = _text("v", b.owner) if b.owner else F.lit(None).cast("string")
    rows = v.select("board_id", "polled_at", owner.alias("owner"), F.explode_outer(F.expr(f"try_variant_get(v, '{b.root}', 'array<variant>')")).alias("j")).where("j is not null")
    main = _text("j", *b.place)
    if b.place_parts:
        parts = F.nullif(_joined([_text("j", p) for p in b.place_parts], ", "), F.lit(""))
        main = F.coalesce(main, parts)
    places = F.array(main)
    if b.more_places:
        more = F.expr(f"try_variant_get(j, '{b.more_places}', 'array<variant>')")
        part = lambda x: F.concat_ws(", ", *[F.nullif(F.trim(F.try_variant_get(x, p, "string")), F.lit("")) for p in b.more_paths])
        places = F.concat(places, F.coalesce(F.transform(more, part), F.array().cast("array<string>")))
    place = F.array_join(F.array_distinct(F.filter(places, lambda x: x.isNotNull() & (x != ""))), " / ")
    said = F.lower(_text("j", *b.workplace))
    remote = F.when(said.rlike(r"\bremote\b"), True).when(said.rlike("^(on-?site|hybrid)$"), False)
    if b.remote_flag:
        flag = F.coalesce(*[F.expr(f"try_variant_get(j, '{p}', 'boolean')") for p in b.remote_flag])
        remote = F.when(flag, True).otherwise(F.coalesce(remote, flag))
    posting = _text("j", *b.id)
    url = _text("j", *b.url)
    if b.url_pattern:
        url = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), kv[1]), [("{board}", F.col("board_id")), ("{id}", posting)], F.lit(b.url_pattern))
    texts = [_text("j", p) for p in b.plain]
    if b.blocks:
        array = F.expr(f"try_variant_get(j, '{b.blocks}', 'array<variant>')")
        heading, inner = (lambda x, p=p: F.coalesce(F.try_variant_get(x, p, "string"), F.lit("")) for p in b.block_paths)
        texts[1:1] = [html_text(F.array_join(F.transform(array, lambda x: F.concat(F.lit("<h3>"), heading(x), F.lit("</h3>"), inner(x))), "\n"))]
    plain = F.nullif(_joined(texts, "\n\n"), F.lit(""))
    posted = _text("j", *b.posted)
    if b.relative:
        posted = F.coalesce(F.date_format(posted_relative(posted, F.col("polled_at")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), posted)
    rich = F.nullif(_joined([html_text(_text("j", p)) for p in b.html], "\n\n"), F.lit("")) if b.html else F.lit(None).cast("string")
    out = rows.select(
        F.lit(ats).alias("ats"), "board_id", posting.alias("posting_id"), _text("j", *b.title).alias("title"), place.alias("location"), _text("j", *b.country).alias("country"),
        remote.alias("remote"), posted.alias("posted"), url.alias("url"), F.coalesce(plain, rich).alias("description"), F.coalesce(_text("j", *b.company), F.col("owner")).alias("company"),
        _text("j", *b.kind).alias("employment_type"), _text("j", *b.level).alias("level"), *([F.expr(f"try_variant_get(j, '{b.listed}', 'boolean')").alias("listed")] if b.listed else []),
    ).where("posting_id is not null")
    return out.where("listed is null or listed").drop("listed") if b.listed else out


def bad_bodies(bodies: DataFrame) -> DataFrame:
    """ats, board_id and reason of the bodies that can't be read: no JSON, or a root without the type's array."""
    v = bodies.withColumn("v", F.expr("try_parse_json(body)"))
    root = None
    for ats, b in BOARDS.items():
        here = F.expr(f"try_variant_get(v, '{b.root}', 'array<variant>')")
        root = F.when(F.col("ats") == ats, here) if root is None else root.when(F.col("ats") == ats, here)
    reason = F.when(F.col("body").isNull(), "empty").when(F.col("v").isNull(), "not_json").when(root.isNull(), "wrong_root")
    return v.where(F.col("ats").isin(list(BOARDS))).select("ats", "board_id", reason.alias("reason")).where("reason is not null")


def read_xml(bodies: DataFrame) -> DataFrame:
    """The postings of XML feeds with `job` elements."""
    names = ["referencenumber", "requisitionid", "apijobid", "id", "title", "city", "state", "country", "date", "pubDate", "url", "link", "description", "company", "jobtype"]
    schema = "job array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    jobs = bodies.where("ats = 'xmlfeed' and body is not null").select("board_id", F.explode(F.from_xml("body", schema)["job"]).alias("j"))
    first = lambda *n: F.coalesce(*[F.nullif(F.trim(F.col(f"j.{x}")), F.lit("")) for x in n])
    place = F.nullif(F.concat_ws(", ", *[first(x) for x in ("city", "state", "country")]), F.lit(""))
    return jobs.select(
        F.lit("xmlfeed").alias("ats"), "board_id", first("referencenumber", "requisitionid", "apijobid", "id").alias("posting_id"), first("title").alias("title"), place.alias("location"), first("country").alias("country"),
        F.lit(None).cast("boolean").alias("remote"), first("date", "pubDate").alias("posted"), first("url", "link").alias("url"), html_text(first("description")).alias("description"), first("company").alias("company"), first("jobtype").alias("employment_type"), F.lit(None).cast("string").alias("level"),
    ).where("posting_id is not null")


def read_html(bodies: DataFrame, link: str = r'<a[^>]+href="([^"]*/JobDetail/[^"]*?/(\d+))[^"]*"[^>]*>([\s\S]*?)</a>') -> DataFrame:
    """The postings of HTML result pages: anchors whose address ends in the posting's number, the first of each."""
    found = bodies.where("ats = 'avature' and body is not null").select("board_id", F.posexplode(F.regexp_extract_all("body", F.lit(link), F.lit(0))).alias("place", "a"))
    rows = found.select("board_id", "place", F.regexp_extract("a", link, 1).alias("url"), F.regexp_extract("a", link, 2).alias("posting_id"), html_text(F.regexp_extract("a", link, 3)).alias("title"))
    kept = rows.where("title is not null and lower(title) not in ('learn more', 'apply', 'view job')")
    first = kept.groupBy("board_id", "posting_id").agg(F.min_by(F.struct("url", "title"), "place").alias("f"))
    empty = {c: F.lit(None).cast("boolean" if c == "remote" else "string").alias(c) for c in ("location", "country", "remote", "posted", "description", "company", "employment_type", "level")}
    cols = ["location", "country", "remote", "posted"]
    return first.select(F.lit("avature").alias("ats"), "board_id", "posting_id", F.col("f.title").alias("title"), *[empty[c] for c in cols], F.col("f.url").alias("url"), *[empty[c] for c in ("description", "company", "employment_type", "level")])


def read_details(bodies: DataFrame) -> DataFrame:
    """What the page of a single posting says in its JSON-LD (type JobPosting, alone or in a list): posting_id, title, company, posted,
    location, employment_type, description. bodies: posting_id, body; pages without such data give nulls."""
    block = F.regexp_extract("body", r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    v = bodies.withColumn("b", block).select("posting_id", F.expr("try_parse_json(b)").alias("v"))
    one = v.select("posting_id", F.coalesce(F.expr("try_variant_get(v, '$[0]', 'variant')"), F.col("v")).alias("v"))
    place = lambda of: [_text("v", f"{of}.address.{x}") for x in ("addressLocality", "addressRegion", "addressCountry")]
    joined = lambda of: F.nullif(_joined(place(of), ", "), F.lit(""))
    return one.select("posting_id", _text("v", "$.title").alias("title"), F.coalesce(_text("v", "$.hiringOrganization.name"), F.when(F.expr("try_variant_get(v, '$.hiringOrganization', 'map<string,variant>')").isNull(), _text("v", "$.hiringOrganization"))).alias("company"), _text("v", "$.datePosted").alias("posted"),
                      F.coalesce(joined("$.jobLocation"), joined("$.jobLocation[0]")).alias("location"), _text("v", "$.employmentType").alias("employment_type"), html_text(_text("v", "$.description")).alias("description"))


def read_bodies(bodies: DataFrame) -> DataFrame:
    """The postings of all bodies, whatever their type.

    Each type reads its own rows alone: keep the bodies partitioned by `ats`, and no body is read twice.
    """
    frames = [read_json(bodies, ats) for ats in BOARDS] + [read_xml(bodies), read_html(bodies)]
    return reduce(DataFrame.unionByName, frames)
