"""Queries over the board lists as sources, and streams drained to a result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.functions.html import html_text
from jobmill.functions.text import posting_id, squeeze
from jobmill.session import ensure_checkpoint_dir, table
from jobmill.sources.files import file_ranges
from jobmill.streaming.ledger import daily_counts, run_ledger

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def postings_unified(spark: SparkSession, sf: str) -> DataFrame:
    """The four list tables in one schema, one row for each posting: as the latest load lists it (of several rows the greatest title)."""
    g, l, a, s = (table(spark, sf, f"{n}_list") for n in ("greenhouse", "lever", "ashby", "smartrecruiters"))  # noqa: E741
    frames = [
        g.select(F.lit("greenhouse").alias("ats"), "board_id", "poll_no", posting_id("id").alias("posting_id"), F.col("title"), F.col("location.name").alias("location")),
        l.select(F.lit("lever").alias("ats"), "board_id", "poll_no", posting_id("id").alias("posting_id"), F.col("text").alias("title"), F.col("categories.location").alias("location")),
        a.where("islisted is null or islisted").select(F.lit("ashby").alias("ats"), "board_id", "poll_no", posting_id("id").alias("posting_id"), "title", "location"),
        s.select(F.lit("smartrecruiters").alias("ats"), "board_id", "poll_no", posting_id("id").alias("posting_id"), F.col("name").alias("title"), F.coalesce("location.fulllocation", "location.city").alias("location")),
    ]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3]).where("posting_id is not null")
    one = F.struct(squeeze("title").alias("title"), squeeze("location").alias("location"))
    best = rows.groupBy("ats", "posting_id").agg(F.max("poll_no").alias("last_poll"), F.max_by(one, F.struct("poll_no", F.coalesce("title", F.lit("")), F.coalesce("location", F.lit("")))).alias("l"), F.count_distinct("poll_no").alias("polls"))
    return best.select("ats", "posting_id", "last_poll", "l.title", "l.location", "polls")


ORACLE["postings_unified"] = r"""
with r as (select 'greenhouse' as ats, poll_no, cast(id as varchar) as posting_id, title, location.name as location from greenhouse_list
union all select 'lever', poll_no, lower(trim(id)), text, categories.location from lever_list
union all select 'ashby', poll_no, lower(trim(id)), title, location from ashby_list where islisted is null or islisted
union all select 'smartrecruiters', poll_no, lower(trim(id)), name, coalesce(location.fulllocation, location.city) from smartrecruiters_list),
n as (select ats, posting_id, count(distinct poll_no) as polls from r where posting_id is not null group by 1, 2),
l as (select * from r where posting_id is not null qualify row_number() over (partition by ats, posting_id order by poll_no desc, coalesce(title, '') desc, coalesce(location, '') desc) = 1)
select ats, posting_id, poll_no as last_poll, trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) as title, trim(regexp_replace(location, '[\s\x{00A0}]+', ' ', 'g')) as location, polls from l join n using (ats, posting_id)"""


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """The adverts' HTML as text, each distinct body once."""
    bodies = table(spark, sf, "greenhouse_list").where("content is not null").groupBy(posting_id("id").alias("posting_id"), "content").agg(F.max("poll_no").alias("poll_no"))
    return bodies.select("posting_id", "poll_no", html_text("content").alias("text"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A field of JSON texts, counted."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


ORACLE["json_props"] = "select try_cast(json_extract_string(props, '$.k') as int) as k, count(*) as n, round(sum(value), 2) as total from events group by 1"


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day from the events read as a stream; the same rows as a batch gives."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    q = daily_counts(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("day", "event_type").agg(F.max_by("n", "b").alias("n"))


ORACLE["stream_daily_counts"] = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2"


def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of greenhouse postings, kept by a stream of poll rows."""
    folder = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    polls = table(spark, sf, "list_polls").where("not not_modified and error_text is null and ats = 'greenhouse'").select("poll_no", "board_id", "polled_at", "complete").distinct()
    rows = table(spark, sf, "greenhouse_list").select("poll_no", posting_id("id").alias("posting_id")).distinct()
    polls.join(rows, "poll_no", "left").select("board_id", "posting_id", "polled_at", "complete").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("board_id string, posting_id string, polled_at timestamp, complete boolean").parquet(f"{folder}/in")
    last = spark.read.parquet(run_ledger(spark, source, f"{folder}/ledger"))
    return last.select("board_id", "posting_id", "times_seen", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.unix_micros("closed_at").alias("closed_us"))


ORACLE["stream_ledger"] = """
with p as (select distinct poll_no, board_id, epoch_us(polled_at) as t_us, complete from list_polls where not not_modified and error_text is null and ats = 'greenhouse'),
l as (select distinct p.board_id, p.t_us, cast(g.id as varchar) as posting_id from p join greenhouse_list g using (poll_no)), s as (select board_id, posting_id, count(distinct t_us) as times_seen, min(t_us) as first_us, max(t_us) as last_us from l group by 1, 2)
select s.*, (select min(t_us) from p where p.complete and p.board_id = s.board_id and p.t_us > s.last_us) as closed_us from s"""

def footer_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The range of a key and the number of rows as the files' footers say."""
    r = file_ranges(spark, f"{sf}/lineitem.parquet", "l_orderkey")
    return r.agg(F.min(F.col("low").cast("bigint")).alias("low"), F.max(F.col("high").cast("bigint")).alias("high"), F.sum("rows").alias("rows"))


ORACLE["footer_ranges"] = "select min(l_orderkey) as low, max(l_orderkey) as high, count(*) as rows from lineitem"

QUERIES |= {f.__name__: f for f in (postings_unified, html_to_text, json_props, stream_daily_counts, stream_ledger, footer_ranges)}
