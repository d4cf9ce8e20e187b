"""Queries of the nested-record, snapshot and time problems over the posting lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from jobmill.functions.text import blank_to_null, html_item, html_items, posting_id, squeeze
from jobmill.operators.nested import conform, flatten, infer_shapes, merged_type
from jobmill.operators.snapshots import change_events, number_snapshots
from jobmill.operators.timestamps import to_instants
from jobmill.session import table

KEYS = ["poll_no", "posting_id"]

def _postings(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, f"{name}_list").withColumn("posting_id", posting_id("id")).where("poll_no is not null and posting_id is not null")


def nested_column(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with `column` in its merged type: as the table has it, or else, where it is null, from `raw` in whatever shape."""
    merged = merged_type(rows.schema[column].dataType, infer_shapes(rows.where(F.col(column).isNull()), "raw", column), column)
    own = _widened(F.col(column), merged)
    other = conform(F.when(F.col(column).isNull(), F.col("raw")), StructType([StructField(column, merged)]))[column]
    return rows.withColumn(column, F.coalesce(own, other))


def _widened(value: Column, kind: DataType) -> Column:
    """A value of the table's own type in its merged type: what only raw texts have is null."""
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _widened(x, kind.elementType)) if isinstance(kind.elementType, (ArrayType, StructType)) else value
    if not isinstance(kind, StructType):
        return value
    fields = [(F.lit(None).cast(f.dataType) if "array_of" in f.metadata else _widened(value[f.name], f.dataType)).alias(f.name) for f in kind]
    return F.when(value.isNotNull(), F.struct(*fields))


def lever_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """`lists` (one row a block) and `lists.content_items` (one row an element of a content array) of lever_list."""
    return flatten(nested_column(_postings(spark, sf_dir, "lever").select(*KEYS, "lists", "raw"), "lists"), KEYS, "lists")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child rows of lever, ashby and smartrecruiters postings (TESTDATA.md, problem 4)."""
    lever = lever_tables(spark, sf_dir)
    rows = lever["lists"].where("content is not null").select(*KEYS, F.col("ordinal").alias("child_no"), F.posexplode(html_items("content")).alias("item_no", "item_text"))
    if "lists.content_items" in lever:
        arrays = lever["lists.content_items"].withColumn("item_text", html_item("value")).where("item_text is not null")
        arrays = arrays.groupBy(*KEYS, F.col("0_no").alias("child_no")).agg(F.sort_array(F.collect_set(F.struct("ordinal", "item_text"))).alias("items"))
        rows = rows.unionByName(arrays.select(*KEYS, "child_no", F.posexplode("items").alias("item_no", "item")).select(*KEYS, "child_no", "item_no", F.col("item.item_text").alias("item_text")))

    ashby = nested_column(_postings(spark, sf_dir, "ashby").select(*KEYS, "secondarylocations", "raw"), "secondarylocations")
    named = flatten(ashby, KEYS, "secondarylocations", drop_element=lambda x: F.coalesce(squeeze(x["location"]) != "", F.lit(False)))["secondarylocations"]
    ashby_rows = named.select(*KEYS, F.col("ordinal").alias("child_no"), F.lit(0).alias("item_no"), squeeze("location").alias("item_text"))

    smart = nested_column(_postings(spark, sf_dir, "smartrecruiters").select(*KEYS, "location", "raw"), "location").select(*KEYS, F.col("location").alias("place"))
    parts = squeeze(F.concat_ws(", ", *[blank_to_null(F.col("place")[f]) for f in ("city", "region", "country")]))
    text = F.coalesce(blank_to_null(squeeze(F.col("place")["fulllocation"])), F.when(parts != "", parts))
    smart_rows = smart.select(*KEYS, F.lit(0).alias("child_no"), F.lit(0).alias("item_no"), text.alias("item_text")).where("item_text is not null")

    rows = rows.unionByName(ashby_rows).unionByName(smart_rows)
    return rows.select("poll_no", "posting_id", F.col("child_no").cast("int"), F.col("item_no").cast("int"), "item_text").distinct()


def usable_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board's usable polls in order of `polled_at` (ties: `poll_no`), with number and successor."""
    polls = table(spark, sf_dir, "list_polls").where("complete and not not_modified and error_text is null and polled_at is not null")
    once = polls.select("poll_no", "ats", "board_id", "polled_at").distinct()
    return number_snapshots(once, ["ats", "board_id"], [F.col("polled_at"), F.col("poll_no")], "poll_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed postings between a board's usable polls (TESTDATA.md, problem 5)."""
    polls = usable_polls(spark, sf_dir).select("ats", F.col("poll_no").alias("snapshot"), F.col("board_id").alias("board"), "seq", "next_snapshot")

    def listed(name: str, values: dict) -> DataFrame:
        rows = _postings(spark, sf_dir, name).select("poll_no", "posting_id", *[v.alias(k) for k, v in values.items()])
        once = rows.groupBy("poll_no", "posting_id").agg(*[F.max(k).alias(k) for k in values])
        return once.join(polls.where(F.col("ats") == name), F.col("poll_no") == F.col("snapshot"))

    updated = _updated_instants(spark, sf_dir)
    green = updated.join(polls.where("ats = 'greenhouse'"), F.col("poll_no") == F.col("snapshot"))
    lever = listed("lever", {"a": F.xxhash64(squeeze("text")), "b": F.xxhash64(squeeze("descriptionplain")), "a_known": F.col("text").isNotNull(), "b_known": F.col("descriptionplain").isNotNull()})
    lever = lever.withColumns({"a": F.when(F.col("a_known"), F.col("a")), "b": F.when(F.col("b_known"), F.col("b"))})
    both = green.select("ats", "board", "posting_id", "seq", "snapshot", "next_snapshot", F.col("utc_ms").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(
        lever.select("ats", "board", "posting_id", "seq", "snapshot", "next_snapshot", "a", "b")
    )
    events = change_events(both, ["ats", "board", "posting_id"], ["a", "b"])
    return events.select(F.col("snapshot").alias("poll_no"), "posting_id", "change_kind").distinct()


def board_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ats_boards").where("board_id is not null").groupBy("board_id").agg(F.max("time_zone").alias("time_zone"))


def _updated_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each greenhouse posting's latest `updated_at` in a poll; null where none names an instant."""
    rows = _postings(spark, sf_dir, "greenhouse").select("poll_no", "posting_id", "board_id", "updated_at")
    timed = to_instants(rows, "updated_at", "board_id", board_zones(spark, sf_dir))
    return timed.groupBy("poll_no", "posting_id").agg(F.max("utc_ms").alias("utc_ms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every list row's time (TESTDATA.md, problem 6)."""
    columns = {"ashby": "publishedat", "lever": "createdat", "smartrecruiters": "releaseddate", "greenhouse": "first_published"}
    rows = None
    for ats, c in columns.items():
        part = _postings(spark, sf_dir, ats).select("poll_no", "posting_id", "board_id", F.col(c).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    timed = to_instants(rows.where("value is not null"), "value", "board_id", board_zones(spark, sf_dir))
    return timed.where("utc_ms is not null").select("poll_no", "posting_id", "utc_ms").distinct()


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found}

ORACLE = {
    "p5_found": r"""
with polls as (select distinct poll_no, ats, board_id, polled_at from list_polls where complete and not not_modified and error_text is null and polled_at is not null),
seqs as (select *, row_number() over w as seq, lead(poll_no) over w as next_poll from polls window w as (partition by ats, board_id order by polled_at, poll_no)),
green as (select poll_no, cast(id as varchar) as posting_id, max(case when regexp_full_match(trim(updated_at), '[0-9]{10}') then cast(trim(updated_at) as bigint) * 1000 else epoch_ms(try_strptime(regexp_replace(trim(updated_at), 'Z$', '+00:00'),
 ['%Y-%m-%dT%H:%M:%S%z', '%Y-%m-%dT%H:%M:%S.%g%z', '%Y-%m-%d %H:%M:%S %z', '%a, %d %b %Y %H:%M:%S %z'])) end) as a, null as b from greenhouse_list group by 1, 2),
lever as (select poll_no, lower(trim(id)) as posting_id, max(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) as a, max(trim(regexp_replace(descriptionplain, '[\s\x{00A0}]+', ' ', 'g'))) as b from lever_list where id is not null group by 1, 2),
rows_ as (select s.ats, s.board_id, g.posting_id, s.seq, s.poll_no, s.next_poll, cast(g.a as varchar) as a, cast(g.b as varchar) as b from green g join seqs s on s.poll_no = g.poll_no and s.ats = 'greenhouse'
 union all select s.ats, s.board_id, l.posting_id, s.seq, s.poll_no, s.next_poll, l.a, l.b from lever l join seqs s on s.poll_no = l.poll_no and s.ats = 'lever'),
w as (select *, lag(seq) over k as before_seq, lead(seq) over k as after_seq, lag(a) over k as old_a, lag(b) over k as old_b from rows_ window k as (partition by ats, board_id, posting_id order by seq))
select distinct * from (
 select poll_no, posting_id, 'added' as change_kind from w where seq > 1 and (before_seq is null or before_seq < seq - 1)
 union all select poll_no, posting_id, 'changed' from w where before_seq = seq - 1 and (coalesce(a != old_a, false) or coalesce(b != old_b, false))
 union all select next_poll, posting_id, 'removed' from w where next_poll is not null and (after_seq is null or after_seq > seq + 1))""",
}
