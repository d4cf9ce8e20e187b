"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_snapshots(snapshots: DataFrame, owner: list[str], order: list[Column], snapshot: str) -> DataFrame:
    """Each owner's snapshots numbered from 1 in `order`, with the next one's id (`next_snapshot`, null for the last)."""
    w = Window.partitionBy(*owner).orderBy(*order)
    return snapshots.withColumns({"seq": F.row_number().over(w), "next_snapshot": F.lead(snapshot).over(w)})


def intervals(rows: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """Validity intervals of each key's versions: gaps and islands over the snapshot numbers.

    `rows` has one row for each key and snapshot it is listed in, with `seq`, `snapshot` and `next_snapshot` of
    `number_snapshots`. A new interval starts where the key was absent in the number before, or where a compared
    column differs from it (a null on either side is no difference). Columns: key, `from_seq`, `to_seq`,
    `snapshot` (the id of the first), `next_snapshot` (the id after the last, null at the end) and `opened_by`
    (`added` or `changed`). One shuffle, on the key.
    """
    w = Window.partitionBy(*key).orderBy("seq")
    before = F.lag("seq").over(w)
    differs = F.lit(False)
    for c in compared:
        differs = differs | F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False))
    opened = F.when(before.isNull() | (before < F.col("seq") - 1), "added").when(differs, "changed")
    island = F.count("opened_by").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("opened_by", opened)
        .withColumn("island", island)
        .groupBy(*key, "island")
        .agg(
            F.min("seq").alias("from_seq"),
            F.max("seq").alias("to_seq"),
            F.min_by("snapshot", "seq").alias("snapshot"),
            F.max_by(F.struct("next_snapshot"), "seq")["next_snapshot"].alias("next_snapshot"),
            F.max("opened_by").alias("opened_by"),
        )
        .drop("island")
    )


def change_events(rows: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """Added, removed and changed keys between consecutive snapshots, from the validity intervals.

    Columns: key, `snapshot` (the later one's id), `change_kind`. Interval starts are `added` or `changed`; an
    interval's end is `removed` unless the next interval is adjacent or there is no later snapshot. The first
    snapshot of an owner gives no events; empty snapshots count, as they have a number. No shuffle beyond that of
    `intervals`.
    """
    w = Window.partitionBy(*key).orderBy("from_seq")
    starts = F.when((F.col("from_seq") > 1) | (F.col("opened_by") == "changed"), F.col("opened_by"))
    adjacent = F.coalesce(F.lead("from_seq").over(w) == F.col("to_seq") + 1, F.lit(False))
    ends = F.when(F.col("next_snapshot").isNotNull() & ~adjacent, "removed")
    both = F.array(
        F.struct(F.col("snapshot"), F.col("starts").alias("change_kind")),
        F.struct(F.col("next_snapshot").alias("snapshot"), F.col("ends").alias("change_kind")),
    )
    return (
        intervals(rows, key, compared)
        .withColumns({"starts": starts, "ends": ends})
        .select(*key, F.explode(both).alias("event"))
        .where("event.change_kind is not null")
        .select(*key, "event.snapshot", "event.change_kind")
    )
