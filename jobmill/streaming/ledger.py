"""Incremental state over polls: a ledger of postings that a stream of poll results keeps up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEDGER = "board_id string, posting_id string, first_seen timestamp, last_seen timestamp, closed_at timestamp, times_seen long"


def apply_poll(ledger: DataFrame, listed: DataFrame, polls: DataFrame) -> DataFrame:
    """The ledger after a batch of polls, in any number per board.

    listed: board_id, posting_id, polled_at of what usable polls list. polls: board_id, polled_at, complete. Postings
    seen again reopen; an open posting is closed by the earliest complete poll after its last sight; polls that
    aren't complete close nothing. Late polls only widen what is known: first_seen can move back, last_seen never does.
    """
    seen = listed.groupBy("board_id", "posting_id").agg(F.min("polled_at").alias("n_first"), F.max("polled_at").alias("n_last"), F.count_distinct("polled_at").alias("n_times"))
    merged = ledger.join(seen, ["board_id", "posting_id"], "full_outer").select(
        "board_id", "posting_id", F.least("first_seen", "n_first").alias("first_seen"), F.greatest("last_seen", "n_last").alias("last_seen"),
        F.when(F.col("n_last").isNull() | (F.col("closed_at") > F.col("n_last")), F.col("closed_at")).alias("closed_at"), (F.coalesce("times_seen", F.lit(0)) + F.coalesce("n_times", F.lit(0))).alias("times_seen"),
    )
    ends = polls.where("complete").groupBy("board_id").agg(F.sort_array(F.collect_set("polled_at")).alias("ends"))
    after = F.get(F.filter("ends", lambda t: t > F.col("last_seen")), F.lit(0))
    closed = F.least("closed_at", after)
    return merged.join(ends, "board_id", "left").select("board_id", "posting_id", "first_seen", "last_seen", F.when(closed > F.col("last_seen"), closed).alias("closed_at"), F.col("times_seen").cast("long").alias("times_seen"))


def run_ledger(spark: SparkSession, source: DataFrame, folder: str) -> str:
    """Runs the ledger over a stream of poll rows (board_id, posting_id or null, polled_at, complete) until it is drained.

    Each micro-batch writes the next version of the ledger under `folder`; a batch that is run again after a failure
    reads the version before it and writes the same version, so that nothing is counted twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.distinct()
        old = spark.read.schema(LEDGER).parquet(f"{folder}/v={number - 1}") if number else spark.createDataFrame([], LEDGER)
        new = apply_poll(old, rows.where("posting_id is not null").select("board_id", "posting_id", "polled_at"), rows.select("board_id", "polled_at", "complete").distinct())
        new.write.mode("overwrite").parquet(f"{folder}/v={number}")

    stream = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    done = [p["batchId"] for p in stream.recentProgress if p["numInputRows"]]
    return f"{folder}/v={max(done)}" if done else folder


def latest_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of the last status of each key by event time: an older event never overwrites a newer one.

    events: key bigint, status string, ts timestamp. State is one small struct a key; updates are emitted as they
    change.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for pdf in frames:
            for ts, status in zip(pdf["ts"], pdf["status"]):
                candidate = (int(ts.value // 1000), status)
                if best is None or candidate > tuple(best):
                    best, changed = candidate, True
        if changed:
            state.update(tuple(best))
            yield pd.DataFrame({"key": [key[0]], "status": [best[1]], "ts_us": [best[0]]})

    return events.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(update, "key bigint, status string, ts_us bigint", "ts_us bigint, status string", "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tumbling days with late rows up to `delay`: (day, event_type, n)."""
    days = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def without_repeats(rows: DataFrame, keys: list[str], delay: str = "60 days") -> DataFrame:
    """A stream without repeats of its keys within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
