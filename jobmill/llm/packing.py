"""Filling containers of fixed capacity with items of varying size.

Bounded-space online packing: each partition keeps a fixed number of open windows, puts every item into the fullest
window that still takes it, and closes the fullest one when none does. Only the windows left open at the end are
merged across partitions, fullest first. Only an item above the capacity is cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.tokenizer import DEFAULT_PATH, encoder, ship_vocabulary
from jobmill.session import cut

CAPACITY = 2048
OPEN_WINDOWS = 64  #: windows that a partition keeps open
MERGED_AT_ONCE = 50_000  #: about the most left-over windows that one task of the merge takes


class Windows:
    """The open windows of one partition, ordered by the room they have left; `closed` names those closed since last asked."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.open: list[tuple[int, int]] = []  # (room, id), ascending
        self.closed: list[int] = []

    def place(self, size: int) -> int:
        """The window that an item of `size` (at most the capacity) goes to; the fullest is closed where none fits."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.closed.append(self.open.pop(0)[1])
            room, window = self.capacity, self.next_id
            self.next_id += 1
        if room > size:
            insort(self.open, (room - size, window))
        else:
            self.closed.append(window)
        return window


def pieces(size: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece_no, from, to) of an item: one piece, or capacity-sized ones and a rest where it exceeds the capacity."""
    if size <= capacity:
        yield 0, 0, size
        return
    for n, start in enumerate(range(0, size, capacity)):
        yield n, start, min(start + capacity, size)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row for each piece of an item: `container` (bigint), key, `piece_no`, `part_from`, `part_to`.

    items: `key` and `size` (int, in units of the capacity). A null or negative size counts as 0; items of size 0 are
    placed too; repeated rows are items of their own; an empty table gives no rows. No container holds more than
    the capacity. Sizes are placed where they lie (no shuffle). A window's pieces are held until it closes, so that those of
    closed windows are final; the placements are written once to the shared checkpoint folder. Only the pieces of the windows
    left open at a partition's end (at most open_windows of them) are shuffled, to join the containers these are merged into.
    Items of size 0 go to a window that has closed, or else to the partition's first.
    """
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        windows, final = Windows(capacity, open_windows, first + 1), first
        held: dict[int, list[tuple]] = {}
        key_type = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), key_type, pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], ["window", key, "piece_no", "part_from", "part_to", "left"])

        for batch in batches:
            key_type, done = batch.column(0).type, []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece, start, end in pieces(max(s or 0, 0), capacity):
                    if start == end:
                        done.append((final, k, piece, start, end, final == first))
                        continue
                    held.setdefault(windows.place(end - start), []).append((k, piece, start, end))
                    for window in windows.closed:
                        done += [(window, *row, False) for row in held.pop(window)]
                        final = window
                    windows.closed.clear()
            if done:
                yield table(done)
        for window, rows in held.items():
            yield table([(window, *row, True) for row in rows])

    placed = cut(items.select(key, size).mapInArrow(run, f"window bigint, `{key}` {kind}, piece_no int, part_from int, part_to int, left boolean"))
    loose = placed.where("left")
    moved = _merge(loose.groupBy("window").agg(F.sum(F.col("part_to") - F.col("part_from")).alias("used")), capacity, open_windows)
    joined = loose.join(moved, "window", "left").withColumn("window", F.coalesce("container", "window")).drop("container")
    return placed.where("not left").unionByName(joined).select(F.col("window").alias("container"), key, "piece_no", "part_from", "part_to")


def merge_tasks(windows: int) -> int:
    """How many tasks merge so many left-over windows."""
    return max(1, -(-windows // MERGED_AT_ONCE))


def _merge(rest: DataFrame, capacity: int, open_windows: int) -> DataFrame:
    """(window, container) of the left-over windows: each task packs about MERGED_AT_ONCE of them as items, the fullest first,
    with the same number of open bins as a partition of the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        pairs.sort(key=lambda p: (-p[1], p[0]))
        bins, name, out = Windows(capacity, open_windows, 0), {}, []
        for window, used in pairs:
            out.append((window, name.setdefault(bins.place(used), window)))
        table = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["window", "container"])

    rest = cut(rest)
    return rest.repartition(merge_tasks(rest.count())).mapInArrow(run, "window bigint, container bigint")


def token_counts(df: DataFrame, key: str, text: str, path: str = DEFAULT_PATH) -> DataFrame:
    """`key` and `n_tokens` of every row; null and empty texts have 0."""
    ship_vocabulary(df.sparkSession, path)
    schema = df.select(key).schema.add("n_tokens", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)
