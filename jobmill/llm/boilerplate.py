"""Lines repeated across one source's documents: found, and removed from each document."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.session import cut

LEAST_DOCUMENTS = 5  #: a line is boilerplate from so many documents of a source on
HOT = 50_000  #: a line in more places than this is matched by broadcast
LINE_MEMO = 50_000  #: lines whose key a worker remembers


def line_key(line: str) -> str:
    """The letters of a line, without case, accents, width or HTML escaping; empty if it has none."""
    while "&" in line and (plain := html.unescape(line)) != line:
        line = plain
    if line.isascii():
        return "".join(filter(str.isalpha, line)).lower()
    letters = "".join(c for c in line if c.isalpha() or unicodedata.category(c)[0] == "M")
    folded = unicodedata.normalize("NFKD", letters).casefold()
    return "".join(filter(str.isalpha, unicodedata.normalize("NFKD", folded)))


def lines(df: DataFrame, source: str, document: str, text: str, published: str | None = None) -> DataFrame:
    """(document, line_no, line_id, text_id[, day]) of every line with a letter.

    `line_id` is a 128-bit digest of source and line key, `text_id` one of source and all the text's line keys, so that it is the
    same for every copy of a text in its source; `day` is the day of `published`. Rows with a null source, id or text
    give no lines. The texts themselves are never shuffled.
    """
    sub = df.select(F.col(source).alias("source"), F.col(document).alias("document"), F.col(text).alias("text"), *([F.to_date(published).alias("day")] if published else [])).dropna(subset=["source", "document", "text"])
    kind = sub.schema["document"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], bytes | None] = {}
        for batch in batches:
            index, numbers, ids, whole = [], [], [], []
            for n, (src, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                start, own = len(ids), blake2b(digest_size=16)
                for k, line in enumerate(body.split("\n"), 1):
                    at = (src, line)
                    if at not in memo:
                        if len(memo) >= LINE_MEMO:
                            memo.clear()
                        key = line_key(line)
                        memo[at] = blake2b(f"{src}\0{key}".encode("utf-8", "surrogatepass"), digest_size=16).digest() if key else None
                    if (digest := memo[at]) is not None:
                        index.append(n)
                        numbers.append(k)
                        ids.append(digest)
                        own.update(digest)
                whole += [own.digest()] * (len(ids) - start)
            at = pa.array(index, pa.int64())
            columns = {"document": batch.column(1).take(at), "line_no": pa.array(numbers, pa.int32()), "line_id": pa.array(ids, pa.binary()), "text_id": pa.array(whole, pa.binary())}
            if published:
                columns["day"] = batch.column(3).take(at)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return sub.mapInArrow(run, f"document {kind}, line_no int, line_id binary, text_id binary" + (", day date" if published else ""))


def repeated_lines(df: DataFrame, source: str, document: str, text: str, least: int = LEAST_DOCUMENTS, by_text: bool = False, published: str | None = None, least_days: int = 1) -> DataFrame:
    """(document, line_no) of every line that stands in `least` or more different documents of its source.

    Lines are the parts of the text between line feeds, counted from 1. They are the same if their letters are,
    regardless of case, accents, width, HTML escaping and everything that isn't a letter; lines without a letter
    never count. Copies collapse before anything is counted: rows with the same id are one document, whatever their texts;
    with `by_text` a document is a text instead (all rows of a source whose lines have the same letters), so that an article
    republished under many ids counts once. With `published` the line must also stand on `least_days` different days; rows
    without a date count for no day. Null sources, ids and texts give nothing; no row comes twice.

    The lines go once to the shared checkpoint folder as digests. Documents are counted in two steps, first distinct
    (line, document), then by line, so that no line's documents meet in one task. Lines with more than HOT documents
    are matched by broadcast (there are at most lines / HOT of them), all others by a join in which no key has more
    than HOT documents.
    """
    found = cut(lines(df, source, document, text, published))
    counted = found.groupBy("line_id", F.col("text_id" if by_text else "document").alias("unit")).agg(F.count(F.lit(1)).alias("places")).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.sum("places").alias("places"))
    counted = counted.where(F.col("n") >= least)
    if published:
        days = found.where("day is not null").groupBy("line_id", "day").agg(F.lit(1).alias("one")).groupBy("line_id").agg(F.count("one").alias("days"))
        counted = counted.join(days.where(F.col("days") >= least_days).select("line_id"), "line_id", "left_semi")
    counted = cut(counted)
    hot = F.broadcast(counted.where(F.col("places") > HOT).select("line_id"))
    cold = counted.where(F.col("places") <= HOT).select("line_id")
    rest = found.join(hot, "line_id", "left_anti")
    cases = found.join(hot, "line_id", "left_semi").unionByName(rest.join(cold, "line_id", "left_semi"))
    return cases.select("document", "line_no").distinct()


def without_repeated_lines(df: DataFrame, source: str, document: str, text: str, least: int = LEAST_DOCUMENTS, cleaned: str = "clean_text", **how) -> DataFrame:
    """`df` with the column `cleaned`: the text without its repeated lines; null texts stay null.

    A document is judged by its id: rows that share an id but not the text are cut by the line's number in the text it
    was found in, so each row keeps a line only if no row of that id has a repeated line of the same letters there. `how`:
    `by_text`, `published` and `least_days` of `repeated_lines`.
    """
    cases = repeated_lines(df, source, document, text, least, **how)
    dropped = cases.groupBy(F.col("document").alias("__document")).agg(F.collect_set("line_no").alias("__dropped"))
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.coalesce("__dropped", F.array().cast("array<int>")), (i + 1).cast("int")))
    return df.join(dropped, F.col(document) == F.col("__document"), "left").withColumn(cleaned, F.array_join(kept, "\n")).drop("__document", "__dropped")
