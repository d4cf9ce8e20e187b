"""Line files in and out: logs with broken lines, last line of a key, atomic exports, appends that can be resumed."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.operators.relational import pick


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; broken lines are kept under `_corrupt_record`, all other fields null."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def last_of_key(log: DataFrame, key: str, order: Column) -> DataFrame:
    """The last good line of each key; lines without the key or that are broken don't count."""
    good = log.where(F.col(key).isNotNull())
    good = good.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in log.columns else good
    return pick(good, [key], order.desc())


def export_csv(df: DataFrame, path: str, limit_text: int = 300) -> None:
    """One CSV folder with a header; long texts are cut for display.

    It is written beside the old one and takes its place when it is whole; until then, and where it fails, the old one stands.
    """
    shown = [F.left(c, F.lit(limit_text)).alias(c) if t == "string" else F.array_join(c, ", ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.select(*shown).write.option("header", True).csv(fresh)
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    files = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if files.exists(target):
        files.rename(target, jvm.Path(old))
    if not files.rename(jvm.Path(fresh), target):
        files.rename(jvm.Path(old), target)
        raise OSError(f"{path} couldn't be replaced")
    files.delete(jvm.Path(old), True)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the folder lacks yet, so that a run that broke off can be repeated."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if there else df
    fresh.write.mode("append").parquet(path)


def exploded_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The comma-separated values of one column of a CSV file, counted."""
    values = spark.read.option("header", True).csv(path).select(F.explode(F.split(column, ",")).alias("v")).select(F.trim("v").alias("value")).where("value != ''")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def report(counts: DataFrame, title: str) -> str:
    """A short Markdown report of a one-row DataFrame."""
    row = counts.first()
    return "\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in (row.asDict() if row else {}).items()], ""])


def file_ranges(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, low, high, rows) of a numeric or text column in every Parquet file under `path`, from the footers alone.

    No data page is read: file names come from listing, footers are read in parallel by the workers. low and high are texts, null
    where a row group has no statistics. A range scan then reads only the files that may hold it (`files_between`).
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = list(spark.read.parquet(path).inputFiles()) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else []

    def footers(frames):
        for frame in frames:
            rows = []
            for name in frame["file"]:
                system, where = pa_fs.FileSystem.from_uri(name)
                meta = pq.read_metadata(where, filesystem=system)
                at = meta.schema.to_arrow_schema().get_field_index(column)
                stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                known = stats and all(x is not None and x.has_min_max for x in stats)
                rows.append((name, str(min(x.min for x in stats)) if known else None, str(max(x.max for x in stats)) if known else None, meta.num_rows))
            yield pd.DataFrame(rows, columns=["file", "low", "high", "rows"])

    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), 1000)))
    return listed.mapInPandas(footers, "file string, low string, high string, rows bigint")


def files_between(ranges: DataFrame, low: float, high: float) -> list[str]:
    """The files of `file_ranges` (of a numeric column) that may hold a value from low to high; files without statistics always may."""
    a, b = F.col("low").cast("double"), F.col("high").cast("double")
    return sorted(r["file"] for r in ranges.where(F.coalesce((a <= high) & (b >= low), F.lit(True))).collect())
