"""Sorted files with a directory of their first keys and counts, so that a page opens the files that hold it and no others.

A view is written once in its order: a file is a range of the order, sorted, and the directory has for each file its number,
how many rows stand before it, how many it has, and its first and last keys. Row n of the view is row n - before of one file, so a page is the
rows at these places; a search by key opens the files whose keys surround it. Order as given, ties in the order of the last column, which tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a file, about.
ROWS = 100_000


def write(df: DataFrame, path: str, order: list[Column], key: Column, rows: int = ROWS) -> None:
    """The view and its directory below ``path``. key: the leading value of the order, for searches."""
    spark = df.sparkSession
    # a task writes many small files: with one for each, tasks and the sample of the order would grow with the files, and all of it goes to the driver
    n = max(1, -(-df.count() // max(rows, ROWS)))
    df.withColumn("_key", key).repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows).parquet(f"{path}/rows")
    files = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file"), *(F.regexp_extract("_metadata.file_name", p, 1).cast("int").alias(n) for n, p in (("part", r"^part-(\d+)"), ("piece", r"-c(\d+)\.")))).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_key", "_metadata.row_index").alias("first"), F.max_by("_key", "_metadata.row_index").alias("last")
    )
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    files.withColumn("before", before).coalesce(1).sortWithinPartitions("before").write.parquet(f"{path}/directory")


def directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/directory")


def _opened(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/rows").schema
    if not names:
        return spark.createDataFrame([], schema).withColumns({"file": F.lit(""), "at": F.lit(0).cast("long")})
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{f}" for f in names]).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """The rows of page ``number`` (from 0) of ``size`` rows, with ``place``, the row's number in the view from 1. Beyond the end: none."""
    first, end = number * size, (number + 1) * size
    found = directory(spark, path).filter((F.col("before") < end) & (F.col("before") + F.col("n") > first)).select("file", "before")
    opened = _opened(spark, path, [r.file for r in found.orderBy("before").collect()])  # a page is few files
    rows = opened.join(F.broadcast(found), "file").withColumn("place", F.col("before") + F.col("at") + 1)
    return rows.filter((F.col("place") > first) & (F.col("place") <= end)).drop("file", "before", "at", "_key")


def between(spark: SparkSession, path: str, low, high) -> DataFrame:
    """The rows whose key is from ``low`` to ``high``; of an ascending view, only files that may hold one are opened."""
    found = directory(spark, path).filter((F.col("first") <= F.lit(high)) & (F.col("last") >= F.lit(low))).select("file").collect()
    return _opened(spark, path, [r.file for r in found]).filter(F.col("_key").between(F.lit(low), F.lit(high))).drop("file", "at", "_key")
