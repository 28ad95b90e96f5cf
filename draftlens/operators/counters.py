"""Counters of a store, kept up to date by signed differences instead of a full pass.

A counter is (name, item, n): verdicts, statuses of each rule, years, and the total. What a batch changes is the new rows' counts less the counts of
the rows they replace; adding that to the stored counters gives what a recount would. Counts are combined before each shuffle, so a hot item is a row a task.

``refreshed`` makes counters of a store's two versions: only buckets that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .versions import Store

SCHEMA = "name string, item string, n bigint"


def items(date: str = "cheque_date") -> Column:
    """array<struct<name, item>> of what a record counts in."""
    pair = lambda name, item: F.struct(F.lit(name).alias("name"), item.cast("string").alias("item"))
    rules = [pair("rule", F.concat(F.lit(f"{r}:"), F.coalesce(F.col("rules")[r]["status"], F.lit("none")))) for r in V.RULES]
    year = F.coalesce(F.substring(F.col(date).cast("string"), 1, 4), F.lit(""))
    return F.array(pair("total", F.lit("")), pair("verdict", F.col("verdict")), pair("year", year), *rules)


def counted(records: DataFrame) -> DataFrame:
    """The counters of all records."""
    return records.select(F.inline(items())).groupBy("name", "item").agg(F.count(F.lit(1)).alias("n"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed counts: the records of new less those of old; items that stay are left out."""
    both = counted(new).unionByName(counted(old).withColumn("n", -F.col("n")))
    return both.groupBy("name", "item").agg(F.sum("n").alias("n")).filter("n <> 0")


def applied(counters: DataFrame, *differences: DataFrame) -> DataFrame:
    """Counters with differences added; an item that reaches zero goes."""
    out = counters
    for d in differences:
        out = out.unionByName(d)
    return out.groupBy("name", "item").agg(F.sum("n").alias("n")).filter("n <> 0")


def refreshed(store: Store, counters: DataFrame, since: int, version: int) -> DataFrame:
    """Counters of version ``since`` brought to ``version``; only buckets whose folders differ are read."""
    a, b = store.manifest(since), store.manifest(version)
    changed = {int(k) for k in {*a.folders, *b.folders} if a.folders.get(k) != b.folders.get(k)}
    if not changed:
        return counters
    return applied(counters, difference(store.read(since, changed), store.read(version, changed)))
