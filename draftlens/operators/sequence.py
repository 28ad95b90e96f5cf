"""Ranks, previous and next rows within groups, without a task that holds a group.

Rows are cut into ranges of (group, order) and written; a group lies in any number of ranges. Inside a range a window
gives a row's place; what stands before a range is a sum over the ranges of its group, of which there are few, and the row next
to a range's first or last is the last or first of the range beside it. The order must end in a column that tells rows apart; nulls come first.

Null groups are a group. Rows of equal order get their places in any one order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Rows in a range, at most, about.
RANGE = 500_000
#: Rows that are worth a range of their own as long as there are fewer ranges than cores.
LEAST = 10_000


def _in_ranges(df: DataFrame, group: list[str], order: list[Column], rows_in_range: int) -> DataFrame:
    """df written in ranges of (group, order), with ``_g0``.. for the group, ``_o0``.. for the order and the range ``_part``."""
    keyed = df.select("*", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    rows = df.count()
    n = max(1, -(-rows // rows_in_range), min(rows // LEAST, df.sparkSession.sparkContext.defaultParallelism))
    ends = [*(F.col(f"_g{i}").asc_nulls_first() for i in range(len(group))), *order]
    return stored(keyed.repartitionByRange(n, *ends).withColumn("_part", F.spark_partition_id()), "ranges")


def _same(at: DataFrame, other: DataFrame, groups: list[str], columns: list[Column]) -> DataFrame:
    """at with columns of ``other``, which has a row for each group and range (``_h0``.., ``_p``)."""
    cond = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_h{i}"))
    return at.join(other.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), *columns), cond).drop("_p", *[f"_h{i}" for i in range(len(groups))])


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank", rows_in_range: int = RANGE) -> DataFrame:
    """df with ``rank``, the row's place in its group, from 1."""
    at = _in_ranges(df, group, order, rows_in_range)
    groups = [f"_g{i}" for i in range(len(group))]
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = at.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = at.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    return _same(at, base, groups, [F.col("_base")]).withColumn(rank, F.col("_at") + F.col("_base")).select(*df.columns, rank)


def beside(df: DataFrame, group: list[str], order: list[Column], key: str, rank: str = "rank", previous: str = "previous", following: str = "next", rows_in_range: int = RANGE) -> DataFrame:
    """df with its rank and the ``key`` of the rows before and after it in its group; null at the ends."""
    at = _in_ranges(df, group, order, rows_in_range)
    groups = [f"_g{i}" for i in range(len(group))]
    inside = Window.partitionBy(*groups, "_part").orderBy(*order)
    at = at.withColumns({"_at": F.row_number().over(inside), "_lag": F.lag(F.struct(key)).over(inside), "_lead": F.lead(F.struct(key)).over(inside)})
    ends = at.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(key), "_at").alias("_first"), F.max_by(F.struct(key), "_at").alias("_last"))
    parts = Window.partitionBy(*groups).orderBy("_part")
    ends = ends.withColumns({"_base": F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_before": F.lag("_last").over(parts), "_after": F.lead("_first").over(parts)})
    out = _same(at, ends, groups, [F.col("_base"), F.col("_before"), F.col("_after")])
    return out.select(*df.columns, (F.col("_at") + F.col("_base")).alias(rank), F.coalesce("_lag", "_before")[key].alias(previous), F.coalesce("_lead", "_after")[key].alias(following))
