"""Exact medians by repeated histograms: partial sums only, no list of values in any task.

Of every group the places of the middle rows are known from its count. A round counts the values between the bounds that are
left in ``BINS`` bins, with each bin's least and greatest value; the bin in which a wanted place falls gives the next bounds. It ends where a bin has one
value. The first round cuts by logarithm, so a far outlier costs a round and not many; later ones cut evenly.

Nulls, NaN and infinite values don't count. A group without values has no median; of an even count it is the mean of the two in the middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BINS = 1024
#: More than any doubles need: a round divides the bounds' distance by ``BINS``.
ROUNDS = 240


def _scaled(x: Column, log: bool) -> Column:
    return F.signum(x) * F.log1p(F.abs(x)) if log else x


def medians(df: DataFrame, value: Column, group: list[str], name: str = "median") -> DataFrame:
    """(group..., n, median) for each group; all rows are one group without ``group``."""
    keys = [f"_k{i}" for i in range(len(group))] or ["_all"]
    columns = [F.col(g).alias(k) for g, k in zip(group, keys, strict=True)] if group else [F.lit(0).alias("_all")]
    v = value.cast("double")
    rows = stored(df.select(*columns, F.when(F.abs(v) < float("inf"), v).alias("v")), "values")
    counted = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    # a wanted place (from 0) of a group, the bounds that hold it, and how many values lie below them
    open_ = stored(counted.filter("n > 0").select(*keys, "n", F.explode(ends).alias("place"), "low", "high", F.lit(0).cast("long").alias("below")), "bounds")
    done = open_.filter("low = high")
    found = [done]
    for i in range(ROUNDS):
        open_ = open_.filter("low < high")
        if open_.isEmpty():
            break
        log = i == 0
        bounds = open_.select(*[F.col(k).alias(f"{k}_b") for k in keys], "n", "place", "low", "high", "below")
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(F.col(f"{k}_b"))
        inside = rows.join(F.broadcast(bounds) if _few(bounds) else bounds, same & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        x, low, high = _scaled(F.col("v"), log), _scaled(F.col("low"), log), _scaled(F.col("high"), log)
        # halves, as the whole distance may be more than a double holds
        bin_ = F.least(F.lit(BINS - 1), F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * BINS)).cast("int")
        bins = inside.withColumn("bin", F.when(low < high, bin_).otherwise(F.lit(0))).groupBy(*keys, "n", "place", "below", "bin").agg(F.count("v").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        up_to = F.sum("c").over(Window.partitionBy(*keys, "place").orderBy("bin"))
        at = bins.withColumn("end", F.col("below") + up_to).withColumn("start", F.col("end") - F.col("c")).filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("end")))
        open_ = stored(at.select(*keys, "n", "place", "low", "high", F.col("start").alias("below")), "bounds")
        found.append(open_.filter("low = high"))
    else:
        raise ArithmeticError("medians did not converge")
    middle = found[0]
    for f in found[1:]:
        middle = middle.unionByName(f)
    means = middle.groupBy(*keys).agg(F.avg("low").alias("_median"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_m"))
    out = counted.join(means.select(*[F.col(k).alias(f"{k}_m") for k in keys], "_median"), same, "left")
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=False)], "n", F.col("_median").alias(name))


def _few(bounds: DataFrame) -> bool:
    """Whether the bounds, counted now, are within the session's broadcast threshold."""
    limit = bounds.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return bounds.count() * 96 <= limit
