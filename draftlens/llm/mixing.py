"""Mixing sources to target weights along a time-varying curriculum.

1. Targets: the sources, in code point order and null last, share ``budget`` of all words
   by weight; a target stops at ``most`` times its source's size and the excess is shared
   again by weight until none is above. With the sources in the order of ``most * size / weight``,
   those up to some place are full and the others get a common rate by weight: the rate is
   read off running totals, whatever the number of sources.
2. Schedule: over training time t in [0, 1] a source is drawn at the rate
   ``target * (1 + slope * (2t - 1))``; its slope goes with its weight, so light sources
   lead and heavy ones trail. The integral, the source's cumulative demand, is
   ``target * ((1 - slope) t + slope t^2)``.
3. Positions: a source's documents follow each other in an order given by the MD5 of their
   ids, in as many passes as the target needs. The words before a document's copy, put into
   the inverse of the cumulative demand, give the position at which the copy begins, and the words
   up to its end, or to the end of the demand, the position at which it ends.
4. The words that the mix takes of a copy are the demand between its two positions. The documents
   are range-sorted by position.

The last pass of a source ends inside one document, which is taken in part, so the words
taken equal the target rounded to a word. No document is taken beyond ``most`` times its size.

Running totals are built from ranges (``common.running``), so neither a source nor an id with a third of all
rows is a single task, and nothing but single totals reaches the driver. Everything here is DataFrame code.

Rows: null text has size 0; empty documents have no position and are taken 0 words.
A null source is a source of its own. Rows that share id and size are told apart by their place
in the files (``common.numbered``); each is a document. Other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, numbered, running, small, spread_of, stored

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
#: Slope of the heaviest source's schedule; the others' go down to its negative with the weight.
SLOPE = 0.5


#: Copies of the table of sources that a join with all rows meets, where it is too large to be sent to the workers.
SALT = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) of (source, n)."""
    n = sizes.count()
    by_name = running(sizes, [], ["none", "source"], {"place": F.lit(1)}, n) if n else sizes.withColumn("place", F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    table = by_name.select("source", "none", "n", weight.alias("weight"))
    table = stored(table.withColumn("full_at", F.lit(float(most)) * F.col("n") / F.col("weight")), "targets")
    all_n, all_w = table.agg(F.sum("n"), F.sum("weight")).first()
    if all_n is None:
        return table.select("source", F.col("n").alias("source_size"), "weight", F.lit(0.0).alias("target"))
    up_to = running(table, [], ["full_at", "none", "source"], {"n_full": F.col("n"), "w_full": F.col("weight")}, n)
    rate = (F.lit(budget * all_n) - F.lit(float(most)) * F.col("n_full")) / (F.lit(float(all_w)) - F.col("w_full"))
    found = up_to.select(*table.columns, rate.alias("rate")).filter("full_at >= rate").agg(F.min_by("rate", F.struct("full_at", "none", "source"))).first()[0]
    share = F.lit(float(most)) * F.col("n")
    if found is not None:  # none: every source is full
        share = F.least(share, F.lit(float(found)) * F.col("weight"))
    return table.select("source", F.col("n").alias("source_size"), "weight", F.round(share, 6).alias("target"))


def _inverse(demand: Column, slope: Column) -> Column:
    """t in [0, 1] with (1 - slope) t + slope t^2 = demand."""
    b = 1 - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * demand, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, demand).otherwise(2 * demand / (b + root))


def _demand(t: Column, slope: Column) -> Column:
    """The share of a source's target that is drawn up to t: the integral of its schedule."""
    return (1 - slope) * t + slope * t * t


def assigned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, row) with source_size, target, and ``copies``: (position, words) of each copy that the mix takes."""
    rows = stored(docs, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).withColumn("none", F.col("source").isNull())
    sizes = stored(sizes, "sources")
    n_rows = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    table = targets(sizes.drop("rows"), weights, budget, most)
    light, heavy = table.agg(F.min("weight"), F.max("weight")).first()
    slope = F.lit(0.0) if light == heavy else F.lit(SLOPE) * (2 * (F.col("weight") - light) / (heavy - light) - 1)
    table = table.select(F.col("source").alias("_source"), "source_size", "target", F.round("target").cast("long").alias("goal"), slope.alias("slope"))
    before = running(rows.withColumn("spread", spread_of("doc_id")), ["source"], ["spread", "doc_id", "size", "row"], {"before": F.col("size")}, n_rows).drop("spread")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if small(table, 64):
        joined = before.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = before.join(salted, same & (F.pmod("row", F.lit(SALT)) == F.col("_salt")))
    first = lambda i: F.col("before") + i.cast("long") * F.col("source_size")
    at = lambda words: _inverse(words / F.col("goal"), F.col("slope"))

    def copy(i: Column) -> Column:
        begin, end = at(first(i)), at(F.least(first(i) + F.col("size"), F.col("goal")))
        words = F.round(F.col("goal") * (_demand(end, F.col("slope")) - _demand(begin, F.col("slope")))).cast("long")
        return F.struct(begin.alias("position"), words.alias("words"))

    taken = F.filter(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), lambda i: (F.col("size") > 0) & (first(i) < F.col("goal")))
    return joined.select("doc_id", "source", "size", "row", "source_size", "target", F.transform(taken, copy).alias("copies"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """docs numbered, and (doc_id, source, size, row) of its rows."""
    rows = numbered(docs)
    at = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(docs.columns)))}
    return rows, rows.select(at[id_col].alias("doc_id"), at[source_col].cast("string").alias("source"), n_words(at[text_col]).alias("size"), "row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (the words the mix takes) and position (of the first copy); range-sorted by position."""
    found = assigned(_sized(docs, id_col, text_col, source_col)[1], **options)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    position = F.round(F.get("copies", 0)["position"], 9)
    out = found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), position.alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = n + 1 + F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.split(text, r"[\x20\x09-\x0D]+", parts.cast("int"))
    rest = F.when(F.size(cut) >= parts, F.length(F.element_at(cut, -1))).otherwise(0)
    return F.regexp_replace(F.substring(text, F.lit(1), (F.length(text) - rest).cast("int")), r"[\x20\x09-\x0D]+$", "")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, a row for each copy, range-sorted by training position.

    The rows' order is the curriculum (``common.in_order`` reads it back from the files that they are written to). The one
    document of a source that is taken in part is cut after that many words.
    """
    rows, sizes = _sized(docs, id_col, text_col, source_col)
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    copies = assigned(sizes, **options).select("doc_id", F.col("row").alias("_row"), F.col("size").alias("_size"), F.explode("copies").alias("_copy"))
    copies = stored(copies.filter("_copy.words > 0").select(F.col("doc_id").alias("_doc"), "_row", "_size", "_copy.position", "_copy.words"), "copies")
    joined = rows.join(copies, (F.col("row") == F.col("_row")) & F.col(at[id_col]).eqNullSafe(F.col("_doc")))
    joined = joined.repartitionByRange("position", at[id_col], "row").sortWithinPartitions("position", at[id_col], "row")
    text = F.when(F.col("words") >= F.col("_size"), F.col(at[text_col])).otherwise(_first_words(F.col(at[text_col]), F.col("words")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    return joined.select(*[text.alias(c) if c == at[text_col] else F.col(c) for c in names]).toDF(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: how much of each document the mix takes."""
    found = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position")


_SPACE = "'[^\\x20\\x09-\\x0D]+'"

#: The same mix in SQL: targets by repeated sharing, documents in the order of their ids' MD5.
OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_SPACE})), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1)::INT % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), share AS (
  SELECT 0 AS step, source, n, w, false AS done, 1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE AS pot, (SELECT sum(w) FROM s) AS total, true AS moved FROM s
  UNION ALL
  SELECT step + 1, source, n, w, over, pot - sum(CASE WHEN over AND NOT done THEN 2.0::DOUBLE * n ELSE 0 END) OVER (),
    sum(CASE WHEN over THEN 0 ELSE w END) OVER (), bool_or(over AND NOT done) OVER ()
  FROM (SELECT *, done OR pot * w / total > 2.0::DOUBLE * n AS over FROM share WHERE moved)
), t AS (
  SELECT source, n, round(CASE WHEN done THEN 2.0::DOUBLE * n ELSE pot * w / total END, 6) AS target,
    CASE WHEN min(w) OVER () = max(w) OVER () THEN 0 ELSE 0.5 * (2 * (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) - 1) END AS slope
  FROM share WHERE step = (SELECT max(step) FROM share)
), r AS (
  SELECT d.doc_id, size, n AS source_size, target, round(target)::BIGINT AS goal, slope,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS times FROM r)
SELECT doc_id, size, source_size, target,
  (times * size + greatest(0, least(size, goal - times * source_size - bef)))::BIGINT AS taken,
  CASE WHEN size > 0 AND bef < goal THEN round(2 * (bef / goal) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (bef / goal))), 9) END AS position
FROM f
"""
