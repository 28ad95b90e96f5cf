"""A search index: the grams of blocks of records, intersected, then verified.

A posting is (gram, block) for each distinct run of one, two or three letters in the search texts of a block, 256 records that were written
beside each other. A query of three letters or more looks up its trigrams, the rarest ``USED`` of them; a shorter one is a gram itself. Blocks that have them all are
read, and ``contains`` on the text of each of their records decides, so rows are those of a full scan. Postings lie in folders by a hash of the gram, so a query opens the few that it needs.

Texts are lower-cased as the dashboard does. An empty query finds every record. A record without text has no gram and is found by an empty query alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 64
USED = 3
#: A block is 2^BITS records.
BITS = 8
FIELDS = ("record_id", "payee", "source_file", "payee_normalized")


def search_text(fields: tuple[str, ...] = FIELDS) -> Column:
    """What a search looks at: the fields with spaces between, null as '', in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) of texts (block, text); a block that lies in two batches or tasks may repeat a gram."""
    for batch in batches:
        blocks: dict[int, set[str]] = {}
        for block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks.setdefault(block, set()).update(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
        names = [b for b, found in blocks.items() for _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([g for found in blocks.values() for g in found], pa.string())], names=["block", "gram"])


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build(records: DataFrame, path: str, key: str = "record_id", fields: tuple[str, ...] = FIELDS) -> None:
    """Postings and the grams' counts below ``path``, and the texts by block that candidates are verified on."""
    spark = records.sparkSession
    place = F.monotonically_increasing_id()  # by task, so a block is of one task
    records.select(F.col(key).alias("key"), search_text(fields).alias("text"), F.shiftright(place, BITS).alias("block")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    postings = texts.select("block", "text").mapInArrow(_postings, "block long, gram string").withColumn("_folder", _folder(F.col("gram")))
    # a common gram is many rows, so folders are dealt by block too
    postings.repartition(FOLDERS, "_folder", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("_folder", "gram").write.partitionBy("_folder").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(block) of the blocks that have the query's rarest grams; None if any record may match."""
    q = query.strip().lower()
    if not q:
        return None
    n = min(3, len(q))
    wanted = sorted({q[i : i + n] for i in range(len(q) - n + 1)})
    known = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(wanted)).collect()}  # no more than the query's grams
    postings = spark.read.parquet(f"{path}/postings")
    if len(known) < len(wanted):
        return postings.select("block").limit(0)
    used = sorted(wanted, key=lambda g: (known[g], g))[:USED]
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in used], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    rows = postings.filter(F.col("_folder").isin(folders) & F.col("gram").isin(used))
    return rows.groupBy("block").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(used)).select("block")


def found(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key) of the records whose text contains the query."""
    texts, some = spark.read.parquet(f"{path}/texts"), candidates(spark, path, query)
    at = texts if some is None else texts.join(some, "block", "left_semi")
    return at.filter(F.contains(F.col("text"), F.lit(query.strip().lower()))).select("key")
