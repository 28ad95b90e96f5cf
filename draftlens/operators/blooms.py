"""Bloom filters of stored batches, as tables: which batches may hold a hash, without reading them.

A filter is rows (word, bits): bit b of a key is bit b % 64 of word b / 64, and keys set ``PROBES`` bits each. Filters are
built by an aggregate (bitwise or, combined before the shuffle), so a batch of any size has one, of about 16 bits a key, and lie beside
the batch's rows; the number of bits is a power of two and part of a filter's name. A lookup joins the new keys' bits with the filters' words and keeps the
batches in which all bits of a key are set: every batch that holds a key, and by chance about one of two thousand others for each key.

Null keys are in no filter and are looked for in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, filesystem

PROBES = 7
BITS_A_KEY = 16
LEAST_BITS = 1 << 10


def _bits(key: Column, m: Column) -> Column:
    """The key's bits in a filter of m bits."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), m) for i in range(PROBES)])


def _one(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def size_for(n: int) -> int:
    m = LEAST_BITS
    while m < n * BITS_A_KEY:
        m *= 2
    return m


def build(keys: DataFrame, key: str, path: str) -> None:
    """The filter of a batch's keys, written below ``path``; a filter that is there is replaced."""
    known = keys.filter(F.col(key).isNotNull())
    m = size_for(known.count())
    bit = known.select(F.explode(_bits(F.col(key), F.lit(m).cast("long"))).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(_one(F.col("b") % 64)).alias("bits"))
    words.withColumn("m", F.lit(m).cast("long")).sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def may_hold(spark: SparkSession, keys: DataFrame, key: str, filters: dict[str, str]) -> list[str]:
    """The names of the filters (name to path) that may hold one of the keys; those without a file may hold any."""
    there = {n: p for n, p in filters.items() if exists(spark, p)}
    unknown = [n for n in filters if n not in there]
    if not there:
        return unknown
    words = spark.read.schema("word long, bits long, m long").parquet(*there.values()).withColumn("at", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", ""))
    sizes = [r["m"] for r in words.select("m").distinct().collect()]  # powers of two
    wanted = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    probes = wanted.select("_key", F.explode(F.array(*[F.lit(m).cast("long") for m in sizes])).alias("_m"))
    probes = probes.select("_key", "_m", F.explode(F.array_distinct(_bits(F.col("_key"), F.col("_m")))).alias("_b"))
    needed = probes.groupBy("_key", "_m", F.shiftright("_b", 6).alias("_word")).agg(F.bit_or(_one(F.col("_b") % 64)).alias("_bits"))
    total = needed.groupBy(F.col("_key").alias("_k"), F.col("_m").alias("_km")).agg(F.count(F.lit(1)).alias("_n"))
    hit = words.join(needed, (F.col("m") == F.col("_m")) & (F.col("word") == F.col("_word")) & (F.col("bits").bitwiseAND(F.col("_bits")) == F.col("_bits")))
    full = hit.groupBy("at", "_key", "_m").agg(F.count(F.lit(1)).alias("_found")).join(total, (F.col("_key") == F.col("_k")) & (F.col("_m") == F.col("_km")) & (F.col("_found") == F.col("_n")))
    got = {_plain(r["at"]) for r in full.select("at").distinct().collect()}  # one row a batch
    return unknown + [n for n, p in there.items() if _plain(filesystem(spark, p)[0].makeQualified(filesystem(spark, p)[1]).toString()) in got]


def _plain(uri: str) -> str:
    """A path in one spelling: file:/x and file:///x are the same."""
    return uri.replace("file:///", "file:/")
