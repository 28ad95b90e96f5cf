"""Incremental ingestion: each micro-batch adds only hashes that the store does not have.

Deduplication has no horizon, so it is a join with the store in ``foreachBatch`` and not stream state. Every batch has a Bloom filter
beside it (``operators/blooms.py``), and only batches that may hold one of the new hashes are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blooms
from ..operators.shared import exists, filesystem
from ..operators.store import first_by_hash, new_only


def batches(spark: SparkSession, store_path: str) -> dict[str, str]:
    """The store's batches, ``<stream>-<number>``, and their folders."""
    fs, p = filesystem(spark, store_path)
    out = {}
    for s in fs.listStatus(p) if fs.exists(p) else []:
        if s.getPath().getName().startswith("_stream="):
            for b in fs.listStatus(s.getPath()):
                if "=" in b.getPath().getName():
                    out[f"{s.getPath().getName()[8:]}-{b.getPath().getName()[7:]}"] = b.getPath().toString()
    return out


def filter_path(store_path: str, batch: str) -> str:
    return f"{store_path}/_filters/{batch}"


def seen_before(spark: SparkSession, store_path: str, rows: DataFrame, key: str, but: str = "") -> list[str]:
    """Folders of the batches, other than ``but``, that may hold one of the rows' hashes."""
    others = {b: f for b, f in batches(spark, store_path).items() if b != but}
    hashes = rows.filter(F.col(key) != "").select(key)
    return [others[b] for b in blooms.may_hold(spark, hashes, key, {b: filter_path(store_path, b) for b in others})] if others else []


def ingest(stream: DataFrame, store_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], order: list[str], key: str = "source_hash") -> StreamingQuery:
    """Append the new rows of a stream to a Parquet store, transformed; a batch that is run again adds nothing twice.

    Each batch is a folder of the store, named by the checkpoint and the batch's number, that is written anew if the batch is run
    again, so rows without hash, which no join can find in the store, are not added twice either. Its filter is deleted before and written after it;
    a batch without filter is always read. Reading the store gives ``_stream`` and ``_batch`` beside the rows' columns.
    """
    spark = stream.sparkSession
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        this = f"{name}-{number}"
        fresh = first_by_hash(batch, order, key)
        if folders := seen_before(spark, store_path, fresh, key, this):
            fresh = new_only(fresh, spark.read.parquet(*folders).select(key), key)
        fs, old = filesystem(spark, filter_path(store_path, this))
        fs.delete(old, True)
        folder = f"{store_path}/_stream={name}/_batch={number}"
        transform(fresh).write.mode("overwrite").parquet(folder)
        blooms.build(spark.read.parquet(folder).filter(F.col(key) != ""), key, filter_path(store_path, this))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["batches", "exists", "ingest", "seen_before"]
