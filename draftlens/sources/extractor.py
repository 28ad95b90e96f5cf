"""Calls of an injected extractor, once or several times a file. Files that the store knows are to be filtered out before."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .responses import RESPONSE

#: Characters of responses that a task holds before it sends them on.
HELD = 8 << 20
_NAMES = ("source_file", "source_hash", "run", "raw", "error")


def extracted(files: DataFrame, make: Callable[[], Callable[[str, bytes], dict]], runs: int = 1) -> DataFrame:
    """(source_file, source_hash, run, raw, error) of files (path, content, source_hash): the response as JSON, or the type of what was raised.

    ``make()`` is called once for each task and gives the client. A task that is lost calls again, so write the result before
    it is used; ``parsed`` reads the written rows.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        rows, size = [], 0
        for batch in batches:
            for path, content, digest in zip(*(batch.column(i) for i in range(3)), strict=True):
                path, content, digest = path.as_py(), content.as_py(), digest.as_py()
                for run in range(1, runs + 1):
                    try:
                        raw, error = json.dumps(client(path, content), default=str), None
                    except Exception as e:  # one file's failure is not the batch's
                        raw, error = None, type(e).__name__
                    rows.append((path, digest, run, raw, error))
                    size += len(raw or "")
                if size > HELD:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)
            rows, size = [], 0

    return files.select("path", "content", "source_hash").mapInArrow(call, "source_file string, source_hash string, run int, raw string, error string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "run" else pa.string()) for n, c in zip(_NAMES, columns, strict=True)], names=list(_NAMES))


def parsed(captured: DataFrame) -> DataFrame:
    """Captured responses in the columns of ``responses``; failed calls have no document."""
    return captured.withColumn("r", F.from_json("raw", RESPONSE)).withColumn("documents", F.col("r.documents")).withColumn("pages", F.col("r.pages")).withColumnRenamed("error", "call_error").drop("r")


def capture(captured: DataFrame, folder: str) -> None:
    """Raw responses as JSON lines by run, to replay or to examine; nothing that is there is overwritten."""
    captured.filter("raw IS NOT NULL").write.mode("append").partitionBy("run").json(folder)


def batch_summary(found: DataFrame, todo: DataFrame, captured: DataFrame) -> DataFrame:
    """One row: found, skipped (already stored), processed and errors, counted by file; a file with a failed run is an error."""
    files = captured.groupBy("source_file").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"))
    counts = [found.agg(F.count("*").alias("found")), todo.agg(F.count("*").alias("_todo")), files.agg(F.count_if(~F.col("bad")).alias("processed"), F.count_if("bad").alias("errors"))]
    one = counts[0].join(counts[1]).join(counts[2])  # a row each
    return one.select("found", (F.col("found") - F.col("_todo")).alias("skipped"), "processed", "errors")
