"""From files to records in one call: extraction, fields, rules, records, their audit events.

``analyzed`` takes files through an injected extractor, once or several times each; repeated reads are reconciled field by field. ``recorded`` adds what is new to a
versioned store and gives its events. Nothing is judged on the driver; the extractor's responses are written before they are used, as a lost task would call it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import normalised
from ..sources.extractor import extracted, parsed
from ..sources.responses import raw_fields
from .reconcile import FIELDS, reconciled
from .records import projected
from .rules import Config, validated
from .shared import stored
from .store import first_by_hash, ingested, new_only, with_ids
from .versions import Store


def to_normalized(responses: DataFrame, date_order: str = "DMY", unicode: bool = True) -> DataFrame:
    """The six fields of each parsed response."""
    return normalised(raw_fields(responses), date_order, unicode)


def to_normalized_multi(responses: DataFrame, source: str = "source_file", run: str = "run", date_order: str = "DMY", unicode: bool = True) -> DataFrame:
    """The six fields of each source, reconciled over its runs that gave a document; a source without any is left out."""
    fields = to_normalized(responses.filter(F.size("documents") > 0), date_order, unicode)
    return reconciled(fields.select(source, run, *FIELDS), source, run)


def analyzed(files: DataFrame, make: Callable[[], Callable[[str, bytes], dict]], runs: int = 1, date_order: str = "DMY", unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fields of each file that was read, captured responses) of files (path, content, source_hash)."""
    captured = stored(extracted(files, make, runs), "captured")
    # a file's responses meet before they are parsed: what goes over the network is their text, and few written files are no few tasks
    fields = to_normalized_multi(parsed(captured.repartition("source_file")), "source_file", "run", date_order, unicode)
    hashes = files.select(F.col("path").alias("_path"), "source_hash")
    return stored(fields.join(hashes, F.col("source_file") == F.col("_path")).drop("_path"), "fields"), captured


def recorded(at: Store, fields: DataFrame, today: Column, day: str, ruleset: str, model: str | None, time: Column, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Judge the fields and append the files that are new to the store; (the new records, audit events of the batch).

    Of files with one hash the first by path is new. Another writer's records of the same files, committed meanwhile, are not seen: files of one source
    are to have one writer.
    """
    known = at.read()
    # what is new and its number are found on three columns; the fields are moved once, to be judged
    rows = stored(fields.withColumn("_row", F.monotonically_increasing_id()), "rows")
    fresh = stored(new_only(first_by_hash(rows.select("source_file", "source_hash", "_row"), ["source_file", "_row"]), known), "fresh")
    numbered = stored(with_ids(fresh.withColumn("on_day", F.lit(day)), known, "on_day", ["source_file", "_row"]).select("_row", "record_id", "source_file"), "numbered")
    judged = validated(rows.join(numbered.drop("source_file"), "_row").drop("_row").withColumn("processed_time", time), today, cfg)
    records = stored(projected(judged, ruleset, model), "records")
    files = numbered.select("record_id", F.col("source_file").alias("_path"))
    events = ingested(rows.select("source_file", "source_hash"), known, records.join(files, "record_id").drop("source_file").withColumnRenamed("_path", "source_file"), time)
    events = stored(events, "events")
    at.append(records, "ingest")
    return records, events
