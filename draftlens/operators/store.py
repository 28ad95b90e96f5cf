"""The record store: deduplicated by content hash, with an append-only audit log and human overrides as a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .rules import Config, outcome, validated, verdict
from .sequence import ranked

ID = r"^CHQ-(\d{8})-(\d{4,})$"


def record_id(day: Column, number: Column) -> Column:
    return F.format_string("CHQ-%s-%04d", day, number)


def new_only(df: DataFrame, store: DataFrame, key: str = "source_hash") -> DataFrame:
    """The rows of df whose hash the store does not have; a null or empty hash is always new."""
    seen = store.filter(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("_seen")).distinct()
    return df.join(seen, F.col(key) == F.col("_seen"), "left_anti")


def first_by_hash(df: DataFrame, order: list[str], key: str = "source_hash") -> DataFrame:
    """Of each hash the first row in the given order; rows without hash stay.

    The first is a minimum, combined before the shuffle: a hash of a third of all rows is one row for each task.
    """
    known = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    first = known.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return first.select(*df.columns).unionByName(df.filter(F.col(key).isNull() | (F.col(key) == "")).select(*df.columns))


def with_ids(df: DataFrame, store: DataFrame, day: str, order: list[str]) -> DataFrame:
    """df with record_id: per day from one past the store's largest number (of four digits or more), in the given order."""
    taken = store.select(F.regexp_extract("record_id", ID, 1).alias("_day"), F.regexp_extract("record_id", ID, 2).try_cast("long").alias("_n")).filter("_n IS NOT NULL").groupBy("_day").agg(F.max("_n").alias("_max"))
    # ids are dense within a day; ranks come from ranges of it, so a hot day is no single task
    numbered = ranked(df, [day], [F.col(c) for c in order], "_rank")
    joined = numbered.join(taken, F.col(day) == F.col("_day"), "left")
    return joined.withColumn("record_id", record_id(F.col(day), F.coalesce(F.col("_max"), F.lit(0)) + F.col("_rank"))).drop("_rank", "_day", "_max")


def appended(store: DataFrame, df: DataFrame, day: str, order: list[str]) -> DataFrame:
    """store with the new rows of df, deduplicated and numbered."""
    fresh = with_ids(first_by_hash(new_only(df, store), order), store, day, order)
    return store.unionByName(fresh, allowMissingColumns=True)


def audit(df: DataFrame, event: str, at: Column, *details: str) -> DataFrame:
    """Audit events to append as JSON lines."""
    return df.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(event).alias("event"), "record_id", *details)


def standing(overrides: DataFrame, *columns: str) -> DataFrame:
    """(record_id, rule, ``columns``...) with one row for each record and rule: the latest by ``timestamp`` if there is one, then the least by the columns in order."""
    values = F.struct(*columns)
    if "timestamp" in overrides.columns:
        latest = overrides.groupBy(F.col("record_id").alias("_id"), F.col("rule").alias("_rule")).agg(F.max("timestamp").alias("_last"))
        same = F.col("record_id").eqNullSafe(F.col("_id")) & F.col("rule").eqNullSafe(F.col("_rule")) & F.col("timestamp").eqNullSafe(F.col("_last"))
        overrides = overrides.join(latest, same).select(*[c for c in overrides.columns])
    return overrides.filter("rule IS NOT NULL").groupBy("record_id", "rule").agg(F.min(values).alias("_s")).select("record_id", "rule", "_s.*")


def overridden(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """records (record_id, rules, verdict) with rules replaced by overrides (record_id, rule, status, evidence), verdicts anew.

    Of several overrides of one rule of a record ``standing`` says which counts.
    """
    one = standing(overrides, "status", "evidence")
    per = one.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("rule", outcome(F.col("status"), F.col("evidence"))))).alias("_over"))
    joined = records.join(per, "record_id", "left")
    rules = F.when(F.col("_over").isNull(), F.col("rules")).otherwise(F.transform_values("rules", lambda k, v: F.coalesce(F.try_element_at("_over", k), v)))
    return joined.withColumn("rules", rules).withColumn("verdict", verdict(F.col("rules"))).drop("_over")


def lost_overrides(overrides: DataFrame, records: DataFrame) -> DataFrame:
    """Overrides to PASS that a store does not show: the record is missing, or its rule has another state."""
    rows = records.select("record_id", "rules")
    joined = overrides.filter(F.col("status") == V.PASS).join(rows, "record_id", "left")
    return joined.filter(F.col("rules").isNull() | ~F.coalesce(F.try_element_at("rules", F.col("rule"))["status"] == V.PASS, F.lit(False))).drop("rules")


def verdict_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_verdict, new_verdict, n) of the records whose verdict changed."""
    pair = old.select("record_id", F.col("verdict").alias("old_verdict")).join(new.select("record_id", F.col("verdict").alias("new_verdict")), "record_id")
    return pair.filter("old_verdict <> new_verdict").groupBy("old_verdict", "new_verdict").agg(F.count("*").alias("n"))


def rejudged(df: DataFrame, today: Column, old: Config, new: Config) -> DataFrame:
    """(old_verdict, new_verdict, n) of fields judged by two rule sets: parsed once, and no join."""
    first = validated(df, today, old).withColumnRenamed("verdict", "old_verdict").drop("rules")
    both = validated(first, today, new).select("old_verdict", F.col("verdict").alias("new_verdict"))
    # one aggregate: a filter on verdicts would have both judgements copied below it
    pairs = [(a, b) for a in V.VERDICTS for b in V.VERDICTS if a != b]
    counts = both.agg(*[F.count_if((F.col("old_verdict") == a) & (F.col("new_verdict") == b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("old_verdict"), F.lit(b).alias("new_verdict"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    return counts.select(F.inline(rows)).filter("n > 0")


def ingested(arrived: DataFrame, stored: DataFrame, fresh: DataFrame, at: Column) -> DataFrame:
    """Audit events of a batch: ``cheque_processed`` for each new record, ``duplicate_ingestion_skipped`` for each other file that arrived.

    arrived: (source_file, source_hash) of all files; stored: records of before; fresh: the new records (of the batch's files with one hash the first is new, the
    others are duplicates of it). A skipped file names the record that has its hash. All events have the columns of both kinds.
    """
    name = F.regexp_extract("source_file", r"([^/]*)$", 1)
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp")
    new = fresh.select(time, F.lit("cheque_processed").alias("event"), "record_id", name.alias("source_file"), "verdict", "ruleset_version", "model")
    known = stored.select("source_hash", "record_id", F.lit(None).cast("string").alias("_first")).unionByName(fresh.select("source_hash", "record_id", F.col("source_file").alias("_first")))
    known = known.filter("source_hash <> ''").groupBy(F.col("source_hash").alias("_hash")).agg(F.min("record_id").alias("record_id"), F.max("_first").alias("_first"))
    rest = arrived.join(known, (F.col("source_hash") == F.col("_hash")) & ~F.col("source_file").eqNullSafe(F.col("_first")))
    none = F.lit(None).cast("string")
    skipped = rest.select(time, F.lit("duplicate_ingestion_skipped").alias("event"), "record_id", name.alias("source_file"), none.alias("verdict"), none.alias("ruleset_version"), none.alias("model"))
    return new.unionByName(skipped)
