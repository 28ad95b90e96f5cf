"""Upkeep of a record store: reviews, confirmations by people, migration of old rule sets, planning of missing responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .records import projected, rebuilt
from .rules import Config, outcome, validated, verdict

# fixed values: review states and audit events
VISUAL, ROTATION, MIGRATION = "manual_visual_verification", "operator_rotation_override", "ruleset_migration"
_TIME = "yyyy-MM-dd'T'HH:mm:ssXXX"


def stem(path: Column) -> Column:
    """A file's name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def old_verdict(rules: Column) -> Column:
    """The two-valued verdict of the first rule sets: a FAIL is INVALID, all else VALID."""
    return F.when(F.exists(F.map_values(rules), lambda r: F.coalesce(r["status"] == V.FAIL, F.lit(False))), V.INVALID).otherwise(V.VALID)


def unreviewed(wanted: DataFrame, reviews: DataFrame, status: Column, prefix: bool = False) -> DataFrame:
    """The rows of wanted (record_id, ...) without a review of that status, or of one that starts with it."""
    done = reviews.select(F.col("record_id").alias("_id"), F.col("status").alias("_status")).distinct()
    same = F.startswith(F.col("_status"), F.col("_want")) if prefix else F.col("_status") == F.col("_want")
    return wanted.withColumn("_want", status).join(done, (F.col("record_id") == F.col("_id")) & same, "left_anti").drop("_want")


def unverified(records: DataFrame, force: bool = False) -> DataFrame:
    """The records without second readings; all of them if forced."""
    return records if force else records.filter(F.col("ocr_verifications").isNull() | (F.size("ocr_verifications") == 0))


def confirmed(records: DataFrame, confirmations: DataFrame, reviews: DataFrame, ruleset: str, today: Column, cfg: Config | None = None, unicode: bool = True) -> DataFrame:
    """Records that people have looked at, judged anew; applied a second time it returns nothing.

    confirmations: (record_id, rule, seen, note), rule payee or signature. A signature corrects the field, from which the rules follow; a
    payee makes its rule PASS and leaves the read text as it is. Result: the records' columns, ``confirmed`` array<struct<rule, note>>.
    """
    todo = unreviewed(confirmations.filter(F.col("rule").isin("payee", "signature")), reviews, F.concat(F.lit(f"{VISUAL}:"), F.col("rule")))
    per = todo.groupBy("record_id", "rule").agg(F.min(F.struct("seen", "note")).alias("s"))
    per = per.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("rule", "s"))).alias("_seen"))
    # confirmations are few: only the records that they name are parsed again
    df = rebuilt(records.join(per.select("record_id"), "record_id", "left_semi"), unicode=unicode).join(per, "record_id", "inner")
    signed = F.map_contains_key("_seen", F.lit("signature"))
    fixed = F.struct(F.lit(True).alias("value"), F.col("signature.raw_text"), F.lit(V.OK).alias("status"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("degraded"), F.col("signature.confidence"))
    df = validated(df.withColumn("signature", F.when(signed, fixed).otherwise(F.col("signature"))), today, cfg)
    seen = F.try_element_at("_seen", F.lit("payee"))
    why = F.concat(F.lit("read as "), F.coalesce(F.col("payee.raw_text"), F.lit("nothing")), F.lit(", confirmed as "), F.coalesce(seen["seen"], F.lit("")), F.lit(" by a person: "), F.coalesce(seen["note"], F.lit("")))
    over = F.transform_values("rules", lambda k, v: F.when((k == "payee") & seen.isNotNull(), outcome(V.PASS, why, v["confidence"])).otherwise(v))
    df = df.withColumn("rules", over).withColumn("verdict", verdict(F.col("rules")))
    df = df.withColumn("confirmed", F.transform(F.map_entries("_seen"), lambda e: F.struct(e["key"].alias("rule"), e["value"]["note"].alias("note"))))
    return projected(df, ruleset, None, "old_verdict", "confirmed")


def confirmation_reviews(done: DataFrame, reviewer: str, at: Column) -> DataFrame:
    """The reviews to append for ``confirmed``; they are what makes it idempotent."""
    one = done.select("record_id", F.explode("confirmed").alias("c"))
    return one.select("record_id", F.date_format(at, _TIME).alias("timestamp"), F.lit(reviewer).alias("reviewer"), F.concat(F.lit(f"{VISUAL}:"), F.col("c.rule")).alias("status"), F.col("c.note").alias("note"))


def confirmation_events(done: DataFrame, at: Column) -> DataFrame:
    one = done.select("record_id", F.explode("confirmed").alias("c"))
    return one.select(F.date_format(at, _TIME).alias("timestamp"), F.lit(VISUAL).alias("event"), "record_id", F.col("c.rule").alias("field"), F.col("c.note").alias("note"))


def rotated(records: DataFrame, turns: DataFrame, reviews: DataFrame) -> DataFrame:
    """Records whose quarter turn an operator has given: (record_id, direction, detector_note); only the rotation's columns change."""
    todo = unreviewed(turns.filter(F.col("direction").isin("CW", "CCW")), reviews, F.lit(f"{ROTATION}:"), prefix=True)
    per = todo.groupBy("record_id").agg(F.min(F.struct("direction", "detector_note")).alias("_turn"))
    given = {"rotation": F.struct(F.col("_turn.direction").alias("direction"), F.lit(True).alias("confident")), "rotation_direction": F.col("_turn.direction"), "rotation_confident": F.lit(True)}
    kept = [given.get(c, F.col(c)).alias(c) for c in records.columns]
    return records.join(per, "record_id", "inner").select(*kept, F.col("_turn.detector_note").alias("detector_note"))


def rotation_reviews(done: DataFrame, reviewer: str, at: Column) -> DataFrame:
    note = F.concat(F.lit("detector: "), F.coalesce("detector_note", F.lit("")), F.lit("; direction confirmed by an operator"))
    return done.select("record_id", F.date_format(at, _TIME).alias("timestamp"), F.lit(reviewer).alias("reviewer"), F.concat(F.lit(f"{ROTATION}:"), F.col("rotation_direction")).alias("status"), note.alias("note"))


def paths_by_hash(files: DataFrame) -> DataFrame:
    """(source_hash, paths) of local files, paths sorted. Copies of one file are few; a hash is one row."""
    return files.groupBy("source_hash").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def with_source(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with source_path: of the files with their hash the one of their name, else the first by path; null without any."""
    by_name = files.groupBy(F.col("source_hash").alias("_hash"), F.regexp_extract("path", r"([^/]*)$", 1).alias("_name")).agg(F.min("path").alias("_named"))
    first = by_name.groupBy("_hash").agg(F.min("_named").alias("_first"))
    named = by_name.select(F.col("_hash").alias("_hash2"), "_name", "_named")
    joined = records.join(first, F.col("source_hash") == F.col("_hash"), "left").join(named, (F.col("source_hash") == F.col("_hash2")) & (F.col("source_file") == F.col("_name")), "left")
    return joined.withColumn("source_path", F.coalesce("_named", "_first")).drop("_hash", "_hash2", "_name", "_named", "_first")


def blanket_failed(records: DataFrame, ruleset: str, rule: str = "memo") -> DataFrame:
    """Records without a source, brought to a rule set that has one rule more: it fails, and the verdict is the old one."""
    failed = F.create_map(F.lit(rule), F.struct(F.lit(V.FAIL).alias("status"), F.lit(f"{rule} was not captured by the earlier rule set").alias("message"), F.lit(None).cast("double").alias("confidence")))
    others = F.map_filter(F.coalesce("rules", F.expr("cast(map() as map<string,struct<status:string,message:string,confidence:double>>)")), lambda k, _: k != rule)
    df = records.withColumn("old_verdict", F.col("verdict")).withColumn("old_ruleset", F.col("ruleset_version")).withColumn("rules", F.map_concat(others, failed))
    return df.withColumn("verdict", old_verdict(F.col("rules"))).withColumn("ruleset_version", F.lit(ruleset))


def migration(records: DataFrame, files: DataFrame, ruleset: str) -> tuple[DataFrame, DataFrame]:
    """What an old store needs: (records to extract anew, with source_path; records that fail outright for want of a source)."""
    todo = with_source(records.filter(~F.col("ruleset_version").eqNullSafe(F.lit(ruleset))), files)
    return todo.filter("source_path IS NOT NULL"), blanket_failed(todo.filter("source_path IS NULL").drop("source_path"), ruleset)


def migration_events(done: DataFrame, at: Column, path: str) -> DataFrame:
    return done.select(
        F.date_format(at, _TIME).alias("timestamp"), F.lit(MIGRATION).alias("event"), "record_id", F.col("old_ruleset").alias("from_ruleset"), F.col("ruleset_version").alias("to_ruleset"), "old_verdict",
        F.col("verdict").alias("new_verdict"), F.lit(path).alias("path"),
    )


def backfill(records: DataFrame, responses: DataFrame, images: DataFrame) -> DataFrame:
    """(record_id, source_file, plan): has_response, no_image or fetch; a response is found by stem, an image by name."""
    stems = responses.select(stem(F.col("path")).alias("_stem")).distinct().withColumn("_has", F.lit(True))
    names = images.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("_name")).distinct().withColumn("_image", F.lit(True))
    joined = records.select("record_id", "source_file").join(stems, stem(F.col("source_file")) == F.col("_stem"), "left").join(names, F.col("source_file") == F.col("_name"), "left")
    return joined.select("record_id", "source_file", F.when(F.col("_has"), "has_response").when(F.col("_image"), "fetch").otherwise("no_image").alias("plan"))


def changed_by_repeats(single: DataFrame, merged: DataFrame, fields: tuple[str, ...], key: str = "source_id") -> DataFrame:
    """(key, changed) of the sources whose fields' states differ between one run and the merged runs; sources of only one side are left out."""
    old = single.select(F.col(key).alias("_key"), *[F.col(f)["status"].alias(f"_{f}") for f in fields])
    joined = merged.join(old, F.col(key) == F.col("_key"), "inner")
    names = F.array_compact(F.array(*[F.when(~F.col(f)["status"].eqNullSafe(F.col(f"_{f}")), f) for f in fields]))
    return joined.select(key, names.alias("changed"), F.size(names).alias("n")).filter("n > 0").drop("n")
