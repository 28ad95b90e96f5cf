"""Report records: projection of validated documents, rebuilding from stored raw values, revalidation under another rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.fields import normalised
from .rules import Config, outcome, validated, verdict
from .store import standing

SCHEMA_VERSION = 2
#: Field of a record's confidence -> rule that it is taken from; both amounts have the amount rule's.
_CONFIDENCE = {"payee": "payee", "amount_numeric": "amount_match", "amount_words": "amount_match", "date": "date", "signature": "signature", "memo": "memo"}
_RAW = {"payee": "payee", "amount_numeric": "amount_numeric", "amount_words": "amount_words", "date": "cheque_date", "memo": "memo"}


def projected(df: DataFrame, ruleset: str, model: str | None = None, *extra: str) -> DataFrame:
    """A flat record of each validated document; record_id, processed_time, source_file, source_hash, rotation and ocr_verifications are kept if df has them."""
    kept = {"record_id": "string", "processed_time": "timestamp", "source_file": "string", "source_hash": "string", "rotation": "struct<direction:string,confident:boolean>", "ocr_verifications": "map<string,string>"}
    have = lambda n: F.col(n) if n in df.columns else F.lit(None).cast(kept[n])
    value = lambda n: F.col(n)["value"].cast("string")
    rule = lambda e: F.struct(e["status"].alias("status"), e["evidence"].alias("message"), e["confidence"].alias("confidence"))
    return df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), have("record_id").alias("record_id"), have("processed_time").alias("processed_time"),
        F.regexp_extract(have("source_file"), r"([^/]*)$", 1).alias("source_file"), have("source_hash").alias("source_hash"), F.lit(model).cast("string").alias("model"), F.lit(ruleset).alias("ruleset_version"), "verdict",
        F.col("payee.raw_text").alias("payee"), value("payee").alias("payee_normalized"), value("amount_numeric").alias("amount_numeric"), value("amount_words").alias("amount_words"), value("cheque_date").alias("cheque_date"),
        F.col("signature.value").alias("signature_detected"), value("memo").alias("memo"),
        have("rotation").alias("rotation"), have("rotation")["direction"].alias("rotation_direction"), have("rotation")["confident"].alias("rotation_confident"), have("ocr_verifications").alias("ocr_verifications"),
        F.struct(*[F.col("rules")[r]["confidence"].alias(n) for n, r in _CONFIDENCE.items()]).alias("confidence"),
        F.struct(*[F.col(c)["raw_text"].alias(n) for n, c in _RAW.items()]).alias("raw_values"),
        F.transform_values("rules", lambda _, v: rule(v)).alias("rules"), *extra,
    )


def pending(records: DataFrame, ruleset: str) -> DataFrame:
    """The records that another rule set, or none, has judged."""
    return records.filter(~F.col("ruleset_version").eqNullSafe(F.lit(ruleset)))


def rebuilt(records: DataFrame, date_order: str = "DMY", unicode: bool = True) -> DataFrame:
    """The six fields anew from a record's raw values and confidences; the signature has only its verdict. Second readings are not rebuilt."""
    raw = {"payee": "payee_raw", "amount_numeric": "figures_raw", "amount_words": "words_raw", "date": "date_raw", "memo": "memo_raw"}
    kept = ["record_id", "processed_time", "source_file", "source_hash", "rotation", F.col("ruleset_version").alias("old_ruleset"), F.col("verdict").alias("old_verdict")]
    names = {"payee": "payee", "amount_numeric": "amount_numeric", "amount_words": "amount_words", "date": "cheque_date", "signature": "signature", "memo": "memo"}
    confidence = F.struct(*[F.col("confidence")[n].alias(c) for n, c in names.items()]).alias("confidence")
    df = records.select(*kept, *[F.col("raw_values")[n].alias(c) for n, c in raw.items()], F.col("signature_detected").alias("signed"), confidence)
    return normalised(df, date_order, unicode)


def revalidated(records: DataFrame, overrides: DataFrame, ruleset: str, today: Column, cfg: Config | None = None, unicode: bool = True) -> DataFrame:
    """Records that other rule sets judged, judged anew, with standing overrides (record_id, rule, evidence) on top.

    An override makes its rule PASS; one of the signature also corrects the field. old_ruleset, old_verdict and overlaid are what the audit wants.
    Each rule has its own override's evidence; of several overrides of one rule ``store.standing`` says which counts.
    """
    one = standing(overrides, "evidence")
    per = one.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.coalesce("evidence", F.lit(""))))).alias("_why"))
    df = rebuilt(pending(records, ruleset), unicode=unicode).join(per, "record_id", "left")
    has = lambda r: F.coalesce(F.map_contains_key("_why", r if isinstance(r, Column) else F.lit(r)), F.lit(False))
    corrected = F.struct(F.lit(True).alias("value"), F.col("signature.raw_text"), F.lit(V.OK).alias("status"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("degraded"), F.col("signature.confidence"))
    df = df.withColumn("signature", F.when(has("signature"), corrected).otherwise(F.col("signature")))
    df = validated(df, today, cfg)
    over = F.transform_values("rules", lambda k, v: F.when(has(k), outcome(V.PASS, F.concat(F.lit("confirmed by a person: "), F.try_element_at("_why", k)), v["confidence"])).otherwise(v))
    df = df.withColumn("rules", over).withColumn("verdict", verdict(F.col("rules"))).withColumn("overlaid", F.col("_why").isNotNull())
    return projected(df, ruleset, None, "old_ruleset", "old_verdict", "overlaid")


def revalidation_events(records: DataFrame, at: Column) -> DataFrame:
    """Audit events of ``revalidated``."""
    return records.select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit("ruleset_revalidation").alias("event"), "record_id", F.col("old_ruleset").alias("from_ruleset"),
        F.col("ruleset_version").alias("to_ruleset"), "old_verdict", F.col("verdict").alias("new_verdict"), F.col("overlaid").alias("standing_override_reapplied"),
    )
