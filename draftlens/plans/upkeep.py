"""Registered queries of second readings and of the store's upkeep, with their SQL. Classes follow from keys by arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import figures
from ..functions.fields import field, normalised
from ..operators import evaluate, reconcile, records, report, rules, second, upkeep
from ..operators.geometry import CropConfig
from ..sources import extractor
from ..sources.responses import raw_fields
from .documents import TODAY, documents, table
from .oracles import DOCUMENTS

_NO_REVIEWS = "record_id string, status string"


class Shades:
    """A recogniser for tests: what it reads depends on the shade of the crop's middle alone."""

    def generate(self, image: np.ndarray, field: str) -> tuple[str | None, float | None]:
        shade = int(image[image.shape[0] // 2, image.shape[1] // 2, 0])
        if shade < 20:
            raise ValueError("too dark")
        return " " if shade < 40 else f"CUSTOMER {shade}" if shade < 100 else "Town of Whitby", 0.5


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of one shade for each document, with boxes for payee and memo."""
    k = F.col("k")
    shade = (k % 200).cast("int")
    payee = F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat(F.when(k % 2 == 0, "CUSTOMER ").otherwise("Customer "), shade.cast("string"))).when(k % 3 == 1, "Town of Whitty").otherwise(F.col("c_name"))
    memo = F.when(k % 4 == 0, "Town of Whitby").when(k % 4 > 1, "Customer")
    made = lambda raw, conf: F.struct(raw.alias("value"), raw.alias("raw_text"), F.when(raw.isNull(), "ABSENT").otherwise("OK").alias("status"), conf.cast("double").alias("confidence"))
    box = lambda w: F.array(*[F.lit(float(x)) for x in (2, 2, 2 + w, 2, 2 + w, 8, 2, 8)])
    region = lambda polygon: F.array(F.struct(F.lit(1).alias("page"), polygon.alias("polygon")))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.lit(24.0).alias("width"), F.lit(20.0).alias("height"), F.lit("pixel").alias("unit")))
    df = documents(spark, sf_dir).select(
        k.cast("string").alias("record_id"), "k", made(payee, F.when(k % 10 != 9, (k % 10) / 10)).alias("payee"), made(memo, F.lit(None)).alias("memo"),
        F.struct(region(box(18)).alias("payee"), F.when(k % 19 != 0, region(F.when(k % 11 == 3, box(4)).otherwise(box(18)))).alias("memo")).alias("regions"), pages.alias("pages"), F.lit(24).alias("width"), F.lit(20).alias("height"),
        F.unhex(F.repeat(F.lpad(F.hex(shade), 2, "0"), F.lit(24 * 20 * 3))).alias("pixels"),
        second.turn_of(F.when(k % 17 == 0, 1).otherwise(24), F.lit(20), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("orientation unknown")).alias("turn"),
    )
    cut = CropConfig(least_area=100)
    cfg = second.SecondConfig(fields=("payee", "memo"), policy="low_confidence_only", crops={"payee": cut, "memo": cut})
    return second.verified(df, cfg, Shades, unicode=False)


def second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of every document read again, end to end."""
    return second.long(_second(spark, sf_dir)).select("record_id", "field", "crop", "run", "status", "manual_review")


def agreement_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both recognisers against a truth that a part of the documents has."""
    k = F.col("k")
    truth = documents(spark, sf_dir).filter(k % 5 < 2).select(k.cast("string").alias("record_id"), F.when(k % 5 == 0, "payee").otherwise("memo").alias("field"), F.lit("town of  whitby").alias("truth"))
    return evaluate.evaluated(second.long(_second(spark, sf_dir)), truth, ["payee", "memo", "amount_words"])


def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    status = lambda c: F.struct(c.alias("status"))
    rules_ = F.create_map(F.lit("payee"), status(F.when(k % 3 == 0, "FAIL").otherwise("PASS")), F.lit("date"), status(F.when(k % 5 == 0, "UNABLE").otherwise("PASS")))
    df = _second(spark, sf_dir).select(rules_.alias("rules"), F.lit("VALID").alias("verdict"), F.when(k % 2 == 0, F.col("ocr_verifications")).alias("ocr_verifications"))
    return report.verification_summary(df)


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A record for each customer, and files for a third of them; two neighbours are copies of one file."""
    k = F.col("c_custkey")
    hashed = F.sha2((k - k % 2).cast("string"), 256).alias("source_hash")
    name = F.concat(F.lit("f"), k.cast("string"), F.lit(".png"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    state = F.struct(F.when(k % 5 == 0, "FAIL").otherwise("PASS").alias("status"), F.lit("").alias("message"), F.lit(0.5).alias("confidence"))
    known = c.select(k.cast("string").alias("record_id"), name.alias("source_file"), hashed, F.when(k % 7 == 0, "2").otherwise("1").alias("ruleset_version"), F.when(k % 5 == 0, "INVALID").otherwise("VALID").alias("verdict"), F.create_map(F.lit("payee"), state).alias("rules"))
    return known, c.filter(k % 3 == 1).select(F.concat(F.lit("/in/"), name).alias("path"), hashed)


def migrate_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, files = _store(spark, sf_dir)
    again, failed = upkeep.migration(known, files, "2")
    memo = F.try_element_at("rules", F.lit("memo"))["status"]
    first = again.select("record_id", F.lit("extract").alias("plan"), "source_path", "verdict", F.col("verdict").alias("old_verdict"), memo.alias("memo"))
    return first.unionByName(failed.select("record_id", F.lit("fail").alias("plan"), F.lit(None).cast("string").alias("source_path"), "verdict", "old_verdict", memo.alias("memo")))


def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, files = _store(spark, sf_dir)
    answered = known.filter("cast(record_id as bigint) % 4 = 0").select(F.concat(F.lit("/raw/"), upkeep.stem(F.col("source_file")), F.lit(".json")).alias("path"))
    return upkeep.backfill(known, answered, files)


def images_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.paths_by_hash(_store(spark, sf_dir)[1]).select("source_hash", F.array_join("paths", " ").alias("paths"))


def reconciliation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first line's figure is no longer certain when all lines are taken as reads of it."""
    raw = F.concat(F.lit("$"), F.col("l_quantity").cast("bigint").cast("string"))
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("run"), field(figures(raw, False)).alias("amount_numeric"))
    merged = reconcile.reconciled(reads)
    single = reads.filter("l_linenumber = 1").groupBy("source_id").agg(F.min_by("amount_numeric", "run").alias("amount_numeric"))
    return upkeep.changed_by_repeats(single, merged, ("amount_numeric",)).select("source_id", F.array_join("changed", " ").alias("changed"))


def confirm_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payees and signatures that a person has seen; some were reviewed before and are left out."""
    today, k = F.lit(TODAY).cast("date"), F.col("k")
    cfg = rules.Config(evidence=False)
    base = normalised(documents(spark, sf_dir).withColumn("record_id", k.cast("string")), unicode=False)
    known = records.projected(rules.validated(base, today, cfg), "2")
    docs = documents(spark, sf_dir).select("k", k.cast("string").alias("record_id"))
    wanted = docs.filter(k % 4 == 1).select("record_id", F.explode(F.array(F.lit("payee"), F.lit("signature"))).alias("rule")).unionByName(docs.filter(k % 4 == 2).select("record_id", F.lit("payee").alias("rule")))
    wanted = wanted.select("record_id", "rule", F.lit("Town of Whitby").alias("seen"), F.lit("looked at").alias("note"))
    reviews = docs.filter(k % 8 == 1).select("record_id", F.lit(f"{upkeep.VISUAL}:payee").alias("status"))
    got = upkeep.confirmed(known, wanted, reviews, "2", today, cfg, unicode=False)
    return got.select("record_id", "old_verdict", F.col("verdict").alias("new_verdict"), "signature_detected", F.size("confirmed").alias("n_confirmed"))


def rotation_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("record_id"))
    known = c.select("record_id", F.lit(None).cast("struct<direction:string,confident:boolean>").alias("rotation"), F.lit(None).cast("string").alias("rotation_direction"), F.lit(None).cast("boolean").alias("rotation_confident"))
    turns = c.filter(k % 2 == 0).select("record_id", F.when(k % 6 == 0, "CW").when(k % 6 == 2, "CCW").otherwise("up").alias("direction"), F.lit("margin too small").alias("detector_note"))
    reviews = c.filter(k % 10 == 0).select("record_id", F.lit(f"{upkeep.ROTATION}:CCW").alias("status"))
    return upkeep.rotated(known, turns, reviews).select("record_id", "rotation_direction", "rotation_confident", "detector_note")


def _client():
    def call(path: str, content: bytes) -> dict:
        key = int(path.rsplit("/", 1)[1])
        if key % 13 == 0:
            raise TimeoutError(path)
        return {"documents": [{"fields": {"PayTo": {"valueString": bytes(content).decode(), "confidence": 0.25}}}]} if key % 5 else {"documents": []}

    return call


def extract_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls of an injected extractor for each file, with failures and answers without a document."""
    c = table(spark, sf_dir, "customer")
    files = c.select(F.concat(F.lit("/in/"), F.col("c_custkey").cast("string")).alias("path"), F.encode("c_name", "utf-8").alias("content"), F.sha2("c_name", 256).alias("source_hash"))
    got = raw_fields(extractor.parsed(extractor.extracted(files, _client, 2)))
    return got.select("source_file", "run", "payee_raw", F.col("confidence.payee").alias("confidence"), "call_error", "error")


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = _store(spark, sf_dir)
    k = F.col("record_id").cast("bigint")
    none = F.lit(None).cast("string")
    df = known.withColumn("signature_detected", F.when(k % 3 > 0, k % 3 == 1)).withColumn("rotation_direction", F.when(k % 2 == 0, "CW")).withColumn("rotation_confident", F.when(k % 4 == 0, False))
    df = df.withColumns({c: none for c in ("payee", "payee_normalized", "amount_numeric", "amount_words", "cheque_date", "memo", "processed_time")})
    return report.display_rows(df).select("record_id", "payee", "signature", "rotation", F.array_join(F.transform("rule_dots", lambda d: F.concat_ws(":", d["rule"], d["status"])), " ").alias("dots"))


def refused_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    labels = d.filter("k % 3 > 0").select(F.col("k").cast("string").alias("source_file"), "template")
    files = evaluate.labelled(d.select(F.col("k").cast("string").alias("source_file"), "k"), labels)
    return evaluate.refused_names(files, "template", "source_file", F.col("k") % 2 == 0)


_SECOND = """
WITH f AS (
  SELECT o_orderkey AS k, k % 200 AS v, 'payee' AS field, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'CUSTOMER ' ELSE 'Customer ' END || v WHEN k % 3 = 1 THEN 'Town of Whitty' ELSE c_name END AS a,
    k % 10 = 9 OR k % 10 < 7 AS wanted, 0 AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT o_orderkey AS k, k % 200 AS v, 'memo', CASE WHEN k % 4 = 0 THEN 'Town of Whitby' WHEN k % 4 > 1 THEN 'Customer' END, true, CASE WHEN k % 19 = 0 THEN 2 WHEN k % 11 = 3 THEN 1 ELSE 0 END FROM orders
), c AS (
  SELECT *, CASE WHEN NOT wanted OR k % 17 = 0 OR region = 2 THEN 'not_run' WHEN region = 1 THEN 'rejected' ELSE 'adjusted' END AS crop FROM f
), r AS (
  SELECT *, CASE WHEN NOT wanted THEN 'skipped' WHEN crop <> 'adjusted' THEN 'not_run' WHEN v < 20 THEN 'failed' WHEN v < 40 THEN 'undetermined' ELSE 'completed' END AS run FROM c
), b AS (
  SELECT *, CASE WHEN run = 'completed' THEN CASE WHEN v < 100 THEN 'CUSTOMER ' || v ELSE 'Town of Whitby' END WHEN run = 'undetermined' THEN ' ' END AS b FROM r
), s AS (
  SELECT *, CASE WHEN crop = 'rejected' THEN 'CROP_REJECTED' WHEN crop = 'not_run' AND run = 'not_run' THEN 'TROCR_NOT_RUN' WHEN run = 'failed' THEN 'TROCR_FAILED'
    WHEN run <> 'completed' THEN CASE WHEN a IS NULL THEN 'BOTH_UNDETERMINED' ELSE 'DI_ONLY' END WHEN a IS NULL THEN 'TROCR_ONLY' WHEN a = b THEN 'AGREE_EXACT' WHEN lower(a) = lower(b) THEN 'AGREE_NORMALIZED'
    WHEN field = 'payee' AND a = 'Town of Whitty' AND v >= 100 THEN 'AGREE_ALLOWLIST' ELSE 'DISAGREE' END AS status FROM b
), z AS (
  SELECT *, CASE WHEN status IN ('CROP_REJECTED', 'TROCR_NOT_RUN', 'TROCR_FAILED') THEN a IS NULL ELSE status IN ('BOTH_UNDETERMINED', 'TROCR_ONLY', 'DISAGREE') END AS manual_review,
    CASE WHEN field = 'payee' AND k % 5 = 0 OR field = 'memo' AND k % 5 = 1 THEN 'town of whitby' END AS truth FROM s
)
"""

_STORE = """
WITH k AS (SELECT c_custkey AS k, 'f' || c_custkey || '.png' AS source_file, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k - 1 END AS twin, CASE WHEN k % 5 = 0 THEN 'INVALID' ELSE 'VALID' END AS old FROM customer),
files AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 1)
"""

QUERIES = {
    f.__name__: f
    for f in (second_reading, agreement_truth, verification_summary, migrate_store, backfill_plan, images_by_hash, reconciliation_change, confirm_records, rotation_override, extract_repeated, display_rows, refused_names)
}

ORACLES = {
    "second_reading": _SECOND + "SELECT k::VARCHAR AS record_id, field, crop, run, status, manual_review FROM z",
    "agreement_truth": _SECOND + """, e AS (SELECT unnest(['payee', 'memo', 'amount_words']) AS field)
SELECT e.field, count(k) AS number_eligible, count(*) FILTER (run IN ('completed', 'failed', 'undetermined')) AS number_attempted,
  round(count(*) FILTER (crop = 'adjusted')::DOUBLE / nullif(count(k), 0), 4) AS crop_acceptance_rate,
  round(count(*) FILTER (run = 'completed')::DOUBLE / nullif(count(*) FILTER (run IN ('completed', 'failed', 'undetermined')), 0), 4) AS completion_rate,
  round(count(*) FILTER (status = 'AGREE_EXACT')::DOUBLE / nullif(count(k), 0), 4) AS exact_agreement_rate, round(count(*) FILTER (status = 'AGREE_NORMALIZED')::DOUBLE / nullif(count(k), 0), 4) AS normalized_agreement_rate,
  round(count(*) FILTER (status = 'AGREE_ALLOWLIST')::DOUBLE / nullif(count(k), 0), 4) AS allowlist_agreement_rate, round(count(*) FILTER (status = 'DISAGREE')::DOUBLE / nullif(count(k), 0), 4) AS disagreement_rate,
  round(count(*) FILTER (truth = lower(a))::DOUBLE / nullif(count(truth), 0), 4) AS primary_match_rate, round(count(*) FILTER (truth = lower(b))::DOUBLE / nullif(count(truth), 0), 4) AS second_match_rate,
  round(count(*) FILTER (truth = lower(a))::DOUBLE / nullif(count(truth), 0), 4) AS selected_match_rate,
  count(*) FILTER (status = 'DI_ONLY') AS primary_only_count, count(*) FILTER (status = 'BOTH_UNDETERMINED') AS both_undetermined_count, count(*) FILTER (crop = 'rejected') AS crop_rejected_count,
  count(*) FILTER (crop = 'not_run' AND run = 'not_run') AS not_run_count, count(*) FILTER (run = 'failed') AS failed_count, count(truth) AS ground_truth_scored, CASE WHEN count(truth) > 0 THEN 'accuracy' ELSE 'agreement' END AS analysis_kind
FROM e LEFT JOIN z ON e.field = z.field GROUP BY e.field""",
    "verification_summary": _SECOND + """, o AS (SELECT o_orderkey AS k FROM orders)
SELECT (SELECT count(*) FROM o) AS total, (SELECT count(*) FILTER (k % 2 = 0) FROM o) AS verified, count(*) FILTER (status = 'DISAGREE') AS disagreements, count(*) FILTER (status IN ('DI_ONLY', 'CROP_REJECTED', 'TROCR_NOT_RUN', 'TROCR_FAILED')) AS not_verified,
  (SELECT count(*) FILTER (k % 3 = 0) FROM o) AS rule_failures, (SELECT count(*) FILTER (k % 5 = 0) FROM o) AS rule_undetermined, count(*) FILTER (manual_review) AS to_review FROM z WHERE k % 2 = 0""",
    "migrate_store": _STORE + """, p AS (SELECT k.*, CASE WHEN a.k IS NOT NULL THEN '/in/f' || k.k || '.png' WHEN b.k IS NOT NULL THEN '/in/f' || k.twin || '.png' END AS source_path FROM k LEFT JOIN files a ON a.k = k.k LEFT JOIN files b ON b.k = k.twin WHERE k.k % 7 <> 0)
SELECT k::VARCHAR AS record_id, CASE WHEN source_path IS NULL THEN 'fail' ELSE 'extract' END AS plan, source_path, CASE WHEN source_path IS NULL THEN 'INVALID' ELSE old END AS verdict, old AS old_verdict, CASE WHEN source_path IS NULL THEN 'FAIL' END AS memo FROM p""",
    "backfill_plan": _STORE + "SELECT k::VARCHAR AS record_id, source_file, CASE WHEN k % 4 = 0 THEN 'has_response' WHEN k % 3 = 1 THEN 'fetch' ELSE 'no_image' END AS plan FROM k",
    "images_by_hash": _STORE + "SELECT sha256((k - k % 2)::VARCHAR) AS source_hash, string_agg('/in/f' || k || '.png', ' ' ORDER BY '/in/f' || k || '.png') AS paths FROM files GROUP BY 1",
    "reconciliation_change": "SELECT l_orderkey AS source_id, 'amount_numeric' AS changed FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity::BIGINT) > 1 AND count(*) FILTER (l_linenumber = 1) > 0",
    "confirm_records": DOCUMENTS + """, o AS (
  SELECT *, CASE WHEN k % 8 = 1 THEN [r_amount, r_payee, r_date, r_memo] WHEN k % 4 = 1 THEN [r_amount, r_date, r_memo] ELSE [r_amount, r_signature, r_date, r_memo] END AS now FROM v WHERE k % 4 IN (1, 2))
SELECT k::VARCHAR AS record_id, verdict AS old_verdict, CASE WHEN list_contains(now, 'FAIL') THEN 'INVALID' WHEN list_contains(now, 'UNABLE') THEN 'REVIEW' ELSE 'VALID' END AS new_verdict,
  CASE WHEN k % 4 = 1 OR o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'P' THEN false END AS signature_detected, CASE WHEN k % 8 = 5 THEN 2 ELSE 1 END AS n_confirmed FROM o""",
    "rotation_override": "SELECT c_custkey::VARCHAR AS record_id, CASE WHEN c_custkey % 6 = 0 THEN 'CW' ELSE 'CCW' END AS rotation_direction, true AS rotation_confident, 'margin too small' AS detector_note FROM customer WHERE c_custkey % 6 IN (0, 2) AND c_custkey % 10 <> 0",
    "extract_repeated": """SELECT '/in/' || c_custkey AS source_file, run::INT AS run, CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 5 <> 0 THEN c_name END AS payee_raw, CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 5 <> 0 THEN 0.25::DOUBLE END AS confidence,
  CASE WHEN c_custkey % 13 = 0 THEN 'TimeoutError' END AS call_error, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN 'no document detected' END AS error FROM customer, (VALUES (1), (2)) r(run)""",
    "display_rows": _STORE + "SELECT k::VARCHAR AS record_id, '—' AS payee, CASE k % 3 WHEN 0 THEN '—' WHEN 1 THEN 'Yes' ELSE 'No' END AS signature, CASE WHEN k % 4 = 0 THEN 'CW (unsure)' WHEN k % 2 = 0 THEN 'CW' ELSE '' END AS rotation, 'payee:' || CASE WHEN k % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS dots FROM k",
    "refused_names": "SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'unknown' END AS template, o_orderkey::VARCHAR AS name FROM orders WHERE o_orderkey % 2 = 0",
}
