"""Views and aggregates over validated records, and their sinks."""

from __future__ import annotations

import html
import io
import json
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .sequence import beside

# fixed values: exported columns
EXPORTED = ("record_id", "payee", "amount_numeric", "cheque_date", "signature_detected", "memo", "verdict", "processed_time", "source_file")


def verdict_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in (V.VALID, V.REVIEW, V.INVALID)])


def rule_status_counts(df: DataFrame) -> DataFrame:
    return rule_matrix(df).groupBy("status").agg(F.sum("n").alias("n"))


def status_shares(df: DataFrame) -> DataFrame:
    """Share of each rule status in all of them; statuses that do not occur are left out."""
    counts = rule_status_counts(df)
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.join(F.broadcast(total)).select("status", "n", F.try_divide(F.col("n").cast("double"), F.col("_total")).alias("share")).filter("n > 0")


def rule_matrix(df: DataFrame, rules: tuple[str, ...] = V.RULES) -> DataFrame:
    """(rule, status, n), without statuses that don't occur.

    All counts come from one aggregate; a generator over the rules would have their expressions copied into the filters that it implies.
    """
    pairs = [(r, s) for r in rules for s in (V.PASS, V.FAIL, V.UNABLE)]
    counts = df.agg(*[F.count_if(F.col("rules")[r]["status"] == s).alias(f"n{i}") for i, (r, s) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("status"), F.col(f"n{i}").alias("n")) for i, (r, s) in enumerate(pairs)])
    return counts.select(F.inline(rows)).filter("n > 0")


def date_range(df: DataFrame, time: str = "processed_time") -> DataFrame:
    """One label: first and last day, a single day, or a dash."""
    t = F.try_to_timestamp(F.col(time))
    first, last = F.date_format(F.min(t), "yyyy-MM-dd"), F.date_format(F.max(t), "yyyy-MM-dd")
    return df.agg(F.when(first.isNull(), "—").when(first == last, first).otherwise(F.concat(first, F.lit(" – "), last)).alias("label"))


def years(df: DataFrame, date: str = "cheque_date") -> DataFrame:
    return df.select(F.substring(F.col(date).cast("string"), 1, 4).alias("year")).filter("year IS NOT NULL AND year <> ''").distinct().orderBy(F.desc("year"))


def filtered(df: DataFrame, verdict: str = "", year: str = "", low_rotation: bool = False, query: str = "") -> DataFrame:
    """The dashboard's filters; empty ones don't bind. An unknown rotation confidence is not low."""
    if verdict:
        df = df.filter(F.col("verdict") == verdict)
    if year:
        df = df.filter(F.substring(F.col("cheque_date").cast("string"), 1, 4) == year)
    if low_rotation:
        df = df.filter(F.col("rotation_confident") == False)  # noqa: E712
    if query:
        names = [F.coalesce(F.col(c), F.lit("")) for c in ("record_id", "payee", "source_file", "payee_normalized")]
        df = df.filter(F.contains(F.lower(F.concat_ws(" ", *names)), F.lit(query.strip().lower())))
    return df


def ordered(df: DataFrame, by: str = "processed_time", descending: bool = True) -> DataFrame:
    """Sorted as text, null as ''."""
    c = F.coalesce(F.col(by).cast("string"), F.lit(""))
    return df.orderBy(c.desc() if descending else c.asc())


def neighbours(df: DataFrame, order: list[Column], key: str = "record_id") -> DataFrame:
    """Place, previous and next record of a view of any size; the order must tell its rows apart."""
    return beside(df, [], order, key, "place").select(key, "place", "previous", "next")


def with_reviews(df: DataFrame, reviews: DataFrame) -> DataFrame:
    per = reviews.filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "reviewer", "status", "note"))).alias("reviews"))
    return df.join(per, "record_id", "left")


def ocr_summary(verifications: DataFrame) -> DataFrame:
    """Per record: disagreements, fields not verified and fields to review. verifications: (record_id, status, manual_review)."""
    missing = F.col("status").isin("DI_ONLY", "CROP_REJECTED", "TROCR_NOT_RUN", "TROCR_FAILED")
    return verifications.groupBy("record_id").agg(F.count_if(F.col("status") == "DISAGREE").alias("disagreements"), F.count_if(missing).alias("not_verified"), F.count_if("manual_review").alias("to_review"))


def guidance(df: DataFrame, table: Iterable[tuple[str, str, str]], rule: str, message: str) -> DataFrame:
    """df with advice: the first of (rule, part of the message, text) that fits; else the message itself."""
    out: Column = F.col(message)
    for r, part, text in reversed(list(table)):
        out = F.when((F.col(rule) == r) & F.contains(F.lower(F.col(message)), F.lit(part)), text).otherwise(out)
    return df.withColumn("advice", out)


def verification_summary(records: DataFrame) -> DataFrame:
    """One row over records (verdict, rules, ocr_verifications as map<string, struct<comparison: struct<status, manual_review, ...>, ...>>).

    to_review counts records that are not VALID or, if there are none, fields that a second reading wants reviewed.
    """
    found = F.coalesce(F.map_values("ocr_verifications"), F.expr("array()"))
    of = lambda *s: F.size(F.filter(found, lambda f: F.coalesce(f["comparison"]["status"].isin(*s), F.lit(False))))
    rule = lambda s: F.size(F.filter(F.map_values("rules"), lambda r: F.coalesce(r["status"] == s, F.lit(False))))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    counts = records.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(F.size("ocr_verifications"), F.lit(0)) > 0).alias("verified"), total(F.when(F.col("ocr_verifications").isNotNull(), of("DISAGREE"))).alias("disagreements"),
        total(F.when(F.col("ocr_verifications").isNotNull(), of("DI_ONLY", "CROP_REJECTED", "TROCR_NOT_RUN", "TROCR_FAILED"))).alias("not_verified"),
        total(F.when(F.col("rules").isNotNull(), rule(V.FAIL))).alias("rule_failures"), total(F.when(F.col("rules").isNotNull(), rule(V.UNABLE))).alias("rule_undetermined"), F.count_if(~F.col("verdict").eqNullSafe(F.lit(V.VALID))).alias("_not_valid"),
        total(F.when(F.col("ocr_verifications").isNotNull(), F.size(F.filter(found, lambda f: F.coalesce(f["comparison"]["manual_review"], F.lit(False)))))).alias("_flagged"),
    )
    return counts.withColumn("to_review", F.when(F.col("_not_valid") > 0, F.col("_not_valid")).otherwise(F.col("_flagged"))).drop("_not_valid", "_flagged")


def score_text(evidence: Column, score: Column) -> Column:
    """A recogniser's score as shown: nothing that was not measured looks like a probability."""
    return F.when(F.coalesce(evidence == "raw_generation_evidence", F.lit(False)) & score.isNotNull(), F.format_string("%.3f (raw, not calibrated)", score)).otherwise("Not calibrated")


def display_rows(df: DataFrame, order: tuple[str, ...] = V.RULES) -> DataFrame:
    """The dashboard's columns of each record: dots of the rules in their order, absent ones left out, and words for what is unknown."""
    dots = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), F.try_element_at("rules", F.lit(r))["status"].alias("status")) for r in order]), lambda d: d["status"].isNotNull())
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    signed = F.when(F.col("signature_detected"), "Yes").when(~F.col("signature_detected"), "No").otherwise("—")
    badge = F.when(F.col("rotation_direction").isNull(), "").when(F.coalesce("rotation_confident", F.lit(True)), F.col("rotation_direction")).otherwise(F.concat(F.col("rotation_direction"), F.lit(" (unsure)")))
    return df.select("record_id", *[shown(c) for c in ("payee", "payee_normalized", "amount_numeric", "amount_words", "cheque_date", "memo", "verdict", "processed_time", "source_file")], signed.alias("signature"), badge.alias("rotation"), dots.alias("rule_dots"))


def script_json(rows: list[dict]) -> str:
    """Rows as JSON that can stand in a script element."""
    return json.dumps(rows, ensure_ascii=False, default=str).replace("</", "<\\/")


def verification_page(summary: dict[str, int], rows: list[dict]) -> str:
    """A page of second readings: totals and one line for each field of a view's records."""
    return dashboard(summary, "Second readings", rows, ("record_id", "field", "status", "primary", "second", "score"))


def summary_text(df: DataFrame) -> DataFrame:
    """A line for the verdict and one for each rule."""
    lines = F.transform(F.map_entries("rules"), lambda e: F.format_string("  %-7s %-13s %s", e["value"]["status"], e["key"], F.coalesce(e["value"]["evidence"], F.lit(""))))
    return df.withColumn("summary", F.array_join(F.concat(F.array(F.col("verdict")), lines), "\n"))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = EXPORTED) -> None:
    df.select(*[F.col(c).cast("string") for c in columns]).write.mode("overwrite").option("quoteAll", True).option("header", True).csv(path)


def write_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def dashboard(counts: dict[str, int], label: str, rows: list[dict], columns: tuple[str, ...]) -> str:
    """A page of totals and one view's rows, escaped; it renders what a person looks at, not the table."""
    cell = lambda x: html.escape("—" if x is None else str(x), quote=True)
    totals = "".join(f"<li>{cell(k)}: {v}</li>" for k, v in counts.items())
    head = "".join(f"<th>{cell(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><meta charset='utf-8'><h1>{cell(label)}</h1><ul>{totals}</ul><table><tr>{head}</tr>{body}</table>"


def workbook(rows: list[dict], columns: tuple[str, ...] = EXPORTED) -> bytes:
    """A one-sheet XLSX of inline strings."""
    cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape("" if x is None else str(x))}</t></is></c>'
    lines = [columns, *([r.get(c) for c in columns] for r in rows)]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(map(cell, x)) + "</row>" for x in lines) + "</sheetData></worksheet>"
    ns = "http://schemas.openxmlformats.org/package/2006/"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="records" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()
