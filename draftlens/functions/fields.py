"""The six normalised fields of a document, each one struct<value, raw_text, status, note, degraded, confidence>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V
from .amounts import cents_of, figures, in_words
from .dates import parse_date
from .text import canonical_payee, clean, let, remembered

SIGNED = ("signed", "selected", "present")


def field(parsed: Column, confidence: Column | None = None) -> Column:
    """The parse's struct with confidence; evaluated as one, so that the optimizer does not copy the parse to each use."""
    conf = (F.lit(None) if confidence is None else confidence).cast("double")
    return let(parsed, lambda p: F.struct(*[p[n].alias(n) for n in ("value", "raw_text", "status", "note")], F.lit(False).alias("degraded"), conf.alias("confidence")))


def words_field(parsed: Column, confidence: Column | None = None) -> Column:
    conf = (F.lit(None) if confidence is None else confidence).cast("double")
    return let(parsed, lambda p: F.struct(*[p[n].alias(n) for n in ("value", "raw_text", "status", "note", "degraded")], conf.alias("confidence")))


def ok(f: Column) -> Column:
    """A value that may be used: OK or AMBIGUOUS."""
    return f["status"].isin(V.OK, V.AMBIGUOUS)


def payee(raw: Column, unicode: bool = True) -> Column:
    def read(text: Column) -> Column:
        blank = text == ""
        return F.struct(F.when(~blank, canonical_payee(text, False)).alias("value"), F.when(blank, raw).otherwise(text).alias("raw_text"), F.when(blank, V.ABSENT).otherwise(V.OK).alias("status"), F.lit(None).cast("string").alias("note"))

    return let(clean(raw, unicode), read)


def signature(raw: Column, detected: Column, ambiguous_reason: Column | None = None) -> Column:
    reason = F.lit(None).cast("string") if ambiguous_reason is None else ambiguous_reason
    return F.struct(
        F.when(reason.isNull(), detected).alias("value"), raw.alias("raw_text"), F.when(reason.isNotNull(), V.AMBIGUOUS).when(detected.isNull(), V.ABSENT).otherwise(V.OK).alias("status"),
        F.coalesce(reason, F.when(detected.isNull(), "no signature verdict")).alias("note"),
    )


def memo(raw: Column, present: Column | None = None) -> Column:
    blank = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " ")) == ""
    present = F.lit(True) if present is None else present
    return F.struct(F.when(~blank, F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")).alias("value"), raw.alias("raw_text"), F.when(blank, V.ABSENT).otherwise(V.OK).alias("status"), F.when(blank & ~present, "memo not returned by the extractor").alias("note"))


def normalised(df: DataFrame, date_order: str = "DMY", unicode: bool = True) -> DataFrame:
    """df with payee_raw, figures_raw, words_raw, date_raw, signed and memo_raw replaced by the six fields; without payee_raw, by the other five.

    The figures come first: their cents stand in for an unread printed suffix of the words. If df has them, ``confidence`` (a struct by field
    name), ``memo_present`` and ``signature_reason`` (why the verdict on the signature can't be told) are used and dropped too.
    """
    names = ("payee_raw", "figures_raw", "words_raw", "date_raw", "signed", "memo_raw")
    optional = [c for c in ("confidence", "memo_present", "signature_reason") if c in df.columns]
    conf = lambda name: F.col("confidence")[name] if "confidence" in optional else None
    column = lambda name: F.col(name) if name in optional else None
    built = lambda name, make: remembered(("field", name, date_order, unicode, *optional), make)
    df = df.withColumn("amount_numeric", built("amount_numeric", lambda: field(figures(F.col("figures_raw"), unicode), conf("amount_numeric"))))
    df = df.withColumn("_cents", F.when(ok(F.col("amount_numeric")), cents_of(F.col("amount_numeric.value"))))
    others = {
        "amount_words": lambda: words_field(in_words(F.col("words_raw"), F.col("_cents"), unicode), conf("amount_words")),
        "payee": lambda: field(payee(F.col("payee_raw"), unicode), conf("payee")),
        "cheque_date": lambda: field(parse_date(F.col("date_raw"), date_order, unicode), conf("cheque_date")),
        "signature": lambda: field(signature(F.lit(None).cast("string"), F.col("signed"), column("signature_reason")), conf("signature")),
        "memo": lambda: field(memo(F.col("memo_raw"), column("memo_present")), conf("memo")),
    }
    df = df.withColumns({name: built(name, make) for name, make in others.items() if name != "payee" or "payee_raw" in df.columns})
    return df.drop(*names, "_cents", *optional)
