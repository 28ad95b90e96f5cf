"""A second recogniser's reading against the first. It never changes a primary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, similarity, tokens, within_distance

# fixed values: comparison outcomes, in order of priority
COMPARISONS = ("CROP_REJECTED", "TROCR_NOT_RUN", "TROCR_FAILED", "BOTH_UNDETERMINED", "DI_ONLY", "TROCR_ONLY", "AGREE_EXACT", "AGREE_NORMALIZED", "AGREE_ALLOWLIST", "DISAGREE")
#: Confidence below which a field is read again.
THRESHOLD = 0.7


POLICIES = ("disabled", "always_on_eligible_fields", "low_confidence_only", "handwritten_or_low_confidence")
#: Fields that are never read again, whatever the configuration says: no reliable region, or nothing to compare with.
NEVER = frozenset(["signature", "bank_name", "bank_address", "micr", "full_image", "amount_numeric", "cheque_date"])


def eligible(fields: tuple[str, ...]) -> tuple[str, ...]:
    """The fields, if none of them is one that is never read again."""
    if bad := NEVER & set(fields):
        raise ValueError(f"never eligible: {sorted(bad)}")
    return fields


def triggered(policy: str, field: Column, confidence: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Whether a second reading is wanted."""
    if policy not in POLICIES:
        raise ValueError(f"unknown trigger policy {policy!r}")
    if policy in POLICIES[:2]:
        return F.lit(policy == POLICIES[1])
    limit: Column = F.lit(THRESHOLD)
    for name, x in (thresholds or {}).items():
        limit = F.when(field == name, x).otherwise(limit)
    return confidence.isNull() | (confidence < limit)


def compared(primary_ok: Column, primary_raw: Column, primary: Column, crop: Column, run: Column, raw: Column, second: Column, expected: Column | None = None, tolerance: int = 2) -> Column:
    """struct<status, manual_review, similarity, selected>; expected: a word that settles spelling differences."""
    usable = F.coalesce((run == "completed") & (F.trim(raw) != ""), F.lit(False))
    listed = F.lit(False)
    if expected is not None:
        near = lambda c: F.exists(tokens(F.coalesce(c, F.lit(""))), lambda t: F.levenshtein(t, expected) <= tolerance)
        listed = F.coalesce(near(primary) & near(second), F.lit(False))
    text = lambda c: F.coalesce(c, F.lit(""))
    status = (
        F.when(crop == "rejected", "CROP_REJECTED")
        .when((crop == "not_run") & (run == "not_run"), "TROCR_NOT_RUN")
        .when(run == "failed", "TROCR_FAILED")
        .when(~usable, F.when(primary_ok, "DI_ONLY").otherwise("BOTH_UNDETERMINED"))
        .when(~primary_ok, "TROCR_ONLY")
        .when(F.trim(text(primary_raw)) == F.trim(text(raw)), "AGREE_EXACT")
        .when(F.coalesce(primary == second, F.lit(False)), "AGREE_NORMALIZED")
        .when(listed, "AGREE_ALLOWLIST")
        .otherwise("DISAGREE")
    )

    def result(s: Column) -> Column:
        review = F.when(s.isin("CROP_REJECTED", "TROCR_NOT_RUN", "TROCR_FAILED"), ~primary_ok).otherwise(s.isin("BOTH_UNDETERMINED", "TROCR_ONLY", "DISAGREE"))
        alike = F.when(s == "AGREE_EXACT", 1.0).when(s.isin("AGREE_NORMALIZED", "AGREE_ALLOWLIST", "DISAGREE"), similarity(primary_raw, raw))
        return F.struct(s.alias("status"), review.alias("manual_review"), alike.alias("similarity"), primary_raw.alias("selected"))

    return let(status, result)


def names_expected(words: Column, expected: str, tolerance: int) -> Column:
    return F.coalesce(within_distance(tokens(words), expected, tolerance), F.lit(False))
