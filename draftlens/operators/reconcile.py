"""Reconciliation of repeated reads of one source: agreement keeps the first read, disagreement keeps no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.fields import ok

FIELDS = ("payee", "amount_numeric", "amount_words", "cheque_date", "signature", "memo")


def reading(f: Column) -> Column:
    """What a run read: raw text, the value as text if it may be used, and the state."""
    return F.struct(f["raw_text"].cast("string").alias("raw_text"), F.when(ok(f), f["value"].cast("string")).alias("value"), f["status"].alias("status"))


def _with(f: Column, **changed: Column) -> Column:
    out = f
    for name, c in changed.items():
        out = out.withField(name, c)
    return out


def merged_field(runs: Column) -> Column:
    """runs: array of field structs in run order."""
    first = F.get(runs, F.lit(0))
    seen = F.array_distinct(F.transform(runs, lambda f: F.struct(f["status"].alias("s"), F.when(ok(f), f["value"].cast("string")).alias("v"))))
    note = F.concat(F.size(runs).cast("string"), F.lit(" repeat-extraction runs disagreed on this field"))
    return F.when(F.size(seen) <= 1, first).otherwise(_with(first, value=F.when(F.lit(False), first["value"]), status=F.lit(V.AMBIGUOUS), note=note))


def merged_words(runs: Column) -> Column:
    """Words: runs that could not be parsed don't disagree with those that could."""
    good = F.filter(runs, lambda f: f["status"] == V.OK)
    values = F.array_sort(F.array_distinct(F.transform(good, lambda f: f["value"].cast("string"))))
    first, best = F.get(runs, F.lit(0)), F.get(good, F.lit(0))
    none = _with(first, note=F.concat(F.lit("no run out of "), F.size(runs).cast("string"), F.lit(" produced a parseable amount"), F.coalesce(F.concat(F.lit(" ("), first["note"], F.lit(")")), F.lit(""))))
    differ = _with(best, value=F.when(F.lit(False), best["value"]), status=F.lit(V.AMBIGUOUS), note=F.concat(F.lit("runs disagreed: "), F.array_join(values, ", ")))
    return F.when(F.size(runs) == 1, first).when(F.size(values) == 0, none).when(F.size(values) == 1, best).otherwise(differ)


def reconciled(df: DataFrame, source: str = "source_id", run: str = "run") -> DataFrame:
    """One row for each source from its runs; readings keeps what each run read, in order.

    A source has a handful of runs, so its rows are gathered; sources spread over all tasks.
    """
    present = [c for c in FIELDS if c in df.columns]
    rows = F.sort_array(F.collect_list(F.struct(F.col(run).alias("_run"), *[F.col(c) for c in present]))).alias("_runs")
    grouped = df.groupBy(source).agg(rows)
    out = [F.col(source), F.size("_runs").alias("n_runs")]
    for c in present:
        runs = F.col("_runs")[c]
        merged = merged_words(runs) if c == "amount_words" else merged_field(runs)
        out += [merged.alias(c), F.transform(runs, reading).alias(f"{c}_readings")]
    return grouped.select(*out)
