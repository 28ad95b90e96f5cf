"""Accuracy against truth, agreement of two recognisers, regressions and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import medians


TEXT_FIELDS = ("payee", "amount_words", "memo")


def comparable(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def equal(field: str, truth: Column, found: Column) -> Column:
    """Whether a found value counts as the truth's: money as numbers, signatures as booleans (null is false), texts loosely."""
    if field.startswith("amount_numeric"):
        return F.coalesce(truth.cast("string").try_cast("decimal(38,2)") == found.cast("string").try_cast("decimal(38,2)"), F.lit(False))
    if field == "signature":
        return F.coalesce(truth, F.lit(False)) == F.coalesce(found, F.lit(False))
    return F.coalesce(comparable(truth.cast("string")) == comparable(found.cast("string")), F.lit(False))


def accuracy(truth: DataFrame, records: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """(field, scored, matched, pct) for each field and OVERALL; a null truth is not scored."""
    t = truth.select(key, *[F.col(f).alias(f"_t_{f}") for f in fields])
    r = records.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = t.join(r, F.col(key) == F.col("_key"), "inner")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_t_{f}").isNotNull().alias("scored"), (F.col(f"_t_{f}").isNotNull() & equal(f, F.col(f"_t_{f}"), F.col(f"_r_{f}"))).alias("matched")) for f in fields]))
    long = joined.select(cells.alias("c")).select("c.*")
    out = long.rollup("field").agg(F.count_if("scored").alias("scored"), F.count_if("matched").alias("matched"))
    return out.select(F.coalesce("field", F.lit("OVERALL")).alias("field"), "scored", "matched", F.round(F.try_divide(F.col("matched") * 100.0, F.col("scored")), 1).alias("pct"))


def grid(truth: DataFrame, records: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """Y, N or - for each field of the truth's records that there are; ``missing`` lists the others."""
    r = records.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = truth.join(r, F.col(key) == F.col("_key"), "inner")
    return joined.select(key, *[F.when(F.col(f).isNull(), "-").when(equal(f, F.col(f), F.col(f"_r_{f}")), "Y").otherwise("N").alias(f) for f in fields])


def agreement(verifications: DataFrame, fields: list[str]) -> DataFrame:
    """Per field the counts and rates of comparison outcomes; fields without rows are reported too.

    verifications: (field, status, primary_ok, manual_review).
    """
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counted = verifications.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if("primary_ok").alias("primary_read"), n("AGREE_EXACT").alias("agree_exact"), n("AGREE_NORMALIZED").alias("agree_normalized"), n("AGREE_ALLOWLIST").alias("agree_allowlist"),
        n("DISAGREE").alias("disagree"), n("DI_ONLY").alias("primary_only"), n("TROCR_ONLY").alias("second_only"), n("BOTH_UNDETERMINED").alias("undetermined"), n("CROP_REJECTED").alias("crop_rejected"),
        n("TROCR_FAILED").alias("failed"), n("TROCR_NOT_RUN").alias("not_run"), F.count_if("manual_review").alias("manual_review"),
    )
    spark = verifications.sparkSession
    every = spark.createDataFrame([(f,) for f in fields], "field string").join(counted, "field", "left").na.fill(0)
    both = F.col("agree_exact") + F.col("agree_normalized") + F.col("agree_allowlist") + F.col("disagree")
    rate = lambda a, b: F.bround(F.try_divide(a.cast("double"), b), 4)
    return every.withColumn("compared", both).withColumn("agreement_rate", rate(both - F.col("disagree"), both)).withColumn("disagreement_rate", rate(F.col("disagree"), both)).withColumn("coverage_rate", rate(both, F.col("n")))


def loosely_equal(field: Column, truth: Column, found: Column) -> Column:
    """Whether a reading counts as the truth's, with the field's name in a column: money as numbers, texts loosely."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"[$,\s]", "").try_cast("decimal(38,2)")
    money = F.startswith(field, F.lit("amount")) & number(truth).isNotNull() & number(found).isNotNull()
    return F.when(money, number(truth) == number(found)).otherwise(F.coalesce(comparable(truth.cast("string")) == comparable(found.cast("string")), F.lit(False)))


def evaluated(verifications: DataFrame, truth: DataFrame, fields: list[str]) -> DataFrame:
    """Both recognisers per field, as agreement, and as accuracy where there is truth.

    verifications: (record_id, field, crop, run, status, primary, second, selected); truth: (record_id, field, truth), one row for each at most.
    Rates are over all rows of the field, completion over those that were attempted, matches over those with a truth; null over nothing.
    """
    t = truth.filter(F.col("truth").isNotNull()).select(F.col("record_id").alias("_id"), F.col("field").alias("_field"), "truth")
    df = verifications.join(t, (F.col("record_id") == F.col("_id")) & (F.col("field") == F.col("_field")), "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status, scored = F.col("status"), F.col("truth").isNotNull()
    match = lambda c: n(scored & F.col(c).isNotNull() & loosely_equal(F.col("field"), F.col("truth"), F.col(c)))
    counted = df.groupBy("field").agg(
        F.count("*").alias("number_eligible"), n(F.col("run").isin("completed", "failed", "undetermined")).alias("number_attempted"), n(F.col("crop").isin("accepted", "adjusted")).alias("_cropped"), n(F.col("run") == "completed").alias("_completed"),
        *[n(status == s).alias(c) for c, s in (("_exact", "AGREE_EXACT"), ("_normalized", "AGREE_NORMALIZED"), ("_listed", "AGREE_ALLOWLIST"), ("_disagree", "DISAGREE"), ("primary_only_count", "DI_ONLY"), ("both_undetermined_count", "BOTH_UNDETERMINED"))],
        n(F.col("crop") == "rejected").alias("crop_rejected_count"), n((F.col("crop") == "not_run") & (F.col("run") == "not_run")).alias("not_run_count"), n(F.col("run") == "failed").alias("failed_count"),
        n(scored).alias("ground_truth_scored"), match("primary").alias("_primary"), match("second").alias("_second"), match("selected").alias("_selected"),
    )
    every = verifications.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(counted, "field", "left").na.fill(0)
    rate = lambda a, b: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    shares = (("crop_acceptance_rate", "_cropped", "number_eligible"), ("completion_rate", "_completed", "number_attempted"), ("exact_agreement_rate", "_exact", "number_eligible"), ("normalized_agreement_rate", "_normalized", "number_eligible"),
              ("allowlist_agreement_rate", "_listed", "number_eligible"), ("disagreement_rate", "_disagree", "number_eligible"), ("primary_match_rate", "_primary", "ground_truth_scored"), ("second_match_rate", "_second", "ground_truth_scored"),
              ("selected_match_rate", "_selected", "ground_truth_scored"))
    return every.select(
        "field", "number_eligible", "number_attempted", *[rate(a, b).alias(c) for c, a, b in shares], "primary_only_count", "both_undetermined_count", "crop_rejected_count", "not_run_count", "failed_count", "ground_truth_scored",
        F.when(F.col("ground_truth_scored") > 0, "accuracy").otherwise("agreement").alias("analysis_kind"),
    )


def write_evaluation(df: DataFrame, folder: str) -> None:
    """The evaluation as JSON lines and as CSV."""
    df.write.mode("overwrite").json(f"{folder}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def missing(truth: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Keys of the truth, or of an older extraction, that the records don't have."""
    return truth.select(key).join(records.select(key), key, "left_anti")


def regressions(now: DataFrame, baseline: DataFrame, falling: tuple[str, ...] = ("disagreement_rate",), epsilon: float = 0.001) -> DataFrame:
    """(field, metric, delta, regressed) of two long tables (field, metric, value); falling metrics regress when they rise."""
    joined = now.alias("n").join(baseline.alias("b"), ["field", "metric"]).filter("n.value IS NOT NULL AND b.value IS NOT NULL")
    delta = F.bround(F.col("n.value") - F.col("b.value"), 4)
    worse = F.when(F.col("metric").isin(*falling), delta > epsilon).otherwise(delta < -epsilon)
    return joined.select("field", "metric", delta.alias("delta"), worse.alias("regressed"))


def unpivoted(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(key, "m.metric", "m.value")


def transitions(old: DataFrame, new: DataFrame, field: str, key: str = "stem") -> DataFrame:
    """Counts of a field's state going from not OK to OK (improved), back (regressed) or staying; confidence up, down, flat or missing."""
    o = old.select(key, F.col(f"{field}.status").alias("so"), F.col(f"{field}.confidence").alias("co"))
    n = new.select(key, F.col(f"{field}.status").alias("sn"), F.col(f"{field}.confidence").alias("cn"))
    was, now = F.col("so") == "OK", F.col("sn") == "OK"
    d = F.col("cn") - F.col("co")
    return o.join(n, key).agg(
        F.count_if(~was & now).alias("improved"), F.count_if(was == now).alias("unchanged"), F.count_if(was & ~now).alias("regressed"),
        F.count_if(d > 1e-9).alias("confidence_up"), F.count_if(d < -1e-9).alias("confidence_down"), F.count_if(F.abs(d) <= 1e-9).alias("confidence_flat"), F.count_if(d.isNull()).alias("confidence_skipped"),
    )


def calibration(values: DataFrame, value: str, positive: str, threshold: float) -> DataFrame:
    """Spread of real and negative samples, and whether the threshold lies in the gap between them."""
    v, p = F.col(value), F.col(positive)
    stats = values.agg(
        F.count_if(p).alias("n_real"), F.min(F.when(p, v)).alias("least_real"), F.avg(F.when(p, v)).alias("mean_real"),
        F.count_if(~p).alias("n_negative"), F.max(F.when(~p, v)).alias("most_negative"), F.count_if(v > threshold).alias("n_present"),
    )
    middle = medians(values.filter(p), v, [], "median_real").select("median_real")  # one row, or none
    stats = stats.join(F.broadcast(middle), F.lit(True), "left")
    return stats.withColumn("separation", F.col("least_real") - F.col("most_negative")).withColumn("inside", (F.lit(threshold) > F.col("most_negative")) & (F.lit(threshold) < F.col("least_real")))


def refusals(df: DataFrame, template: str, name: str, refused: Column) -> DataFrame:
    """Per template the number of refused documents and the first and last of their names; ``refused_names`` lists them all."""
    return df.filter(refused).groupBy(F.coalesce(F.col(template), F.lit("unknown")).alias("template")).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last"))


def refused_names(df: DataFrame, template: str, name: str, refused: Column) -> DataFrame:
    """(template, name) of every refused document; rows and no list, so that a template of many refusals is no single value."""
    return df.filter(refused).select(F.coalesce(F.col(template), F.lit("unknown")).alias("template"), F.col(name).alias("name"))


def labelled(df: DataFrame, labels: DataFrame, key: str = "source_file", label: str = "template") -> DataFrame:
    """df with the template of its file, or unknown; of several labels of one file the least."""
    one = labels.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    return df.join(one, F.col(key) == F.col("_key"), "left").withColumn(label, F.coalesce("_label", F.lit("unknown"))).drop("_key", "_label")
