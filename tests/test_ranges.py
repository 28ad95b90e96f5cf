"""Ranks and files to records on tables of a middling size: they are no single task."""

from pyspark.sql import functions as F

from draftlens.operators import sequence


def test_rows_below_a_range_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = sequence.LEAST * min(3, cores)
    df = spark.range(rows).select((F.col("id") * 7919 % rows).alias("n"), F.lit("day").alias("day"))
    assert sequence._in_ranges(df, ["day"], [F.col("n")], sequence.RANGE).select("_part").distinct().count() == min(3, cores)
    got = sequence.ranked(df, ["day"], [F.col("n")])
    assert got.filter(F.col("rank") != F.col("n") + 1).count() == 0 and got.count() == rows


def test_few_rows_are_one_range(spark):
    df = spark.range(50).select(F.col("id").alias("n"), F.lit("day").alias("day"))
    assert sequence._in_ranges(df, ["day"], [F.col("n")], sequence.RANGE).select("_part").distinct().count() == 1


def test_responses_are_dealt_before_they_are_parsed(spark, monkeypatch):
    from draftlens.operators import analyze

    seen = []
    monkeypatch.setattr(analyze, "parsed", lambda captured, f=analyze.parsed: seen.append(captured._jdf.queryExecution().optimizedPlan().toString()) or f(captured))
    files = spark.range(0, 20, 1, 1).select(F.concat(F.lit("/in/"), "id").alias("path"), F.lit(b"x").alias("content"), F.col("id").cast("string").alias("source_hash"))
    fields, _ = analyze.analyzed(files, lambda: lambda path, content: {"documents": [{"fields": {"PayTo": {"content": "x"}}}]}, 2, unicode=False)
    assert fields.count() == 20
    assert seen[0].startswith("RepartitionByExpression [source_file")
