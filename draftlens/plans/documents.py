"""Documents derived from the benchmark tables by arithmetic alone, so that other engines can build them too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V

TODAY = "1998-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is read in fewer parts than there are; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _words(dollars: Column) -> Column:
    """0-9999 in words, thousands and hundreds apart."""
    names = F.split(F.lit(",".join(V.below_thousand())), ",")
    thousands, rest = ((dollars - dollars % 1000) / 1000).cast("int"), (dollars % 1000).cast("int")
    parts = F.array(F.when(thousands > 0, F.concat(F.element_at(names, thousands + 1), F.lit(" thousand"))), F.when(rest > 0, F.element_at(names, rest + 1)), F.when(dollars == 0, F.lit("zero")))
    return F.array_join(F.array_compact(parts), " ")


def documents(spark: SparkSession, sf_dir: str, named: bool = True) -> DataFrame:
    """One document for each order; ``k`` alone decides which class each field is of. Without ``named`` no customer is joined, and c_name and payee_raw are left out."""
    orders, customers = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("k")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint") % 1_000_000
    df = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left") if named else orders).withColumn("k", F.col("o_orderkey")).withColumn("cents", cents)
    df = df.withColumn("dollars", ((F.col("cents") - F.col("cents") % 100) / 100).cast("bigint")).withColumn("cc", F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    div = lambda n: ((k - k % n) / n).cast("bigint")
    names = ("The Town of Whitby", "TOWN OF WHITBY.", "Town of Whitty", "Whitby Taxes", None, "City of Oshawa", None, "Town of Witby")
    payee = F.when(k % 8 == 4, F.col("c_name"))
    for i, n in enumerate(names):
        if n is not None:
            payee = payee.when(k % 8 == i, n)
    d, cc = F.col("dollars").cast("string"), F.col("cc")
    grouped = F.when(F.col("dollars") >= 1000, F.concat(F.substring(d, F.lit(1), F.length(d) - 3), F.lit(","), F.substring(d, F.length(d) - 2, F.lit(3)))).otherwise(d)
    f = div(8) % 5
    figures = F.when(f == 0, F.concat(F.lit("$\n"), d, F.lit("."), cc)).when(f == 1, F.concat(F.lit("$ "), d)).when(f == 2, F.concat(F.lit("$"), grouped, F.lit("."), cc)).when(f == 3, F.concat(F.lit("$"), d, F.lit("."), cc, F.lit("1")))
    w = div(40) % 7
    plain = _words(F.col("dollars"))
    tens = _words((F.col("dollars") * 10) % 10_000)
    words = (
        F.when(w == 0, F.concat(plain, F.lit(" and xx/100 dollars")))
        .when(w == 1, F.concat(plain, F.lit(" dollars and "), F.element_at(F.split(F.lit(",".join(["zero", *V.below_thousand()[1:100]])), ","), (F.col("cents") % 100 + 1).cast("int")), F.lit(" cents")))
        .when(w == 2, F.concat(F.initcap(plain), F.lit(" "), cc, F.lit("/100 DOLLARS")))
        .when(w == 3, F.concat(F.replace(F.replace(plain, F.lit("ninety"), F.lit("ninty")), F.lit("hundred"), F.lit("hundered")), F.lit(" and "), cc, F.lit("/100")))
        .when(w == 4, F.concat(tens, F.lit(" dollars only")))
        .when(w == 5, F.lit("pay sihatred umblefrotz"))
    )
    day = F.to_date("o_orderdate")
    g = div(280) % 6
    month = F.element_at(F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))), F.month(day))
    date = (
        F.when(g == 0, F.date_format(day, "dd MM yyyy"))
        .when(g == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(g == 2, F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month, F.lit(" "), F.year(day).cast("string")))
        .when(g == 3, F.concat(F.date_format(day, "ddMM"), F.substring(F.year(day).cast("string"), 3, 2)))
        .when(g == 4, F.date_format(day, "dMMyyyy"))
    )
    signed = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "P", False)
    memo = F.when(k % 11 != 0, F.col("o_orderpriority"))
    return df.select("k", "dollars", "cents", *(("c_name", payee.alias("payee_raw")) if named else ()), figures.alias("figures_raw"), words.alias("words_raw"), date.alias("date_raw"), signed.alias("signed"), memo.alias("memo_raw"), F.col("o_orderpriority").alias("template"), day.alias("day"))
