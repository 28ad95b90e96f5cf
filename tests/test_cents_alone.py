"""Queries that judge amounts against their SQL, on orders whose figure is cents alone and whose words say "zero dollars only"."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

#: Each query judges amounts by rules.amount_rule.
JUDGING = (
    "override_evidence",
    "override_overlay",
    "record_projection",
    "revalidate",
    "revalidate_merged",
    "rule_matrix",
    "rule_status_counts",
    "store_counters",
    "template_refusals",
    "verdict_counts",
    "verdict_transitions",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Every class of payee, date and signature among keys whose words are tenfold and whose figures show cents."""
    folder = tmp_path_factory.mktemp("cents")
    k = F.col("o_orderkey")
    keys = spark.range(10_080).select(F.col("id").alias("o_orderkey")).filter((F.floor(k / 40) % 7 == 4) & (F.floor(k / 8) % 5).isin(0, 2))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    orders = keys.select(
        k, (k % 5).alias("o_custkey"), pick(("O", "O", "P", "F"), F.floor(k / 280)).alias("o_orderstatus"), (10_000 * (k % 40) + (k % 99 + 1) / 100).alias("o_totalprice"),
        pick(("1998-11-03", "1999-03-14", "1996-05-05"), k).cast("timestamp").alias("o_orderdate"), pick(("1-URGENT", "5-LOW"), k).alias("o_orderpriority"),
    )
    orders.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.range(5).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", JUDGING)
def test_cents_alone_as_in_sql(spark, tables, name):
    got = entry.queries()[name](spark, str(tables)).toPandas()
    with duckdb.connect() as con:
        for t in ("orders", "customer"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
        con.execute(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
        columns = ", ".join(r[0] for r in con.execute("DESCRIBE want").fetchall())
        assert con.execute("SELECT count(*) FROM want").fetchone()[0] == len(got)
        con.register("got", got)
        assert con.execute(f"SELECT {columns} FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []
