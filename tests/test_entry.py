import __spark_entry__ as entry
from draftlens.streaming.ingest import ingest


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_adds_each_hash_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "store"
    schema = "source_hash string, path string"
    for rows in ([("a", "1"), ("a", "2"), ("b", "3")], [("b", "4"), ("c", "5")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        ingest(stream, str(target), str(tmp_path / "check"), lambda df: df, ["path"]).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(str(target)).collect()) == ["1", "3", "5"]
