from test_rejects import frame, record

from zonalis.streaming.deliveries import load_stream


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, texts in enumerate(([record(), record(denue_id="x")], [record(latitud="91"), record(denue_id="5"), None])):
        frame(spark, texts).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    q = load_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert sorted(r["denue_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [5, 7]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3
