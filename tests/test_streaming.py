"""Streams give what the batch reading of all their rows gives."""

from leafmark.streaming import vault_labels


def test_last_labels_over_two_batches(spark, tmp_path):
    schema = "key long, label string, seq long"
    spark.createDataFrame([(1, f"l{i}", i) for i in range(40)] + [(2, "a", 1), (None, "x", 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = vault_labels.last_labels(stream).writeStream.outputMode("update").format("memory").queryName("labels").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, "l20", 50), (2, "b", 2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    rows = spark.table("labels").collect()
    last = {k: max((r["labels"] for r in rows if r["key"] == k), key=lambda v: (v[-1] in ("l20", "b"), len(v))) for k in (1, 2)}
    assert last[1] == [f"l{i}" for i in range(8, 40) if i != 20] + ["l20"] and last[2] == ["a", "b"]


def test_windowed_scores(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'a', 1.0D").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = vault_labels.windowed_scores(stream).writeStream.outputMode("append").format("memory").queryName("scores").option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.table("scores").collect()] == [("a", 1, 2.0)]
