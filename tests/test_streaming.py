"""Streams drained over what is there, against the batch operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenloom.streaming import bursts, inserts


def test_sessions_are_the_batch_bursts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(seconds=s)) for s in (0, 5, 10.000001, 30)] + [(2, start), (2, start + timedelta(seconds=4))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = bursts.drain(bursts.sessions(bursts.read_events(spark, str(tmp_path)), 5), "bursts_test").collect()
    assert sorted((r["dir"], r["n"]) for r in got) == [(1, 2), (2, 2)]


def test_insert_new(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start), ("a", start + timedelta(seconds=1)), ("b", start), ("c", start)]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    out = inserts.insert_new(stream, spark.createDataFrame([("b",)], "k string"), ["k"])
    query = out.writeStream.format("memory").queryName("inserts_test").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["k"] for r in spark.table("inserts_test").select(F.col("k")).collect()) == ["a", "c"]
