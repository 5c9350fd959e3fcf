from pyspark.sql import functions as F

from seqpick.streaming import windows


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:01:00", "a", 1.0), (2, "2024-01-01 05:00:00", "a", 2.0), (3, "2024-01-03 00:00:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id int, t string, kind string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))

    def run(src):
        return windows.window_counts(windows.dedup_stream(src, ["event_id"]), ["kind"], "value")

    stream = run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r.start.date()), r.kind, r.n, r.total) for r in spark.sql("select * from counts").collect()}
    want = {(str(r.start.date()), r.kind, r.n, r.total) for r in run(df).collect()}
    assert got == {w for w in want if w[1] == "a"} and ("2024-01-01", "a", 2, 3.0) in got  # the last day is still open
