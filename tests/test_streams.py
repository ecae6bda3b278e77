from pyspark.sql import functions as F

from flockpoint.streaming.features import windowed_features

#: One file a batch. Spark drops late rows by the watermark of the batch before, so the late row comes in the third.
BATCHES = [
    [("2024-01-01 10:00:00", 1.0), ("2024-01-03 00:00:00", 2.0)],
    [("2024-01-03 01:00:00", 4.0)],
    [("2024-01-01 11:00:00", 8.0), ("2024-01-05 00:00:00", 16.0)],
]


def test_late_rows_are_left_out(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for rows in BATCHES:
        df = spark.createDataFrame(rows, "ts string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    days = windowed_features(stream, "ts", ["value"], 50.0, "1 day").select("window_start", "n", "ls")
    run = days.writeStream.outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).format("parquet").start(out)
    run.awaitTermination()
    got = {r["window_start"].day: (r["n"], r["ls"]) for r in spark.read.parquet(out).collect()}
    # the last day is still open
    assert got == {1: (1, [1.0]), 3: (2, [6.0])}
