"""Streams of trials against the same rows in a batch."""

from pyspark.sql import functions as F

from trialweave.streaming import running


def test_running_means(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(3):
        events.where(F.col("user_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "user_id bigint, event_type string, value double, ts timestamp"
    stream = running.arriving(spark, str(tmp_path / "in"), schema)
    running.to_table(running.running_means(stream, ["user_id", "event_type"], "value"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["user_id"], r["event_type"]): (round(r["mean"], 9), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["user_id"], r["event_type"]): (round(r["m"], 9), r["n"]) for r in events.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.count("value").alias("n")).collect()}
    assert got == want


def test_windowed_means(spark, tmp_path):
    """Closed windows come out once, with the means of all their rows; windows that may still get rows do not."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "user_id bigint, event_type string, value double, ts timestamp"
    windows = running.windowed_means(running.arriving(spark, str(tmp_path / "in"), schema), ["event_type"], "value", "ts", "1 day", "2 days")
    running.to_table(windows, str(tmp_path / "w"), str(tmp_path / "ck"), "append").awaitTermination(120)
    key = lambda r: (r["window"]["start"], r["event_type"])
    got = [(key(r), round(r["mean"], 9), r["n"]) for r in spark.read.parquet(str(tmp_path / "w")).collect()]
    last = events.agg(F.max("ts")).first()[0]
    every = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).collect()
    want = {key(r): (round(r["mean"], 9), r["n"]) for r in every}
    assert len({k for k, *_ in got}) == len(got) > 0
    assert all(want[k] == (m, n) for k, m, n in got)
    closed = {key(r) for r in every if (last - r["window"]["end"]).total_seconds() > 2 * 86400}
    assert closed <= {k for k, *_ in got} and len(got) < len(want) + 1
