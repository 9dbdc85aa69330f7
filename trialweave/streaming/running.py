"""Means of trials that arrive in files: Structured Streaming keeps sums, so each batch costs what it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_means(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and count so far; state is one row for each key."""
    return stream.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def windowed_means(stream: DataFrame, keys: list[str], value: str, time: str, length: str, late: str) -> DataFrame:
    """Means in windows of time; rows later than ``late`` behind the newest are left out, and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write what is there now and stop: complete results replace the table, appended ones are added, each batch once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
