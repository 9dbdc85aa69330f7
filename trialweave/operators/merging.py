"""Chunks put together, series cut to one length, sub-scales, indicator rows, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_chunks(chunks: DataFrame, keys: list[str], value: str, name: str = "merged") -> DataFrame:
    """Counts and sums of chunks add up."""
    return chunks.groupBy(*keys).agg(F.sum(value).alias(name), F.count(value).alias("n_chunks"))


def mean_chunks(chunks: DataFrame, keys: list[str], value: str, name: str = "merged") -> DataFrame:
    """The mean of the chunks that have a value: one alone passes through, NULL and NaN count as none."""
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return chunks.groupBy(*keys).agg(F.avg(known).alias(name), F.count(known).alias("n_chunks"))


def same_length(trials: DataFrame, keys: list[str], series: str, number: str) -> DataFrame:
    """Each series of a key up to the length of the shortest of them; ``number`` counts from 1 in each."""
    lengths = trials.groupBy(*keys, series).agg(F.max(number).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_least"))
    return trials.join(lengths, keys).where(F.col(number) <= F.col("_least")).drop("_least")


def subscale(items: DataFrame, keys: list[str], item: str, value: str, wanted: list, factor: float = 2.0, name: str = "subscale") -> DataFrame:
    """``factor`` times the sum of the wanted items; NULL where one of them is missing."""
    held = items.where(F.col(item).isin(wanted))
    complete = F.count_distinct(F.when(F.col(value).isNotNull(), F.col(item))) == len(set(wanted))
    return held.groupBy(*keys).agg(F.when(complete, factor * F.sum(value)).alias(name))


def indicators(frames: DataFrame, keys: list[str], frame: str, marked: Column) -> DataFrame:
    """An indicator series for each marked frame, as rows: keys, spike (from 1), frame, value 1. All other frames of a series are 0 and not stored."""
    order = Window.partitionBy(*keys).orderBy(frame)
    return frames.where(marked).select(*keys, F.row_number().over(order).cast("bigint").alias("spike"), frame, F.lit(1).alias("value"))


def ranked(table: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank from the largest value, ties by name. For a table of regions."""
    return table.withColumn(name, F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(tie))).cast("bigint"))
