"""Readers of event, label, confound and clinical tables, and writers of maps and reports.

Everything goes through Spark's own readers, so paths may be in any store that Spark reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which event files keep the condition, in order of preference.
CONDITION_COLUMNS = ["trial_type", "condition", "event_type", "type", "stimulus", "trial"]


def separator(spark: SparkSession, path: str, sample: int = 1024) -> str:
    """Tab if the first characters of the file hold more tabs than commas, else comma."""
    rows = spark.read.text(path).limit(64).collect()
    head = "\n".join(r["value"] for r in rows)[:sample]
    return "\t" if head.count("\t") > head.count(",") else ","


def delimited(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A comma or tab separated file with a header."""
    reader = spark.read.options(header=True, sep=separator(spark, path), **options)
    return (reader.schema(schema) if schema else reader).csv(path)


def condition_column(df: DataFrame) -> str:
    """The first known name, else the first column that is not numeric."""
    for name in CONDITION_COLUMNS:
        if name in df.columns:
            return name
    for name, kind in df.dtypes:
        if kind == "string":
            return name
    raise ValueError("no column can hold the condition")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def events(df: DataFrame, override: DataFrame | None = None, key: str = "subject") -> DataFrame:
    """Events with ``usable`` (1 where the column or value is missing); a subject with rows in ``override`` has only these."""
    if override is not None:
        df = df.join(override.select(key).distinct(), key, "left_anti").unionByName(override, allowMissingColumns=True)
    if "usable" not in df.columns:
        return df.withColumn("usable", F.lit(1))
    return df.withColumn("usable", F.coalesce(F.expr("try_cast(usable as int)"), F.lit(1)))


def subject_id(column: Column | str) -> Column:
    """Trimmed, without a leading ``sub-`` and a trailing ``.0`` of a number."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.regexp_replace(F.regexp_replace(c, "^sub-", ""), r"^([0-9]+)\.0$", "$1")


def numbered_labels(spark: SparkSession, path: str) -> DataFrame:
    """One label a line, blank lines and ``#`` comments left out, with ids from 1. The file is a small table."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("label_id"), F.trim("value").alias("label"))


def region_name(column: Column | str) -> Column:
    """``NAME-rh`` to ``rh_NAME``, ``7Networks_LH_Area_3`` to ``lh_Area-3``."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    side = F.lower(F.regexp_extract(c, r"(?i)^(.+)-([lr]h)$", 2))
    network = r"(?i)^[0-9]+Networks_([LR])H_(.+)$"
    rest = F.regexp_replace(F.regexp_extract(c, network, 2), r"_([0-9]+)$", "-$1")
    return F.when(side != "", F.concat(side, F.lit("_"), F.regexp_extract(c, r"(?i)^(.+)-([lr]h)$", 1))).when(F.regexp_extract(c, network, 1) != "", F.concat(F.lower(F.regexp_extract(c, network, 1)), F.lit("h_"), rest)).otherwise(c)


def fixed_durations(df: DataFrame) -> DataFrame:
    """A duration of 0 becomes 0.1; onsets and durations to three decimals."""
    return df.withColumn("duration", F.round(F.when(F.col("duration") == 0, 0.1).otherwise(F.col("duration")), 3)).withColumn("onset", F.round("onset", 3))


def first_split(df: DataFrame, keys: list[str], condition: str, value: str, order: str) -> DataFrame:
    """Trials of one condition become ``value_first`` and ``value_others``, where there is more than one."""
    w = Window.partitionBy(*keys, condition)
    here = (F.col(condition) == value) & (F.count(F.lit(1)).over(w) > 1)
    name = F.when(F.row_number().over(w.orderBy(order)) == 1, value + "_first").otherwise(value + "_others")
    return df.withColumn("split_condition", F.when(here, name).otherwise(F.col(condition)))


def spikes(df: DataFrame, frame: str = "frame", fd: str = "framewise_displacement", dvars: str = "dvars", fd_limit: float = 0.5, spread: float = 1.5) -> DataFrame:
    """Frames whose displacement is over a limit, or whose signal change is over the mean by ``spread`` deviations; missing values are 0."""
    filled = df.select(frame, F.coalesce(fd, F.lit(0.0)).alias("_fd"), F.coalesce(dvars, F.lit(0.0)).alias("_dv"))
    limit = filled.agg((F.avg("_dv") + spread * F.stddev_samp("_dv")).alias("_limit"))
    return filled.crossJoin(F.broadcast(limit)).where((F.col("_fd") > fd_limit) | (F.col("_dv") > F.col("_limit"))).select(frame)


def complete(found: DataFrame, expected: int, key: str = "chunk") -> None:
    """Raise if chunks 0 to expected - 1 are not all there."""
    spark = found.sparkSession
    missing = spark.range(expected).withColumnRenamed("id", key).join(found.select(key).distinct(), key, "left_anti")
    if gone := [r[key] for r in missing.limit(20).collect()]:
        raise ValueError(f"chunks are missing: {gone}")


def write_maps(maps: DataFrame, path: str, *partitions: str) -> None:
    maps.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_significant(df: DataFrame, path: str, q: str = "q", alpha: float = 0.05) -> None:
    """Rows with q up to alpha as CSV with a header, also where there are none."""
    df.where(F.col(q).isNotNull() & ~F.isnan(q) & (F.col(q) <= alpha)).write.mode("overwrite").option("header", True).csv(path)


def percent_change(beta: Column, baseline: Column) -> Column:
    return F.try_divide(beta, baseline) * 100


def percent_change_voxel(effect: Column, baseline: Column) -> Column:
    """Relative to the size of the baseline, 0 where that is 0."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise((effect - baseline) / (F.abs(baseline) + 1e-6) * 100)
