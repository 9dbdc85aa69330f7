"""Means over trials, regions, subjects and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import vectors as V

#: Wider vectors are averaged in long form.
PACKED_WIDTH = 512


def unpack(df: DataFrame, vector: str = "features") -> DataFrame:
    """One row for each element: pos (from 0), x."""
    return df.select(*[c for c in df.columns if c != vector], F.posexplode(vector).alias("pos", "x"))


def pack(df: DataFrame, keys: list[str], pos: str = "pos", value: str = "x", vector: str = "features") -> DataFrame:
    """Rows of elements back to one vector for each key, in order of pos."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias(vector))


def mean_vectors(df: DataFrame, keys: list[str], width: int, vector: str = "features", name: str = "centroid") -> DataFrame:
    """Mean of each element within keys, over finite values, and n_trials. All-missing elements are NULL.

    Up to ``PACKED_WIDTH`` elements the sums are columns of one aggregation, combined before the
    shuffle; wider vectors go through the long form.
    """
    if width <= PACKED_WIDTH:
        cells = [F.avg(F.when(V.is_finite(F.get(vector, F.lit(i))), F.get(vector, F.lit(i)))) for i in range(width)]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), F.array(*cells).alias(name))
    long = unpack(df.select(*keys, vector), vector)
    cells = long.groupBy(*keys, "pos").agg(F.avg(F.when(V.is_finite(F.col("x")), F.col("x"))).alias("x"))
    return pack(cells, keys, vector=name).join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials")), keys)


def valid_mean_vectors(df: DataFrame, keys: list[str], width: int, vector: str = "features", min_valid: float = V.MIN_VALID, name: str = "centroid") -> DataFrame:
    """As :func:`mean_vectors`, over trials with at least ``min_valid`` finite elements."""
    return mean_vectors(df.where(V.finite_fraction(vector) >= min_valid), keys, width, vector, name)


def region_means(df: DataFrame, regions: DataFrame, keys: list[str], feature: str = "feature_id", region: str = "roi", value: str = "value") -> DataFrame:
    """Mean of a long map over each region, and how many features it has there."""
    return df.join(regions.select(feature, region), feature).groupBy(*keys, region).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_features"))


def group_map(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over subjects of each feature."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_subjects"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, standard error and count."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value).cast("double"))).alias("sem"), F.count(value).alias("n"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Sum of weight * value over the sum of weights, as chunks are merged; NULL keys are a group."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("merged"), F.sum(weight).alias("weight"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population variance, deviation and excess kurtosis; quartiles with linear interpolation."""
    from trialweave.operators.ordered import quantiles, same

    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("deviation"), F.kurtosis(value).alias("kurtosis"))
    return same(m, quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys, "left")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts and density of each filled bin; the last bin is closed."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    binned = inside.withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(totals, keys).select(*keys, "bin", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def histogram_entropy(counts: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Entropy in nats of a histogram's densities; 1e-9 is added to every bin, also the empty ones."""
    eps = 1e-9
    total = F.sum("density") + bins * eps
    filled = F.sum((F.col("density") + eps) * F.ln(F.col("density") + eps))
    empty = (bins - F.count(F.lit(1))) * eps * F.ln(F.lit(eps))
    return counts.groupBy(*keys).agg((F.ln(total) - (filled + empty) / total).alias("entropy"))
