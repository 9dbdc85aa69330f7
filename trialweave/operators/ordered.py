"""Columns that follow from the order of trials, false discovery rates, z-scores, centring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.operators.lineage import cut


def counter(df: DataFrame, keys: list[str], order: list[str], name: str = "trial_no") -> DataFrame:
    """Running number from 1 within keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def early_late(df: DataFrame, keys: list[str], order: list[str], first: int = 4, last: int = 4, name: str = "stage") -> DataFrame:
    """Early for the first trials, Late for the last; where both hold, Late. NULL between."""
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn(name, F.when(down <= last, "Late").when(up <= first, "Early"))


def halves(df: DataFrame, keys: list[str], order: list[str], name: str = "half") -> DataFrame:
    """H1 for the first floor(n / 2) trials within keys, H2 for the rest."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.when(F.row_number().over(w.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(w) / 2), "H1").otherwise("H2"))


def slices(df: DataFrame, keys: list[str], order: list[str], early: int = 4, late: int = 4, name: str = "stage") -> DataFrame:
    """Early and Late as :func:`early_late`, NULL throughout where there are fewer than early + late trials."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return early_late(df, keys, order, early, late, name).withColumn(name, F.when(n >= early + late, F.col(name)))


def block(trial_no: Column, size: int) -> Column:
    """Block number of a trial, both from 1."""
    return F.floor((trial_no - 1) / size) + 1


def slopes(df: DataFrame, keys: list[str], x: str, y: str, min_points: int = 2, name: str = "slope") -> DataFrame:
    """Least-squares slope of y on x within keys; NULL under ``min_points`` finite points or with one distinct x."""
    ok = df.where(V.is_finite(F.col(y).cast("double")))
    slope = F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.when((F.count(F.lit(1)) >= min_points) & (F.min(x) < F.max(x)), slope).alias(name))


def bh_within(df: DataFrame, keys: list[str], p: str, tie: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q within keys, NULL for a NULL p. Each group is one window: for bounded groups."""
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(*keys, valid)
    rank = F.row_number().over(w.orderBy(p, tie))
    m = F.count(F.lit(1)).over(w)
    raw = df.withColumn("_raw", F.col(p) * m / rank)
    least = F.min("_raw").over(w.orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(name, F.when(valid, F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)))).drop("_raw")


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name in which NULL equals NULL; the right ones go."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(named[f"_r_{c}"])
    return left.join(named, match, how).drop(*[f"_r_{c}" for c in on])


def bucketed(df: DataFrame, x: str, parts: int = 32) -> DataFrame:
    """Adds _bucket, which never falls as x grows: ``parts`` ** 2 ranges between approximate quantiles, so no range holds much more than its share of the rows."""
    n = parts * parts
    cuts = df.agg(F.percentile_approx(x, [k / n for k in range(1, n)], 4 * n).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _c, i: (i + 1) % parts == 0))
    b = df.crossJoin(F.broadcast(cuts))  # one row of n numbers
    b = b.withColumn("_at", F.size(F.filter("_coarse", lambda c: c < F.col(x))))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_at") * parts + 1, F.lit(parts - 1)), lambda c: c < F.col(x)))
    return b.withColumn("_bucket", F.col("_at") * parts + fine).drop("_cuts", "_coarse", "_at")


def running(values: DataFrame, keys: list[str], x: str, counts: list[str]) -> DataFrame:
    """For one row of each keys and x: {count}_upto, the sum of counts up to x, {count}_all, that of all x, and _bucket.

    Only sums of buckets are ordered as a whole, so no task holds a group. The rows are written
    once, as cuts, sums and places each read them.
    """
    b = bucketed(cut(values), x)
    per = b.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_in{k}") for k, c in enumerate(counts)])
    whole, own = Window.partitionBy(*keys), Window.partitionBy(*keys, "_bucket").orderBy(x)
    before = [(F.sum(f"_in{k}").over(whole.orderBy("_bucket")) - F.col(f"_in{k}")).alias(f"_before{k}") for k in range(len(counts))]
    total = [F.sum(f"_in{k}").over(whole).alias(f"{c}_all") for k, c in enumerate(counts)]
    j = same(b, per.select(*keys, "_bucket", *before, *total), [*keys, "_bucket"])
    for k, c in enumerate(counts):
        j = j.withColumn(f"{c}_upto", F.col(f"_before{k}") + F.sum(c).over(own)).drop(f"_before{k}")
    return j


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by linear interpolation within keys, a column for each name; NULL and NaN are left out."""
    values = df.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    r = running(values, keys, "_x", ["_n"])

    def at(share: float) -> Column:
        place = (F.col("_n_all") - 1) * F.lit(share)
        low = F.min(F.when(F.col("_n_upto") > F.floor(place), F.col("_x")))
        high = F.min(F.when(F.col("_n_upto") > F.ceil(place), F.col("_x")))
        return low + (high - low) * F.max(place - F.floor(place))

    return r.groupBy(*keys).agg(*[at(share).alias(name) for name, share in shares.items()])


def digest_rank(df: DataFrame, keys: list[str], digest: str, tie: str, name: str, digits: int = 2) -> DataFrame:
    """Row number within keys in the order of a column of hex digests; windows hold the rows of one prefix of the digest."""
    b = df.withColumn("_bucket", F.substring(digest, 1, digits))
    per = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = per.select(*keys, "_bucket", (F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_in")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(digest, tie))
    return same(b.withColumn(name, own), before, [*keys, "_bucket"]).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def bh(df: DataFrame, p: str, name: str = "q", keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q within keys (over all rows without any), without one window over a group.

    q of a value is the least p * m / (number of values up to p) from there on. Equal p
    are one row first; counts and minima of ranges of p are carried over, so only these
    are ordered as a whole. NULL and NaN have no q.
    """
    keys = keys or []
    values = df.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(values, keys, "_p", ["_n"]).withColumn("_raw", F.col("_p") * F.col("_n_all") / F.col("_n_upto"))
    low = ranked.groupBy(*keys, "_bucket").agg(F.min("_raw").alias("_low"))
    after = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = low.select(*keys, "_bucket", F.min("_low").over(after).alias("_later"))
    within = F.min("_raw").over(Window.partitionBy(*keys, "_bucket").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0))
    q = same(ranked.withColumn("_own", within), later, [*keys, "_bucket"]).select(*keys, "_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_own", "_later")).alias(name))
    return same(df.withColumn("_p", F.col(p)), q, [*keys, "_p"], "left").drop("_p")


def bh_reject(df: DataFrame, p: str, alpha: float = 0.05, name: str = "rejected") -> DataFrame:
    """True for every p up to the largest p(k) with p(k) <= alpha * k / m; equals q <= alpha."""
    return bh(df, p, "_q").withColumn(name, F.coalesce(F.col("_q") <= alpha, F.lit(False))).drop("_q")


def z_without_outliers(df: DataFrame, value: str, limit: float = 3.0, name: str = "z") -> DataFrame:
    """Population z-score, with values beyond ``limit`` set to NULL, taken anew over the rest."""
    first = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    kept = df.crossJoin(F.broadcast(first)).withColumn("_v", F.when(F.abs(F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))) <= limit, F.col(value))).drop("_m", "_s")
    second = kept.agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    return kept.crossJoin(F.broadcast(second)).withColumn(name, F.try_divide(F.col("_v") - F.col("_m"), F.col("_s"))).drop("_v", "_m", "_s")


def center_within(df: DataFrame, keys: list[str], width: int, vector: str = "features") -> DataFrame:
    """Subtract the mean vector of all trials within keys. Filter conditions after, not before."""
    from trialweave.operators.centroids import mean_vectors

    means = mean_vectors(df, keys, width, vector, "_mean")
    return df.join(means, keys).withColumn(vector, V.subtract(vector, "_mean")).drop("_mean", "n_trials")


def standardize_within(df: DataFrame, keys: list[str], width: int, vector: str = "features") -> DataFrame:
    """Subtract the mean and divide by the population deviation of each feature within keys; a deviation of 0 counts as 1."""
    means = [F.avg(F.get(vector, F.lit(i))) for i in range(width)]
    spread = [F.stddev_pop(F.get(vector, F.lit(i))) for i in range(width)]
    stats = df.groupBy(*keys).agg(F.array(*means).alias("_mean"), F.array(*spread).alias("_sd"))
    safe = F.transform("_sd", lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))
    out = F.zip_with(V.subtract(vector, "_mean"), safe, lambda x, s: x / s)
    return df.join(stats, keys).withColumn(vector, out).drop("_mean", "_sd")


def offsets(df: DataFrame, order: str, count: str, name: str = "begins") -> DataFrame:
    """Sum of counts of the rows before: where each region's run of features begins. For a table of regions."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)))


def agrees_with_first(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value equals that of the first row, which is the reference."""
    first = df.agg(F.min_by(value, order).alias("_ref"))
    return df.crossJoin(F.broadcast(first)).where(F.col(value) == F.col("_ref")).drop("_ref")
