"""Similarity of trials, conditions and phases: closed forms over sums where the reference value is a mean over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.functions.aggregates import corr
from trialweave.operators.centroids import mean_vectors
from trialweave.operators.ordered import slices


def unit(df: DataFrame, vector: str = "features", min_valid: float = V.MIN_VALID) -> DataFrame:
    """Trials with enough finite elements, centred and brought to norm 1 (constant ones to the zero vector)."""
    return df.where(V.finite_fraction(vector) >= min_valid).withColumn(vector, V.center_normalize(vector))


def _sums(units: DataFrame, keys: list[str], width: int, vector: str) -> DataFrame:
    sums = F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(width)])
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(V.dot(vector, vector)).alias("_own"), sums.alias("_sum"))


def within(units: DataFrame, keys: list[str], width: int, vector: str = "features") -> DataFrame:
    """Mean similarity of all pairs within keys; NULL under two trials."""
    s = _sums(units, keys, width, vector)
    n = F.col("n").cast("double")
    return s.select(*keys, "n", F.when(F.col("n") >= 2, (V.dot("_sum", "_sum") - F.col("_own")) / (n * (n - 1.0))).alias("within"))


def within_between(units: DataFrame, keys: list[str], width: int, condition: str = "condition", vector: str = "features") -> DataFrame:
    """For each condition within keys: mean similarity within it, to all other trials of the keys, and the difference."""
    s = _sums(units, [*keys, condition], width, vector)
    alls = s.groupBy(*keys).agg(F.sum("n").alias("_n_all"), F.array(*[F.sum(F.get("_sum", F.lit(i))) for i in range(width)]).alias("_all"))
    j = s.join(alls, keys)
    n, rest = F.col("n").cast("double"), (F.col("_n_all") - F.col("n")).cast("double")
    inner = F.when(F.col("n") >= 2, (V.dot("_sum", "_sum") - F.col("_own")) / (n * (n - 1.0)))
    outer = F.try_divide(V.dot("_sum", V.subtract("_all", "_sum")), n * rest)
    return j.select(*keys, condition, inner.alias("within"), outer.alias("between"), (inner - outer).alias("score"))


def neighbourhoods(df: DataFrame, near: DataFrame, vector: str = "features") -> DataFrame:
    """Each row once for every centre, with the elements of its vector that ``near`` (center, neighbor as place in the vector, rank) gives.

    ``near`` goes to every task as one row of lists: it has the parcels of an atlas, at most as many as a vector has elements.
    """
    lists = near.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))), lambda s: s["neighbor"]).alias("_near"))
    one = lists.agg(F.collect_list(F.struct("center", "_near")).alias("_all"))
    j = df.crossJoin(F.broadcast(one)).withColumn("_c", F.explode("_all"))
    return j.withColumn(vector, F.transform("_c._near", lambda i: F.get(F.col(vector), i.cast("int")))).withColumn("center", F.col("_c.center")).drop("_all", "_c")


def between_pairs(units: DataFrame, keys: list[str], width: int, condition: str = "condition", vector: str = "features") -> DataFrame:
    """Mean similarity of each pair of conditions (cond_a < cond_b) within keys."""
    means = _sums(units, [*keys, condition], width, vector).select(*keys, F.col(condition).alias("c"), V.scale("_sum", 1.0 / F.col("n")).alias("m"))
    a, b = means.select(*keys, F.col("c").alias("cond_a"), F.col("m").alias("_a")), means.select(*keys, F.col("c").alias("cond_b"), F.col("m").alias("_b"))
    return a.join(b, keys).where("cond_a < cond_b").select(*keys, "cond_a", "cond_b", V.dot("_a", "_b").alias("similarity"))


def trial_scores(units: DataFrame, keys: list[str], width: int, condition: str = "condition", trial: str = "trial_idx", vector: str = "features") -> DataFrame:
    """For each trial: mean similarity to the others of its condition less that to trials of other conditions."""
    s = _sums(units, [*keys, condition], width, vector).drop("_own")
    alls = s.groupBy(*keys).agg(F.sum("n").alias("_n_all"), F.array(*[F.sum(F.get("_sum", F.lit(i))) for i in range(width)]).alias("_all"))
    j = units.join(s, [*keys, condition]).join(alls, keys)
    n, rest = F.col("n").cast("double"), (F.col("_n_all") - F.col("n")).cast("double")
    inner = F.when(F.col("n") >= 2, V.dot(vector, V.subtract("_sum", vector)) / F.when(n > 1, n - 1.0))
    outer = F.try_divide(V.dot(vector, V.subtract("_all", "_sum")), rest)
    return j.select(*keys, condition, trial, (inner - outer).alias("score"))


def pairs(df: DataFrame, keys: list[str], condition: str = "condition", trial: str = "trial_idx", vector: str = "features") -> DataFrame:
    """Cosine and Pearson of every pair of trials within keys, which are as small as a subject's phase."""
    side = lambda s: df.select(*keys, F.col(trial).alias(f"trial_{s}"), F.col(condition).alias(f"cond_{s}"), F.col(vector).alias(f"_{s}"))
    j = side("a").join(side("b"), keys).where("trial_a < trial_b")
    return j.select(*keys, "trial_a", "trial_b", "cond_a", "cond_b", V.cosine("_a", "_b").alias("cosine"), V.pearson("_a", "_b").alias("pearson"))


def type_table(pairs_of: DataFrame, keys: list[str], value: str = "pearson") -> DataFrame:
    """Mean over pairs within and between types, unordered."""
    return pairs_of.groupBy(*keys, F.least("cond_a", "cond_b").alias("type_a"), F.greatest("cond_a", "cond_b").alias("type_b")).agg(F.avg(value).alias("mean"), F.count(value).alias("n_pairs"))


def matrix(pairs_of: DataFrame, keys: list[str], value: str = "pearson") -> DataFrame:
    """Both triangles of the trial by trial matrix, with a NULL diagonal."""
    upper = pairs_of.select(*keys, F.col("trial_a").alias("row"), F.col("trial_b").alias("col"), F.col(value).alias("value"))
    lower = upper.select(*keys, F.col("col").alias("row"), F.col("row").alias("col"), "value")
    ends = upper.select(*keys, "row").union(lower.select(*keys, "row")).distinct()
    return upper.unionByName(lower).unionByName(ends.select(*keys, "row", F.col("row").alias("col"), F.lit(None).cast("double").alias("value")))


def cross_phase(df: DataFrame, width: int, first: str, second: str, subject: str = "subject", condition: str = "condition") -> DataFrame:
    """Cosine of a condition's mean pattern in one phase with each condition's in another."""
    m = mean_vectors(df.where(V.finite_fraction("features") >= V.MIN_VALID), [subject, "phase", condition], width)
    a = m.where(F.col("phase") == first).select(subject, F.col(condition).alias("cond_first"), F.col("centroid").alias("_a"))
    b = m.where(F.col("phase") == second).select(subject, F.col(condition).alias("cond_second"), F.col("centroid").alias("_b"))
    return a.join(b, subject).select(subject, "cond_first", "cond_second", V.cosine_valid("_a", "_b").alias("similarity"))


def cross_phase_between(table: DataFrame, subject: str = "subject") -> DataFrame:
    """Mean over both directions of a pair of different conditions."""
    differ = table.where("cond_first <> cond_second")
    return differ.groupBy(subject, F.least("cond_first", "cond_second").alias("cond_a"), F.greatest("cond_first", "cond_second").alias("cond_b")).agg(F.avg("similarity").alias("similarity"))


def to_centroid(df: DataFrame, centroids: DataFrame, keys: list[str], name: str = "similarity") -> DataFrame:
    """Cosine of each trial with the centroid of its keys."""
    return df.join(centroids.select(*keys, "centroid"), keys).withColumn(name, V.cosine_valid("features", "centroid")).drop("centroid", "features")


def dynamic(df: DataFrame, width: int, keys: list[str], early: int = 4, late: int = 4, condition: str = "condition", trial: str = "trial_idx") -> DataFrame:
    """For each pair of conditions: cosine of the late patterns less that of the early ones, and the mean slope of each one's trials towards the other's centroid.

    Conditions with fewer than early + late trials give no row.
    """
    staged = slices(df, [*keys, condition], [trial], early, late)
    enough = staged.groupBy(*keys, condition).agg(F.max("stage").isNotNull().alias("_ok")).where("_ok").drop("_ok")
    staged = staged.join(enough, [*keys, condition])
    part = mean_vectors(staged.where("stage is not null"), [*keys, condition, "stage"], width)
    by_stage = part.groupBy(*keys, condition).agg(F.any_value(F.when(F.col("stage") == "Early", F.col("centroid")), True).alias("_early"), F.any_value(F.when(F.col("stage") == "Late", F.col("centroid")), True).alias("_late"))
    a = by_stage.select(*keys, F.col(condition).alias("cond_a"), F.col("_early").alias("_ea"), F.col("_late").alias("_la"))
    b = by_stage.select(*keys, F.col(condition).alias("cond_b"), F.col("_early").alias("_eb"), F.col("_late").alias("_lb"))
    delta = a.join(b, keys).where("cond_a < cond_b").select(*keys, "cond_a", "cond_b", (V.cosine_valid("_la", "_lb") - V.cosine_valid("_ea", "_eb")).alias("delta"))
    whole = mean_vectors(staged, [*keys, condition], width).select(*keys, F.col(condition).alias("_other"), "centroid")
    ordered = staged.withColumn("_no", F.row_number().over(_window([*keys, condition], trial)))
    series = ordered.join(whole, keys).where(F.col(condition) != F.col("_other")).withColumn("_s", V.cosine_valid("features", "centroid"))
    slope = series.groupBy(*keys, condition, "_other").agg(F.regr_slope("_s", F.col("_no").cast("double")).alias("_slope"))
    both = slope.groupBy(*keys, F.least(condition, "_other").alias("cond_a"), F.greatest(condition, "_other").alias("cond_b")).agg(F.avg("_slope").alias("slope"))
    return delta.join(both, [*keys, "cond_a", "cond_b"])


def _window(keys: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


def cube_pairs(df: DataFrame, pairs: DataFrame, near: DataFrame, keys: list[str], trial: str = "trial_idx", vector: str = "features") -> DataFrame:
    """pearson and cosine of two trials' elements around each centre: keys, trial_a, trial_b, center.

    ``pairs`` has keys, trial_a and trial_b; pairs with a trial that is not there give no rows. NULL
    where a neighbourhood has fewer than two elements or one that is missing. ``near`` is bounded
    by the length of the vector, as for :func:`neighbourhoods`.
    """
    of = lambda side: df.select(*keys, F.col(trial).alias(f"trial_{side}"), F.col(vector).alias(f"_{side}"))
    two = pairs.select(*keys, "trial_a", "trial_b").join(of("a"), [*keys, "trial_a"]).join(of("b"), [*keys, "trial_b"])
    zipped = two.select(*keys, "trial_a", "trial_b", F.zip_with("_a", "_b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("_v"))
    around = neighbourhoods(zipped, near.withColumn("rank", F.col("neighbor")), "_v")
    around = around.withColumn("_x", F.transform("_v", lambda s: s["x"])).withColumn("_y", F.transform("_v", lambda s: s["y"]))
    ok = (F.size("_v") >= 2) & F.forall("_v", lambda s: V.is_finite(s["x"]) & V.is_finite(s["y"]))
    return around.select(*keys, "trial_a", "trial_b", "center", F.when(ok, V.pearson("_x", "_y")).alias("pearson"), F.when(ok, V.cosine("_x", "_y")).alias("cosine"))


def region_matrix(df: DataFrame, keys: list[str], regions: dict[str, list[int]], vector: str = "features") -> DataFrame:
    """region_a, region_b, n_trials, r: correlation of two regions' means over the trials of keys, both ways round.

    All pairs of regions are columns of one aggregation, so trials are shuffled as sums only.
    Regions without spread or with missing values have no rows.
    """
    names = list(regions)
    means = df.select(*keys, *[V.mean(V.gather(vector, at)).alias(f"_{n}") for n, at in regions.items()])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = means.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), *[corr(f"_{a}", f"_{b}").alias(f"_r{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("region_a"), F.lit(y).alias("region_b"), F.col(f"_r{k}").alias("r")) for k, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    return wide.select(*keys, "n_trials", F.inline(F.array(*rows))).where(F.col("r").isNotNull() & ~F.isnan("r"))
