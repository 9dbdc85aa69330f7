"""Movement of patterns between conditions and over trials, and distances of condition means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.functions.aggregates import corr
from trialweave.operators.centroids import mean_vectors
from trialweave.operators.ordered import halves


def _of(means: DataFrame, keys: list[str], condition: str, value: str, name: str) -> DataFrame:
    return means.where(F.col(condition) == value).select(*keys, F.col("centroid").alias(name), F.col("n_trials").alias(f"n{name}"))


def plasticity(df: DataFrame, width: int, keys: list[str], learn: str, target: str, condition: str = "condition") -> DataFrame:
    """Projection, cosine and distance of one condition's centroid and another's, for each key."""
    m = mean_vectors(df, [*keys, condition], width)
    j = _of(m, keys, condition, learn, "_a").join(_of(m, keys, condition, target, "_b"), keys)
    return j.select(*keys, V.scalar_projection("_a", "_b").alias("projection"), V.cosine("_a", "_b").alias("cosine"), V.euclidean("_a", "_b").alias("distance"))


def trajectory(df: DataFrame, width: int, keys: list[str], learn: str, target: str, condition: str = "condition", trial: str = "trial_idx") -> DataFrame:
    """Each learning trial's place on the way from the mean of their first half (0) to the target centroid (1).

    Needs two learning trials and one target trial; none where start and target are one.
    """
    ordered = halves(df.where(F.col(condition) == learn), keys, [trial])
    start = mean_vectors(ordered.where("half = 'H1'"), keys, width, name="_start").drop("n_trials")
    goal = mean_vectors(df.where(F.col(condition) == target), keys, width, name="_goal").drop("n_trials")
    number = F.row_number().over(_window(keys, trial)).cast("bigint")
    j = ordered.withColumn("trial_no", number).join(start, keys).join(goal, keys)
    return j.select(*keys, "trial_no", V.trajectory("features", "_start", "_goal").alias("score")).where("score is not null")


def drift(df: DataFrame, width: int, keys: list[str], learn: str, target: str, condition: str = "condition", trial: str = "trial_idx") -> DataFrame:
    """Drift from first to second half of the learning trials, as cosine with and projection on the way to the target.

    Needs four learning and two target trials.
    """
    ordered = halves(df.where(F.col(condition) == learn), keys, [trial])
    part = mean_vectors(ordered, [*keys, "half"], width)
    first, second = _of(part, keys, "half", "H1", "_s"), _of(part, keys, "half", "H2", "_e")
    goal = mean_vectors(df.where(F.col(condition) == target), keys, width, name="_t").where("n_trials >= 2").drop("n_trials")
    j = first.join(second, keys).where("n_s + n_e >= 4").join(goal, keys)
    moved, axis = V.subtract("_e", "_s"), V.subtract("_t", "_s")
    return j.select(*keys, V.let(moved, lambda m: V.let(axis, lambda a: V.cosine(m, a))).alias("drift_cosine"), V.let(moved, lambda m: V.let(axis, lambda a: V.scalar_projection(m, a))).alias("drift_projection")).where("drift_cosine is not null")


def rdm(df: DataFrame, width: int, keys: list[str], condition: str = "condition", min_trials: int = 1) -> DataFrame:
    """Correlation distance of each pair of condition means (cond_a < cond_b)."""
    m = mean_vectors(df, [*keys, condition], width).where(F.col("n_trials") >= min_trials)
    a = m.select(*keys, F.col(condition).alias("cond_a"), F.col("centroid").alias("_a"))
    b = m.select(*keys, F.col(condition).alias("cond_b"), F.col("centroid").alias("_b"))
    return a.join(b, keys).where("cond_a < cond_b").select(*keys, "cond_a", "cond_b", V.correlation_distance("_a", "_b").alias("distance"))


def topology(table: DataFrame, keys: list[str], threat: str, safety: str, background: str) -> DataFrame:
    """Indices of a three-condition distance table: A threat to safety, B safety to background, A - B, and threat to background less B."""
    pick = lambda x, y: F.max(F.when((F.least("cond_a", "cond_b") == min(x, y)) & (F.greatest("cond_a", "cond_b") == max(x, y)), F.col("distance")))
    t = table.groupBy(*keys).agg(pick(threat, safety).alias("threat_safety"), pick(safety, background).alias("safety_background"), pick(threat, background).alias("_tb"))
    return t.select(*keys, "threat_safety", "safety_background", (F.col("threat_safety") - F.col("safety_background")).alias("inhibition_index"), (F.col("_tb") - F.col("safety_background")).alias("background_index"))


def dissimilarity(df: DataFrame, width: int, keys: list[str], condition: str = "condition") -> DataFrame:
    """Mean distance over the pairs of condition means; NULL unless all three are there."""
    t = rdm(df, width, keys, condition)
    return t.groupBy(*keys).agg(F.when(F.count("distance") == 3, F.avg("distance")).alias("dissimilarity"))


def coupling(left: DataFrame, right: DataFrame, keys: list[str], on: list[str], x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson r of two trial series within keys (and ``by``, columns of the left one), with at least three pairs and two distinct values on both sides."""
    j = left.join(right, [*keys, *on]).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ok = (F.count(F.lit(1)) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return j.groupBy(*keys, *(by or [])).agg(F.count(F.lit(1)).alias("n_pairs"), F.when(ok, corr(x, y)).alias("r"))


def _window(keys: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)
