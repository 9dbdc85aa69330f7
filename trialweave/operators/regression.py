"""Least squares with several covariates and mixed models with a random intercept, from sums: no task or driver holds rows.

Covariances of all columns are one aggregation. Covariates are taken out one after the other
by sweeping the matrix, whose entries are columns of one row a group. A mixed model needs
sums a subject, and of these only sums over all subjects with equally many rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.tails import z_p_two_sided
from trialweave.operators.inference import with_p


def _entry(i: int, j: int) -> str:
    return f"_c{min(i, j)}_{max(i, j)}"


def covariances(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, covariances (over n) of all pairs of columns and variances, over rows in which none is null or NaN."""
    full, values = F.lit(True), [F.col(c).cast("double") for c in columns]
    for v in values:
        full = full & v.isNotNull() & ~F.isnan(v)
    kept = df.where(full).select(*keys, *[v.alias(f"_v{k}") for k, v in enumerate(values)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"_v{i}", f"_v{j}").alias(_entry(i, j)) for i, j in pairs], *[F.var_pop(f"_v{i}").alias(f"_w{i}") for i in range(len(columns))])


def swept(c: DataFrame, size: int, k: int) -> DataFrame:
    """The matrix after column k has been taken out of all others: entries beside k become slopes on it, its own the inverse. NULL where nothing of it is left."""
    own = F.when(F.col(_entry(k, k)) > 1e-12 * F.col(f"_w{k}"), F.col(_entry(k, k)))
    new: dict[str, Column] = {}
    for i in range(size):
        for j in range(i, size):
            name = _entry(i, j)
            if i == k and j == k:
                new[name] = -1.0 / own
            elif k in (i, j):
                new[name] = F.col(name) / own
            else:
                new[name] = F.col(name) - F.col(_entry(i, k)) * F.col(_entry(k, j)) / own
    return c.select(*[new.get(x, F.col(x)).alias(x) for x in c.columns])


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, covariates: list[str], residuals_as_data: bool = True) -> DataFrame:
    """keys, n, r, partial_r, t, p: correlation of what the covariates leave of x and y.

    With ``residuals_as_data`` its p has n - 2 degrees of freedom, as a correlation of the residuals has; else one less for each covariate.
    """
    size = len(covariates) + 2
    c = covariances(df, keys, [*covariates, x, y])
    a, b = size - 2, size - 1
    r = lambda: F.try_divide(F.col(_entry(a, b)), F.sqrt(F.greatest(F.lit(0.0), F.col(_entry(a, a)) * F.col(_entry(b, b)))))
    c = c.withColumn("r", r())
    for k in range(len(covariates)):
        c = swept(c, size, k)
    free = F.col("n") - 2 - (0 if residuals_as_data else len(covariates))
    out = c.select(*keys, "n", "r", r().alias("partial_r"))
    return with_p(out.withColumn("t", F.col("partial_r") * F.sqrt(F.try_divide(free.cast("double"), 1 - F.col("partial_r") * F.col("partial_r")))), free=free)


def ols(df: DataFrame, keys: list[str], predictors: list[str], y: str) -> DataFrame:
    """A row a predictor: keys, term, n, slope, beta (of z-scores), se, t, p, and r2 of the whole fit. NULL where predictors depend on one another."""
    size = len(predictors) + 1
    last = size - 1
    c = covariances(df, keys, [*predictors, y])
    for k in range(len(predictors)):
        c = swept(c, size, k)
    free = F.col("n") - size
    # after the sweeps: slopes in the last column, minus the inverse in the others, the rest in the corner
    rest = F.col(_entry(last, last)) * F.col("n") / free
    terms = [F.struct(F.lit(name).alias("term"), F.col(_entry(k, last)).alias("slope"), (F.col(_entry(k, last)) * F.sqrt(F.try_divide(F.col(f"_w{k}"), F.col(f"_w{last}")))).alias("beta"), F.sqrt(rest * -F.col(_entry(k, k)) / F.col("n")).alias("se")) for k, name in enumerate(predictors)]
    out = c.select(*keys, "n", free.alias("_free"), (1 - F.try_divide(F.col(_entry(last, last)), F.col(f"_w{last}"))).alias("r2"), F.inline(F.array(*terms)))
    out = with_p(out.withColumn("t", F.try_divide("slope", "se")), free="_free")
    return out.select(*keys, "term", "n", "slope", "beta", "se", "t", "p", "r2")


def restricted_fit(sizes: np.ndarray, subjects: np.ndarray, outer: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Slopes, their errors, variance between subjects and within, and the restricted log-likelihood.

    ``outer[k]`` is the sum, over the ``subjects[k]`` subjects with ``sizes[k]`` rows, of the product of
    their sums of (x, y); ``xx`` the products of all rows. The ratio of variances is found by a grid and golden section.
    """
    n, p = float((sizes * subjects).sum()), len(xx) - 1

    def at(ratio: float):
        m = xx - np.tensordot(ratio / (1 + sizes * ratio), outer, 1)
        inverse = np.linalg.pinv(m[:p, :p], hermitian=True)
        slopes = inverse @ m[:p, p]
        left = max(m[p, p] - m[:p, p] @ slopes, 1e-300)
        sign, size = np.linalg.slogdet(m[:p, :p])
        value = -0.5 * ((n - p) * (np.log(2 * np.pi * left / (n - p)) + 1) + (subjects * np.log1p(sizes * ratio)).sum() + size)
        return value, slopes, inverse, left / (n - p)

    grid = np.concatenate([[-np.inf], np.linspace(-14, 10, 97)])
    best = int(np.argmax([at(np.exp(g))[0] for g in grid]))
    low, high = grid[max(best - 1, 1)], grid[min(best + 1, len(grid) - 1)]
    if best == 0:
        ratio = 0.0
    else:
        golden = (np.sqrt(5) - 1) / 2
        for _ in range(80):
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if at(np.exp(a))[0] > at(np.exp(b))[0] else (a, high)
        ratio = float(np.exp((low + high) / 2))
        ratio = ratio if at(ratio)[0] >= at(0.0)[0] else 0.0
    value, slopes, inverse, within = at(ratio)
    return slopes, np.sqrt(within * np.diag(inverse)), ratio * within, within, value


def random_intercept(df: DataFrame, keys: list[str], predictors: list[str], y: str, subject: str) -> DataFrame:
    """y on an intercept, predictors and a random intercept a subject, by restricted likelihood.

    A row a term: keys, term, n, n_subjects, slope, se, z, p (normal, two-sided), var_subject,
    var_residual, log_likelihood. Rows with a null or NaN are left out; groups with no more rows than terms give none.
    """
    names = ["intercept", *predictors]
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in [*predictors, y]]]
    full = F.col(subject).isNotNull()
    for v in columns[1:]:
        full = full & v.isNotNull() & ~F.isnan(v)
    size = len(columns)
    rows = df.where(full).select(*keys, F.col(subject).alias("_s"), *[v.alias(f"_v{k}") for k, v in enumerate(columns)])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    products = [F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_p{k}") for k, (i, j) in enumerate(pairs)]
    own = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(size)], *products)
    outer = [F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"_o{k}") for k, (i, j) in enumerate(pairs)]
    alike = own.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_subjects"), *outer, *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(len(pairs))])
    total = F.sum(F.col("_n") * F.col("_subjects")).over(Window.partitionBy(*(keys or [F.lit(0)])))
    alike = alike.withColumn("_rows", total).where(F.col("_rows") > len(names))
    kinds = dict(df.dtypes)

    def square(values: np.ndarray) -> np.ndarray:
        out = np.zeros((*values.shape[:-1], size, size))
        for k, (i, j) in enumerate(pairs):
            out[..., i, j] = out[..., j, i] = values[..., k]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        sizes, subjects = pdf["_n"].to_numpy(float), pdf["_subjects"].to_numpy(float)
        slopes, errors, between, within, value = restricted_fit(sizes, subjects, square(pdf[[f"_o{k}" for k in range(len(pairs))]].to_numpy()), square(pdf[[f"_p{k}" for k in range(len(pairs))]].to_numpy().sum(0)))
        made = {k: pdf[k].iloc[0] for k in keys} | {"term": names, "n": int((sizes * subjects).sum()), "n_subjects": int(subjects.sum()), "slope": slopes, "se": errors}
        return pd.DataFrame(made | {"var_subject": between, "var_residual": within, "log_likelihood": value})

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["term string, n bigint, n_subjects bigint, slope double, se double, var_subject double, var_residual double, log_likelihood double"])
    fitted = alike.groupBy(*keys).applyInPandas(run, schema) if keys else alike.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)  # a row a number of rows
    z = F.try_divide("slope", "se")
    return fitted.withColumn("z", z).withColumn("p", z_p_two_sided(z))
