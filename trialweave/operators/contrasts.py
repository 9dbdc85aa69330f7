"""Batteries of contrasts: a table of weights joined with the moments of cells.

A cell is a combination of factor levels (group and drug, say). Its count, mean and sum of
squares about the mean come from one aggregation; a contrast is a weight for each of some
cells. Contrasts of any number of factors are products of one small table a factor: the
levels themselves (each at its own), an average over them, or differences of two levels.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators.inference import signed_z, with_p
from trialweave.operators.ordered import bh


def moments(df: DataFrame, keys: list[str], factors: list[str], x: str) -> DataFrame:
    """keys, factors, n, mean, m2 (sum of squares about the mean) of the values that are not null. Cells add up by :func:`merged`."""
    value = F.col(x).cast("double")
    return df.where(value.isNotNull()).groupBy(*keys, *factors).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union of cells: means by counts, squares with those between the means."""
    s = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum(F.col("m2")).alias("_m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    mean = F.try_divide(F.col("_s"), F.col("n"))
    return s.select(*keys, "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("_m2") + F.col("_q") - F.col("n") * mean * mean).alias("m2"))


def factor_terms(name: str, levels: list[str], kinds: tuple[str, ...] = ("each", "difference")) -> list[tuple[str, dict[str, float]]]:
    """Named weights over the levels of one factor: ``each`` level, all ``difference`` pairs (the first less the second), the ``average``, and ``rest`` (a level less the mean of the others)."""
    terms: list[tuple[str, dict[str, float]]] = []
    if "average" in kinds:
        terms.append((f"{name}:all", {v: 1 / len(levels) for v in levels}))
    if "each" in kinds:
        terms += [(v, {v: 1.0}) for v in levels]
    if "difference" in kinds:
        terms += [(f"{a}>{b}", {a: 1.0, b: -1.0}) for a, b in combinations(levels, 2)]
    if "rest" in kinds and len(levels) > 2:
        terms += [(f"{v}>rest", {w: 1.0 if w == v else -1 / (len(levels) - 1) for w in levels}) for v in levels]
    return terms


def products(spark: SparkSession, terms: dict[str, list[tuple[str, dict[str, float]]]]) -> DataFrame:
    """contrast, one column a factor, weight, n_cells: the Kronecker product of the factors' terms. The name joins those of the terms with ``|``."""
    factors, rows = list(terms), []
    for chosen in product(*terms.values()):
        name = "|".join(n for n, _ in chosen)
        cells = list(product(*[w.items() for _, w in chosen]))
        for cell in cells:
            weight = 1.0
            for _, w in cell:
                weight *= w
            rows.append((name, *[v for v, _ in cell], weight, len(cells)))
    return spark.createDataFrame(rows, f"contrast string, {', '.join(f'`{f}` string' for f in factors)}, weight double, n_cells bigint")  # a row a contrast and cell


def main_effects_and_interactions(spark: SparkSession, levels: dict[str, list[str]]) -> DataFrame:
    """As :func:`products`: for every choice of factors, differences of each level from the first, averaged over the levels of the other factors."""
    out = None
    for size in range(1, len(levels) + 1):
        for chosen in combinations(levels, size):
            terms = {f: [(f"{f}:{v}-{names[0]}", {v: 1.0, names[0]: -1.0}) for v in names[1:]] if f in chosen else [("", {v: 1 / len(names) for v in names})] for f, names in levels.items()}
            one = products(spark, terms).withColumn("contrast", F.array_join(F.filter(F.split("contrast", r"\|"), lambda n: n != ""), " x "))
            out = one if out is None else out.unionByName(one)
    return out


def tested(cells: DataFrame, contrasts: DataFrame, keys: list[str], factors: list[str], least: int = 2) -> DataFrame:
    """keys, contrast, n, effect, t, df, p: every contrast whose cells all have ``least`` values.

    Errors are those of each cell (Welch), with Satterthwaite's degrees of freedom; of one cell it is
    the one-sample t. t and p are NULL where nothing varies.
    """
    j = cells.join(F.broadcast(contrasts), factors)  # a row a contrast and cell
    share = F.try_divide(F.col("weight") * F.col("weight") * F.col("m2"), (F.col("n") - 1) * F.col("n"))
    j = j.where(F.col("n") >= least).withColumn("_e", share)
    s = j.groupBy(*keys, "contrast").agg(F.count(F.lit(1)).alias("_cells"), F.max("n_cells").alias("_all"), F.sum("n").alias("n"), F.sum(F.col("weight") * F.col("mean")).alias("effect"), F.sum("_e").alias("_v"), F.sum(F.try_divide(F.col("_e") * F.col("_e"), F.col("n") - 1)).alias("_w"))
    s = s.where("_cells = _all").withColumn("t", F.when(F.col("_v") > 1e-18, F.col("effect") / F.sqrt("_v"))).withColumn("df", F.try_divide(F.col("_v") * F.col("_v"), F.col("_w")))
    return with_p(s.select(*keys, "contrast", F.col("n").cast("bigint").alias("n"), "effect", "t", "df"))


def battery(df: DataFrame, keys: list[str], over: list[str], contrasts: DataFrame, factors: list[str], x: str, least: int = 2) -> DataFrame:
    """Contrasts of a map for each of ``keys`` (a voxel's included), with q over the rows that share contrast and ``over`` (the map), and the signed z."""
    t = tested(moments(df, keys, factors, x), contrasts, keys, factors, least)
    q = bh(t.withColumn("p", F.round("p", 9)), "p", "q", [*over, "contrast"])
    return q.withColumn("z", signed_z(F.col("effect"), F.col("p")))

