"""Tests over subjects: t, Welch, effect sizes, correlations, regressions, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.aggregates import corr
from trialweave.functions.tails import t_p_two_sided, t_p_upper, z_from_p
from trialweave.operators.ordered import running


def _n(cond: Column | None, x: str) -> Column:
    return F.count(F.when(cond, F.col(x)) if cond is not None else F.col(x)).cast("double")


def _pair(group: str, a: str, b: str, x: str) -> tuple[Column, ...]:
    ca, cb = F.col(group) == a, F.col(group) == b
    pick = lambda c: F.when(c, F.col(x))
    return _n(ca, x), _n(cb, x), F.avg(pick(ca)), F.avg(pick(cb)), F.var_samp(pick(ca)), F.var_samp(pick(cb))


def one_sample_t(df: DataFrame, keys: list[str], x: str, min_n: int = 2) -> DataFrame:
    """mean, t against 0, degrees of freedom and two-sided p."""
    t = F.try_divide(F.avg(x), F.try_divide(F.stddev_samp(x), F.sqrt(_n(None, x))))
    return with_p(df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.count(x) >= min_n, t).alias("t"), (F.count(x) - 1).alias("df")))


def two_sample_t(df: DataFrame, keys: list[str], group: str, a: str, b: str, x: str) -> DataFrame:
    """Student's t with pooled variance, its two-sided p, and Cohen's d over the pooled deviation."""
    na, nb, ma, mb, va, vb = _pair(group, a, b, x)
    pooled = F.try_divide((na - 1) * va + (nb - 1) * vb, na + nb - 2)
    ok = (na >= 2) & (nb >= 2)
    t = F.try_divide(ma - mb, F.sqrt(pooled * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb))))
    return with_p(df.groupBy(*keys).agg((ma - mb).alias("difference"), F.when(ok, t).alias("t"), F.when(ok, F.try_divide(ma - mb, F.sqrt(pooled))).alias("cohen_d"), (na + nb - 2).alias("df")))


def welch_t(df: DataFrame, keys: list[str], group: str, a: str, b: str, x: str) -> DataFrame:
    """Welch's t, its degrees of freedom and two-sided p, and d over the root of the mean variance."""
    na, nb, ma, mb, va, vb = _pair(group, a, b, x)
    sa, sb = F.try_divide(va, na), F.try_divide(vb, nb)
    free = F.try_divide((sa + sb) * (sa + sb), F.try_divide(sa * sa, na - 1) + F.try_divide(sb * sb, nb - 1))
    return with_p(df.groupBy(*keys).agg((ma - mb).alias("difference"), F.try_divide(ma - mb, F.sqrt(sa + sb)).alias("t"), free.alias("df"), F.try_divide(ma - mb, F.sqrt((va + vb) / 2)).alias("cohen_d")))


def ks(df: DataFrame, keys: list[str], group: str, a: str, b: str, x: str) -> DataFrame:
    """Largest distance of two groups' distribution functions within keys, and its two-sided p by Kolmogorov's limit."""
    steps = df.groupBy(*keys, x).agg(F.count(F.when(F.col(group) == a, 1)).alias("_a"), F.count(F.when(F.col(group) == b, 1)).alias("_b"))
    share = lambda c: F.try_divide(F.col(f"{c}_upto").cast("double"), F.col(f"{c}_all").cast("double"))
    d = running(steps, keys, x, ["_a", "_b"]).groupBy(*keys).agg(F.max(F.abs(share("_a") - share("_b"))).alias("ks"), F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    scaled = F.col("ks") * F.sqrt(F.try_divide(F.col("n_a").cast("double") * F.col("n_b"), (F.col("n_a") + F.col("n_b")).cast("double")))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l")))
    total = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    p = F.when(F.col("_l") < 0.2, F.lit(1.0)).when(F.col("_l").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return d.withColumn("_l", scaled).withColumn("p", p).drop("_l")


def with_p(df: DataFrame, t: str = "t", free: str | Column = "df", tail: str = "two", name: str = "p") -> DataFrame:
    """p of a t with its degrees of freedom, two-sided or (``greater``) of the upper tail."""
    free = F.col(free) if isinstance(free, str) else free
    return df.withColumn(name, (t_p_two_sided if tail == "two" else t_p_upper)(F.col(t), free.cast("double")))


def correlations(df: DataFrame, keys: list[str], metrics: list[str], index: str, min_n: int = 6) -> DataFrame:
    """Pearson r of each metric with an index, its t and two-sided p; NULL under ``min_n`` complete rows."""
    long = df.select(*keys, index, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(*keys, index, "_m.metric", "_m.value")
    full = long.where(F.col("value").isNotNull() & F.col(index).isNotNull())
    r = corr("value", index)
    out = full.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= min_n, r).alias("r"))
    return with_p(out.withColumn("t", _t_of_r("r")), free=F.col("n") - 2)


def _t_of_r(r: str) -> Column:
    return F.col(r) * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col(r) * F.col(r)))


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, covariate: str) -> DataFrame:
    """Correlation of what a covariate leaves of x and y; its p takes the residuals as data, with n - 2 degrees of freedom."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(covariate).isNotNull())
    t = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), corr(x, y).alias("_xy"), corr(x, covariate).alias("_xz"), corr(y, covariate).alias("_yz"))
    part = F.try_divide(F.col("_xy") - F.col("_xz") * F.col("_yz"), F.sqrt((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz"))))
    out = t.select(*keys, "n", F.col("_xy").alias("r"), F.when(F.col("n") > 3, part).otherwise(F.col("_xy")).alias("partial_r"))
    return with_p(out.withColumn("t", _t_of_r("partial_r")), free=F.col("n") - 2)


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, t of the slope with its two-sided p, and r squared."""
    t = df.groupBy(*keys).agg(F.regr_count(y, x).cast("double").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"))
    rest = F.col("_yy") - F.col("slope") * F.col("_xy")
    error = F.sqrt(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("_xx")))
    return with_p(t.select(*keys, "n", "slope", "intercept", F.try_divide("slope", error).alias("t"), F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx") * F.col("_yy")).alias("r2")), free=F.col("n") - 2)


def interaction(df: DataFrame, keys: list[str], first: str, a: tuple[str, str], second: str, b: tuple[str, str], y: str) -> DataFrame:
    """Least squares with two two-level factors: the interaction, from cell means, its t and two-sided p. Also stands for a mixed model with one row a subject."""
    cell = lambda i, j: F.when((F.col(first) == a[i]) & (F.col(second) == b[j]), F.col(y))
    cells = [(i, j) for i in (0, 1) for j in (0, 1)]
    n = [F.count(cell(*c)).cast("double") for c in cells]
    m = [F.avg(cell(*c)) for c in cells]
    inner = sum((F.var_pop(cell(*c)) * F.count(cell(*c)) for c in cells[1:]), F.var_pop(cell(0, 0)) * n[0])
    total = n[0] + n[1] + n[2] + n[3]
    effect = m[3] - m[2] - m[1] + m[0]
    wide = sum((F.try_divide(F.lit(1.0), x) for x in n[1:]), F.try_divide(F.lit(1.0), n[0]))
    ok = (total >= 8) & (F.least(*n) >= 1)
    return with_p(df.groupBy(*keys).agg(total.alias("n"), F.when(ok, effect).alias("interaction"), F.when(ok, F.try_divide(effect, F.sqrt(F.try_divide(inner, total - 4) * wide))).alias("t")), free=F.col("n") - 4)


def contrast_battery(df: DataFrame, keys: list[str], group: str, groups: tuple[str, str], drug: str, drugs: tuple[str, str], x: str, least: int = 2) -> DataFrame:
    """The effects of a two-by-two study for each key, as rows: within a cell, between groups, between drugs, interaction.

    An effect with a cell of fewer than ``least`` values is left out.
    """
    cell = lambda g, d: F.when((F.col(group) == g) & (F.col(drug) == d), F.col(x))
    cells = [(g, d) for g in groups for d in drugs]
    stats = df.groupBy(*keys).agg(*[F.avg(cell(*c)).alias(f"m{k}") for k, c in enumerate(cells)], *[F.count(cell(*c)).alias(f"n{k}") for k, c in enumerate(cells)])
    (g1, g2), (d1, d2) = groups, drugs
    effects = [(f"{g1}_{d1}>0", "m0", [0]), (f"{g2}_{d1}>0", "m2", [2]), (f"{g1}>{g2}|{d1}", "m0 - m2", [0, 2]), (f"{d2}>{d1}|{g1}", "m1 - m0", [1, 0]), (f"{d2}>{d1}|{g2}", "m3 - m2", [3, 2]), ("interaction", "(m1 - m3) - (m0 - m2)", [0, 1, 2, 3])]
    rows = [F.struct(F.lit(n).alias("contrast"), F.when(F.least(*[F.col(f"n{k}") for k in used], F.lit(10**9)) >= least, F.expr(e)).alias("effect")) for n, e, used in effects]
    return stats.select(*keys, F.inline(F.array(*rows))).where("effect is not null")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def signed_z(effect: Column, p: Column) -> Column:
    """z of a two-sided p with the sign of the effect."""
    return F.signum(effect) * z_from_p(p)
