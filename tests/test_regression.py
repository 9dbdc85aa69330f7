"""Partial correlations, least squares and mixed models against NumPy on whole matrices."""

import math

import numpy as np
import pytest

from trialweave.operators import regression as R

NAMES = ["x", "y", "u", "v", "w"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    z = r.normal(size=(200, 5)) @ r.normal(size=(5, 5)) + [0, 5, 1e4, -3, 2]
    rows = [(("a", "b")[k % 2], *map(float, q)) for k, q in enumerate(z)]
    odd = [("a", 1.0, 1.0, None, 1.0, 1.0), ("b", 1.0, float("nan"), 1.0, 1.0, 1.0)] + [("c", 1.0, 2.0, 3.0, 4.0, 5.0)] * 6
    return spark.createDataFrame(rows + odd, "g string, x double, y double, u double, v double, w double").repartition(3), z


def rest(a, by):
    by = np.column_stack([np.ones(len(a)), by])
    return a - by @ np.linalg.lstsq(by, a, rcond=None)[0]


@pytest.mark.parametrize("covariates", [["u"], ["u", "v"], ["w", "v", "u"]])
def test_partial_correlation(spark, data, covariates):
    df, z = data
    for own in (True, False):
        got = {r.g: r for r in R.partial_correlation(df, ["g"], "x", "y", covariates, own).collect()}
        for k, g in enumerate("ab"):
            q = z[k::2]
            c = q[:, [NAMES.index(n) for n in covariates]]
            want = np.corrcoef(rest(q[:, 0], c), rest(q[:, 1], c))[0, 1]
            free = len(q) - 2 - (0 if own else len(covariates))
            assert math.isclose(got[g].partial_r, want, abs_tol=1e-9) and math.isclose(got[g].r, np.corrcoef(q[:, 0], q[:, 1])[0, 1], abs_tol=1e-9)
            assert math.isclose(got[g].t, want * math.sqrt(free / (1 - want**2)), abs_tol=1e-7) and got[g].n == 100
        assert got["c"].partial_r is None


def test_least_squares(spark, data):
    df, z = data
    got = {(r.g, r.term): r for r in R.ols(df, ["g"], ["u", "v", "w"], "y").collect()}
    for k, g in enumerate("ab"):
        q = z[k::2]
        x, y = np.column_stack([np.ones(100), q[:, 2:]]), q[:, 1]
        slopes = np.linalg.lstsq(x, y, rcond=None)[0]
        left = y - x @ slopes
        errors = np.sqrt(left @ left / 96 * np.diag(np.linalg.inv(x.T @ x)))
        for j, name in enumerate("uvw", 1):
            r = got[g, name]
            assert np.allclose([r.slope, r.se, r.t, r.beta, r.r2], [slopes[j], errors[j], slopes[j] / errors[j], slopes[j] * q[:, j + 1].std() / y.std(), 1 - left.var() / y.var()], rtol=1e-6)
    assert got["c", "u"].slope is None


@pytest.mark.parametrize("between", [0.0, 1.5])
def test_random_intercept(spark, between):
    """Against the restricted likelihood of whole matrices, best on a fine grid; subjects with unequal numbers of rows."""
    r = np.random.default_rng(5)
    subject = np.repeat(np.arange(24), r.integers(1, 9, 24))
    group = (subject % 2).astype(float)
    x = r.normal(size=len(subject))
    y = 2 + group - 0.5 * x + r.normal(0, between, 24)[subject] + r.normal(size=len(subject))
    rows = [("k", int(s), float(g), float(a), float(b)) for s, g, a, b in zip(subject, group, x, y, strict=True)]
    df = spark.createDataFrame(rows + [("k", None, 1.0, 1.0, 1.0), ("k", 1, None, 1.0, 1.0), ("few", 1, 1.0, 1.0, 1.0)], "key string, subject long, grp double, x double, y double").repartition(3)
    for keys in (["key"], []):
        found = R.random_intercept(df.where("key = 'k'") if not keys else df, keys, ["grp", "x"], "y", "subject").collect()
        got = {q.term: q for q in found}
        assert len(found) == 3
        design = np.column_stack([np.ones(len(y)), group, x])
        z = (subject[:, None] == np.arange(24)).astype(float)

        def at(ratio):
            v = np.eye(len(y)) + ratio * z @ z.T
            w = np.linalg.inv(v)
            m = design.T @ w @ design
            slopes = np.linalg.solve(m, design.T @ w @ y)
            left = y - design @ slopes
            n = len(y) - 3
            s = left @ w @ left / n
            return -0.5 * (n * (np.log(2 * np.pi * s) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(m)[1]), slopes, np.sqrt(s * np.diag(np.linalg.inv(m))), ratio * s, s

        ratio = got["x"].var_subject / got["x"].var_residual
        value, slopes, errors, var_subject, var_residual = at(ratio)
        assert all(value >= at(q)[0] - 1e-9 for q in [0.0, *np.exp(np.linspace(-8, 4, 200))])
        assert math.isclose(got["x"].log_likelihood, value, rel_tol=1e-9)
        assert np.allclose([got[t].slope for t in ("intercept", "grp", "x")], slopes) and np.allclose([got[t].se for t in ("intercept", "grp", "x")], errors)
        assert np.allclose([got["x"].var_subject, got["x"].var_residual], [var_subject, var_residual]) and got["grp"].n_subjects == 24
        assert math.isclose(got["grp"].p, math.erfc(abs(got["grp"].z) / math.sqrt(2)), rel_tol=1e-9)
