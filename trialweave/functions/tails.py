"""Tail areas of the t and normal distributions, as Arrow-batched UDFs on NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz); ``rest`` is 1 - x, which cannot be had from an x near 1."""
    a, b, x, rest = (np.array(v, float) for v in np.broadcast_arrays(a, b, x, rest))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x, rest = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, rest, x), np.where(swap, x, rest)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_x, log_rest = np.where(x < 0.5, np.log(x), np.log1p(-rest)), np.where(x < 0.5, np.log1p(-x), np.log(rest))
        front = np.exp(a * log_x + b * log_rest + _lgamma(a + b) - _lgamma(a) - _lgamma(b)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
        if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
            break
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t)."""
    whole = df + np.square(t)
    half = 0.5 * beta_share(np.asarray(df, float) / 2, 0.5, df / whole, np.square(t) / whole)
    return np.where(np.asarray(t) >= 0, half, 1 - half)


def normal_upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def normal_isf(p: np.ndarray) -> np.ndarray:
    """z with P(Z > z) = p, by bisection on the tail."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -39.0), np.full(p.shape, 39.0)
    for _ in range(80):
        mid = (low + high) / 2
        above = normal_upper(mid) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_p_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, t.index)
    out[ok] = t_upper(t[ok].to_numpy(), df[ok].to_numpy(float))
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def t_p_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, t.index)
    out[ok] = 2 * t_upper(t[ok].abs().to_numpy(), df[ok].to_numpy(float))
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def z_from_p(p: pd.Series) -> pd.Series:
    """Two-sided p to an unsigned z; p is held to 1e-300 at least."""
    ok = p.notna()
    out = pd.Series(np.nan, p.index)
    out[ok] = normal_isf(np.clip(p[ok].to_numpy(float), 1e-300, 1) / 2)
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def z_p_two_sided(z: pd.Series) -> pd.Series:
    ok = z.notna()
    out = pd.Series(np.nan, z.index)
    out[ok] = 2 * normal_upper(z[ok].abs().to_numpy(float))
    return out.where(ok, None)
