"""Kernels on array<double> columns: higher-order functions only, evaluated in the JVM.

Missing values are NULL or NaN elements. A kernel that divides by a norm of 0 gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_VALID = 0.80


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def total(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def scale(a: Column | str, by: Column) -> Column:
    return F.transform(_col(a), lambda x: x * by)


def mean(a: Column | str) -> Column:
    return F.try_divide(total(a), F.size(_col(a)).cast("double"))


def finite_fraction(a: Column | str) -> Column:
    """Share of finite elements."""
    return F.try_divide(F.size(F.filter(_col(a), is_finite)).cast("double"), F.size(_col(a)).cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Plain cosine; NULL if a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_valid(a: Column | str, b: Column | str, min_valid: float = MIN_VALID) -> Column:
    """Cosine over jointly finite elements; NULL if fewer than ``min_valid`` of all are, or a norm is 0."""
    pairs = F.filter(F.zip_with(_col(a), _col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: is_finite(p["x"]) & is_finite(p["y"]))
    sums = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
        lambda s, v: F.struct((s["xy"] + v["x"] * v["y"]).alias("xy"), (s["xx"] + v["x"] * v["x"]).alias("xx"), (s["yy"] + v["y"] * v["y"]).alias("yy")),
        lambda s: F.try_divide(s["xy"], F.sqrt(s["xx"]) * F.sqrt(s["yy"])),
    )
    return let(pairs, lambda p: F.when(F.try_divide(F.size(p).cast("double"), F.size(_col(a)).cast("double")) >= min_valid, sums(p)))


def _minus_mean(a: Column) -> Column:
    """Finite elements less their mean, 0 for the others."""
    middle = mean(F.filter(a, is_finite))
    return let(middle, lambda m: F.transform(a, lambda x: F.when(is_finite(x), x - m).otherwise(F.lit(0.0))))


def center_normalize(a: Column | str) -> Column:
    """Subtract the mean of the finite elements, set the others to 0, divide by the norm (by 1 if that is 0)."""
    return let(_minus_mean(_col(a)), lambda c: let(norm(c), lambda n: F.transform(c, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two vectors; NULL if one is constant."""
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred(_col(a)), lambda x: let(centred(_col(b)), lambda y: cosine(x, y)))


def correlation_distance(a: Column | str, b: Column | str) -> Column:
    return 1.0 - pearson(a, b)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return norm(subtract(a, b))


def scalar_projection(a: Column | str, b: Column | str) -> Column:
    """Length of ``a`` along ``b``."""
    return F.try_divide(dot(a, b), norm(b))


def trajectory(x: Column | str, start: Column | str, target: Column | str) -> Column:
    """Where x stands on the way from start (0) to target (1)."""
    return let(subtract(target, start), lambda axis: F.try_divide(dot(subtract(x, start), axis), dot(axis, axis)))


def per_feature(value: Column, a: Column | str) -> Column:
    return F.try_divide(value, F.size(_col(a)).cast("double"))


def bernoulli_entropy(p: Column, floor: float = 1e-9) -> Column:
    """Entropy of a yes-or-no outcome, in bits."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), p))
    return -(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p))


def decision_margin(p: Column) -> Column:
    return F.abs(p - 0.5)


def p_from_log10(minus_log10: Column) -> Column:
    return F.pow(F.lit(10.0), -minus_log10)


def affine(i: Column, j: Column, k: Column, matrix: list[list[float]]) -> list[Column]:
    """World coordinates of a voxel, from the upper three rows of a 4 x 4 matrix."""
    return [a * i + b * j + c * k + d for a, b, c, d in matrix[:3]]


def gather(a: Column | str, places: Column | list[int]) -> Column:
    """Elements at some places, from 0."""
    places = F.array(*[F.lit(x) for x in places]) if isinstance(places, list) else places
    return F.transform(places, lambda k: F.get(_col(a), k))


def masked(a: Column | str, mask: Column | str) -> Column:
    """Elements where a boolean vector is true."""
    return F.transform(F.filter(F.arrays_zip(_col(a).alias("v"), _col(mask).alias("m")), lambda x: x["m"]), lambda x: x["v"])
