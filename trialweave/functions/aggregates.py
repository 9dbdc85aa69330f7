"""Aggregates that give NULL where Spark's own raise an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over rows with both values; NULL where one of them does not vary (``F.corr`` divides by zero there, and no ``when`` around it prevents that)."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
