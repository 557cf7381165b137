"""Exact ratios, so that rates do not depend on floating point summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(num, den, digits: int) -> Column:
    """``num / den`` rounded half to even at ``digits``; NULL for a zero denominator.

    Both arguments are whole numbers. Integer arithmetic keeps ties exact.
    """
    scale = 10**digits
    n = _c(num).cast("decimal(28,0)") * F.lit(scale).cast("decimal(8,0)")
    d = F.nullif(_c(den).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    q = F.call_function("div", n, d)
    twice_rest = (n - q.cast("decimal(28,0)") * d) * 2
    up = (twice_rest > d) | ((twice_rest == d) & (q % 2 != 0))
    return (q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale))


def weighted_position(position, weight, digits: int = 1) -> Column:
    """Aggregate: mean position weighted by impressions, from positions with two decimals."""
    cents = F.round(_c(position) * 100, 0).cast("bigint")
    return ratio(F.sum(cents * _c(weight)), F.sum(_c(weight)) * 100, digits)


def quotient(num, den) -> Column:
    """Unrounded double quotient, NULL for a zero denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
