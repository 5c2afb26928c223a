"""Column functions: M values, guarded correlation, p-values of a correlation, quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6
LEAST_SD = 1e-9


def m_value(beta: Column) -> Column:
    """log2(b / (1 - b + 1e-6) + 1e-6); NaN counts as null."""
    b = F.nanvl(beta, F.lit(None).cast("double"))
    return F.log2(b / (F.lit(1.0) - b + F.lit(TINY)) + F.lit(TINY))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def unit(x: Column) -> Column:
    """An array without nulls, centred and scaled to length 1, so that a correlation is a dot product; null where it is constant."""
    n = F.size(x).cast("double")
    centred = let(total(x) / n, lambda m: F.transform(x, lambda a: a - m))
    scaled = lambda c: let(F.sqrt(total(F.transform(c, lambda a: a * a)) / n), lambda sd: F.when(sd > LEAST_SD, F.transform(c, lambda a: a / (sd * F.sqrt(n)))))
    return let(centred, scaled)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two equally long arrays without nulls; null where one is constant."""
    return dot(unit(x), unit(y))


def correlation_p(r: Column, df: int) -> Column:
    """Two-sided p of a correlation with df degrees of freedom, as the finite series of the t distribution."""
    a = F.least(F.lit(1.0), F.abs(r))
    c2 = F.lit(1.0) - a * a
    if df < 1:
        return F.lit(None).cast("double")
    if df % 2 == 0:
        coef, series = 1.0, F.lit(1.0)
        for k in range(1, df // 2):
            coef *= (2 * k - 1) / (2 * k)
            series = series + F.lit(coef) * F.pow(c2, k)
        return F.lit(1.0) - a * series
    inner = F.asin(a)
    if df >= 3:
        coef, series = 1.0, F.lit(1.0)
        for k in range(1, (df - 3) // 2 + 1):
            coef *= 2 * k / (2 * k + 1)
            series = series + F.lit(coef) * F.pow(c2, k)
        inner = inner + a * F.sqrt(c2) * series
    return F.lit(1.0) - F.lit(2 / math.pi) * inner


def quantile8(values: Column, p: float) -> Column:
    """Median-unbiased quantile (type 8) of a sorted array."""
    n = F.size(values)
    h = (n.cast("double") + 1 / 3) * p + 1 / 3
    low = F.greatest(F.lit(1), F.least(n, F.floor(h).cast("int")))
    high = F.greatest(F.lit(1), F.least(n, F.floor(h).cast("int") + 1))
    a, b = F.element_at(values, low), F.element_at(values, high)
    return a + (h - F.floor(h)) * (b - a)
