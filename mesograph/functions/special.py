"""Tail probabilities: the normal one as a column expression, the others over small result tables."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column) -> Column:
    """Complementary error function: a power series under 3, a continued fraction above; good to about 1e-15."""
    a = F.abs(x)
    square = a * a
    start = F.struct(a.alias("term"), a.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * (2.0 * square) / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda acc: acc["sum"])
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-square) * series
    fraction = F.aggregate(F.sequence(F.lit(50), F.lit(1), F.lit(-1)), a, lambda acc, k: a + (k / 2.0) / acc)
    far = F.exp(-square) / (F.lit(math.sqrt(math.pi)) * fraction)
    tail = F.when(a < 3.0, near).otherwise(far)
    return F.when(x < 0, F.lit(2.0) - tail).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2.0))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


# ---- scalar helpers for tables of a few rows

def beta_reg(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front / (a * _beta_denominator(a, b, x))
    return 1.0 - front / (b * _beta_denominator(b, a, 1.0 - x))


def _beta_denominator(a: float, b: float, x: float) -> float:
    """1 + d1/(1 + d2/(1 + ...)) evaluated from the far end."""
    value = 1.0
    for j in range(300, 0, -1):
        m = j // 2
        step = (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if j % 2 == 0
                else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        value = 1.0 + step / value
    return value


def t_two_sided(t: float, df: float) -> float:
    return beta_reg(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    value = 0.0
    for k in range(300, 0, -1):
        value = k * (k - a) / (x + 2 * k + 1.0 - a - value)
    return front / (x + 1.0 - a - value)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """Inverse of the t distribution for p >= 0.5 by bisection."""
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, df) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - t_two_sided(mid, df) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def kolmogorov_upper(d: float, n: float) -> float:
    """Asymptotic one-sample tail with the usual small-sample shift."""
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2.0 * np.sum((-1.0) ** (k - 1) * np.exp(-2.0 * k * k * lam * lam)))))


@functools.cache
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    """The normal distribution function at steps of 1/2000, for interpolation with an error under 1e-8."""
    x = np.linspace(-10.0, 10.0, 40_001)
    return x, np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in x])


@functools.lru_cache(maxsize=100_000)
def studentized_range_upper(q: float, groups: int, df: float) -> float:
    """Tail of the studentised range: the range integral averaged over the spread of the pooled deviation."""
    z = np.linspace(-8.0, 8.0, 801)
    density = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    half = df / 2.0
    width = 8.0 / math.sqrt(2.0 * df)
    s = np.linspace(max(1e-6, 1.0 - width), 1.0 + width, 201)
    log_pdf = math.log(2.0) + half * math.log(half) - math.lgamma(half) + (df - 1.0) * np.log(s) - half * s * s
    table = _normal_table()
    between = np.interp(z, *table)[None, :] - np.interp(z[None, :] - q * s[:, None], *table)
    inner = np.trapezoid(groups * density * between ** (groups - 1), z, axis=1)
    cdf = np.trapezoid(inner * np.exp(log_pdf), s) / np.trapezoid(np.exp(log_pdf), s)
    return float(min(1.0, max(0.0, 1.0 - cdf)))


def rowwise(fn, *cols: Column) -> Column:
    """Apply a scalar helper to the rows of a small result table; a null or NaN argument gives null."""
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(fn(*row)) for row in rows.itertuples(index=False)],
                         dtype="float64")

    packed = F.struct(*[c.cast("double").alias(f"a{i}") for i, c in enumerate(cols)])
    return F.pandas_udf(run, "double")(packed)
