"""Distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-F.pow((x - mean) / sd, 2) / 2) / (sd * math.sqrt(2 * math.pi))


@pandas_udf(T.DoubleType())
def _standard_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(-v / math.sqrt(2)) / 2)


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    """Runs in Python over Arrow batches, as the quantile and beta_cdf do: Spark has no error function."""
    return _standard_cdf((x - mean) / sd)


@pandas_udf(T.DoubleType())
def _standard_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None)


def normal_quantile(p: Column, mean: Column, sd: Column) -> Column:
    """Null unless 0 < p < 1."""
    return mean + sd * _standard_quantile(p)


def log_factorial(n: Column) -> Column:
    """The sum of the logarithms of 1 to n."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + F.ln(k))


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    chosen = log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    inside = F.when(p == 0, F.when(k == 0, 1.0).otherwise(0.0)).when(p == 1, F.when(k == n, 1.0).otherwise(0.0)).otherwise(F.exp(chosen + k * F.ln(p) + (n - k) * F.ln(1 - p)))
    return F.when(k.between(0, n), inside).otherwise(F.when(k.isNotNull() & n.isNotNull(), F.lit(0.0)))


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.exp(k * F.ln(rate) - rate - log_factorial(k)))


def exponential_cdf(x: Column, rate: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(1 - F.exp(-rate * x))


def _beta(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


@pandas_udf(T.DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(u) or pd.isna(v) or pd.isna(w) else _beta(u, v, w) for u, v, w in zip(x, a, b)], dtype="Float64").astype("object").where(lambda s: s.notna(), None).astype(float)
