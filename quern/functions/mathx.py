"""Scalar expressions Spark has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: erf approximation of Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * a)
    poly = F.lit(0.0)
    for c in reversed(ERF_A):
        poly = (poly + F.lit(c)) * t
    y = F.lit(1.0) - poly * F.exp(-a * a)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    return (F.lit(1.0) + erf(x / F.lit(2.0**0.5))) / 2


def sql_norm_cdf(x: str) -> str:
    """The same formula as SQL text, for comparison queries."""
    z = f"(({x}) / {2.0**0.5!r})"
    t = f"(1.0 / (1.0 + {ERF_P} * abs({z})))"
    poly = "0.0"
    for c in reversed(ERF_A):
        poly = f"(({poly} + {c}) * {t})"
    return f"((1.0 + (CASE WHEN {z} < 0 THEN -1.0 ELSE 1.0 END) * (1.0 - {poly} * exp(-{z} * {z}))) / 2)"


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness: null below 3 values, 0 for a constant group."""
    n = F.count(x).cast("double")
    g = F.skewness(x)
    return F.when(n < 3, None).when(F.var_pop(x) == 0, 0.0).otherwise(F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * g)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: null below 4 values, 0 for a constant group."""
    n = F.count(x).cast("double")
    g = F.kurtosis(x)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n < 4, None).when(F.var_pop(x) == 0, 0.0).otherwise(scale * ((n + 1) * g + 6))


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to [lo, hi]; null stays null (least and greatest alone would skip it)."""
    y = x if lo is None else F.greatest(x, F.lit(lo))
    y = y if hi is None else F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def micros(col: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
