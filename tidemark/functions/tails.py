"""Distribution functions as column expressions: chi-square tails, error function, normal density and quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

CHI2_1_AT_5PCT = 3.841458820694124  # fixed value: the 95 % point of chi-square with one degree of freedom
_SERIES_TERMS = 260
_ERF_FAR = 7.0


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by the all-positive series of erf; 0 beyond 7 (below 5e-23)."""
    near = F.least(x, F.lit(_ERF_FAR))
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum_k  x * (2x^2)^k / (1*3*...*(2k+1))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.struct(near.alias("term"), near.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * near * near * 2.0 / (k * 2 + 1)).alias("term"),
            (acc["total"] + acc["term"] * near * near * 2.0 / (k * 2 + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    value = 1.0 - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-near * near) * total
    return F.when(x >= _ERF_FAR, F.lit(0.0)).otherwise(F.greatest(value, F.lit(0.0)))


def chi2_sf_1(statistic: Column) -> Column:
    return erfc(F.sqrt(statistic / 2.0))


def chi2_sf_2(statistic: Column) -> Column:
    return F.exp(-statistic / 2.0)


def chi2_sf_even(statistic: Column, df: int) -> Column:
    """Exact upper tail for an even number of degrees of freedom."""
    if df % 2:
        raise ValueError(f"df must be even, got {df}")
    half = statistic / 2.0
    terms = sum((F.pow(half, F.lit(i)) / math.factorial(i) for i in range(1, df // 2)), F.lit(1.0))
    return F.exp(-half) * terms


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    z = (x - mean) / std
    return F.exp(-z * z / 2.0) / (std * math.sqrt(2.0 * math.pi))


# Coefficients of P. J. Acklam's rational approximation to the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
NORMAL_QUANTILE_COEFFICIENTS = {"a": _A, "b": _B, "c": _C, "d": _D}
_LOW = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + c
    return value


def normal_quantile(p: Column) -> Column:
    low = F.sqrt(F.lit(-2.0) * F.ln(p))
    high = F.sqrt(F.lit(-2.0) * F.ln(1.0 - p))
    middle = p - 0.5
    square = middle * middle
    return (
        F.when(p < _LOW, _horner(_C, low) / _horner(_D, low))
        .when(p > 1.0 - _LOW, -_horner(_C, high) / _horner(_D, high))
        .otherwise(_horner(_A, square) * middle / _horner(_B, square))
    )
