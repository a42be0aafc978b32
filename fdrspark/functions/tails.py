"""Tail probabilities: as column expressions where an approximation does, exact for arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, the error function to 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_two_sided(z: Column) -> Column:
    """P(|N(0, 1)| > |z|) to 1.5e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def normal_two_sided_sql(z: str) -> str:
    x = f"(abs({z}) / {math.sqrt(2)!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {t})"
    return f"({poly} * exp(-{x} * {x}))"


def t_as_normal(t: Column, df: Column) -> Column:
    """A normal deviate with the two tails of t on df degrees of freedom (Hill's transform; to 1e-6 in p from 5 degrees on)."""
    a = df.cast("double") - 0.5
    b = 48.0 * a * a
    w = a * F.log1p(t * t / df)
    return F.sqrt(w) * (1.0 + (w + 3.0) / b - (((4.0 * w + 33.0) * w + 240.0) * w + 855.0) / (10.0 * b * (b + 0.8 * w * w + 100.0)))


def t_two_sided_column(t: Column, df: Column) -> Column:
    """P(|T_df| > |t|)."""
    return normal_two_sided(t_as_normal(t, df))


def t_two_sided_sql(t: str, df: str) -> str:
    a, d = f"(({df})::DOUBLE - 0.5::DOUBLE)", "::DOUBLE"
    b = f"(48.0{d} * {a} * {a})"
    w = f"({a} * ln(1.0{d} + ({t}) * ({t}) / ({df})))"
    z = f"(sqrt({w}) * (1.0{d} + ({w} + 3.0{d}) / {b} - (((4.0{d} * {w} + 33.0{d}) * {w} + 240.0{d}) * {w} + 855.0{d}) / (10.0{d} * {b} * ({b} + 0.8{d} * {w} * {w} + 100.0{d}))))"
    return normal_two_sided_sql(z)


# Acklam's rational approximation of the normal quantile, to 1.2e-9 relative.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_LOW = 0.02425


def _horner(x: Column, coefs) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The z that a standard normal stays below with probability p in (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = _horner(r, QUANTILE_A) * q / _horner(r, (*QUANTILE_B, 1.0))
    tail = lambda u: _horner(F.sqrt(-2.0 * F.log(u)), QUANTILE_C) / _horner(F.sqrt(-2.0 * F.log(u)), (*QUANTILE_D, 1.0))
    return F.when(p < QUANTILE_LOW, tail(p)).when(p > 1 - QUANTILE_LOW, -tail(1.0 - p)).otherwise(middle)


def normal_quantile_sql(p: str) -> str:
    def horner(x, coefs):
        out = f"({coefs[0]!r})::DOUBLE"
        for c in coefs[1:]:
            out = f"({out} * {x} + ({c!r})::DOUBLE)"
        return out

    q = f"({p} - 0.5::DOUBLE)"
    r = f"({q} * {q})"
    tail = lambda u: f"({horner(f'sqrt(-2.0::DOUBLE * ln({u}))', QUANTILE_C)} / {horner(f'sqrt(-2.0::DOUBLE * ln({u}))', (*QUANTILE_D, 1.0))})"
    middle = f"({horner(r, QUANTILE_A)} * {q} / {horner(r, (*QUANTILE_B, 1.0))})"
    return f"(CASE WHEN {p} < {QUANTILE_LOW}::DOUBLE THEN {tail(p)} WHEN {p} > {1 - QUANTILE_LOW!r}::DOUBLE THEN -{tail(f'(1.0::DOUBLE - {p})')} ELSE {middle} END)"


def normal_cdf(z: Column) -> Column:
    half = normal_two_sided(z) / 2.0
    return F.when(z < 0, half).otherwise(1.0 - half)


def normal_cdf_sql(z: str) -> str:
    half = f"({normal_two_sided_sql(z)} / 2.0::DOUBLE)"
    return f"(CASE WHEN {z} < 0 THEN {half} ELSE 1.0::DOUBLE - {half} END)"


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz scheme."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t, df: float) -> np.ndarray:
    """P(|T_df| > |t|)."""
    return np.array([incomplete_beta(df / 2, 0.5, df / (df + v * v)) if np.isfinite(v) else 0.0 for v in np.atleast_1d(t)])


def normal_tail(z) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in np.atleast_1d(z)])
