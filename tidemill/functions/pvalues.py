"""Tail probabilities for the t, F and chi-square tests, as vectorised column functions.

They run on results of one row per test, never on raw rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY = 1e-300
#: From here on differences of log-gamma values lose the digits that results show.
LARGE = 1e6


def _fraction(step, limit: int = 1_000_000, tolerance: float = 1e-15) -> float:
    """Evaluate a continued fraction (Lentz); ``step(i)`` yields its i-th pair of terms."""
    a0, b0 = step(0)
    f = b0 or _TINY
    c, d = f, 0.0
    for i in range(1, limit):
        a, b = step(i)
        d = b + a * d
        d = 1.0 / (d or _TINY)
        c = b + a / c
        c = c or _TINY
        f *= c * d
        if abs(c * d - 1.0) < tolerance:
            return f
    raise ArithmeticError(f"no convergence after {limit} steps")


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a

    def step(i):
        return (_beta_term(a, b, x, i) if i else 0.0), 1.0

    return front / _fraction(step)


def _beta_term(a: float, b: float, x: float, i: int) -> float:
    m = i // 2
    if i % 2 == 0:
        return m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
    return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))


def gamma_tail(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0.0:
        return 1.0
    away = (x - s) / s
    if s > 10 * LARGE:
        # the cube root of a gamma variable is nearly normal
        return _normal_upper((math.expm1(math.log1p(away) / 3.0) + 1.0 / (9.0 * s)) * 3.0 * math.sqrt(s))
    if s > 1e3:
        # Stirling's series for the gamma function, with the large terms cancelled by hand
        series = 1.0 / (12.0 * s) - 1.0 / (360.0 * s**3)
        front = math.sqrt(s / (2.0 * math.pi)) * math.exp(s * (math.log1p(away) - away) - series)
    else:
        front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    return front / _fraction(lambda i: (-i * (i - s), x + 2 * i + 1 - s) if i else (0.0, x + 1 - s))


def _normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_two_sided(t: float, dof: float) -> float:
    if dof > LARGE:
        # normal approximation with an error of the order 1 / dof**2
        return 2.0 * _normal_upper(abs(t) * (1.0 - 0.25 / dof) / math.sqrt(1.0 + t * t / (2.0 * dof)))
    return beta_tail(dof / 2.0, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if d2 > LARGE and d1 < d2 / 1e3:
        # chi-square approximation (Li and Martin, 2002) with an error of the order 1 / d2**2
        x = d1 * f
        return gamma_tail(d1 / 2.0, x * (2.0 * d2 + x / 3.0 + d1 - 2.0) / (2.0 * d2 + 4.0 * x / 3.0) / 2.0)
    return beta_tail(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x: float, dof: float) -> float:
    return gamma_tail(dof / 2.0, x / 2.0)


def _each(function, *series: pd.Series) -> pd.Series:
    def one(*values):
        usable = all(v is not None and math.isfinite(v) for v in values)
        return function(*values) if usable else None

    return pd.Series([one(*row) for row in zip(*series)], dtype="float64")


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, dof)


@pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_upper, f, d1, d2)


@pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(chi2_upper, x, dof)
