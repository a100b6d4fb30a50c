"""Special functions Spark SQL lacks, as Column expressions and numpy twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Stirling series of log-gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
SHIFT = 10


def lgamma(x: Column) -> Column:
    """log Γ(x), x > 0: argument shifted up by ten, then the Stirling series."""
    x = x.cast("double")
    z = x + SHIFT
    rising = x
    for i in range(1, SHIFT):
        rising = rising * (x + i)
    inv = 1 / z
    inv2 = inv * inv
    tail = inv * (
        STIRLING[0] + inv2 * (STIRLING[1] + inv2 * (STIRLING[2] + inv2 * STIRLING[3]))
    )
    return (z - 0.5) * F.ln(z) - z + HALF_LOG_2PI + tail - F.ln(rising)


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """The same series on arrays, for use inside tasks."""
    x = np.asarray(x, dtype=float)
    z = x + SHIFT
    rising = x.copy()
    for i in range(1, SHIFT):
        rising = rising * (x + i)
    inv = 1 / z
    inv2 = inv * inv
    tail = inv * (
        STIRLING[0] + inv2 * (STIRLING[1] + inv2 * (STIRLING[2] + inv2 * STIRLING[3]))
    )
    return (z - 0.5) * np.log(z) - z + HALF_LOG_2PI + tail - np.log(rising)


def bernoulli_entropy(f: Column) -> Column:
    """Entropy in bits of a Bernoulli rate; 0 at and beyond the ends."""
    inside = (f > 0) & (f < 1)
    safe = F.when(inside, f).otherwise(F.lit(0.5))
    bits = -safe * F.log2(safe) - (1 - safe) * F.log2(1 - safe)
    return F.when(inside, bits).otherwise(F.lit(0.0))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, Lentz above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi2_tail(stat: float, dof: float) -> float:
    """P(X >= stat) of a chi-square variable; one when there is no freedom left."""
    if dof <= 0:
        return 1.0
    return gamma_q(dof / 2, stat / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log(1 - x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(dof: int, confidence: float = 0.95) -> float:
    """Two-sided Student t quantile by bisection on the distribution function."""
    target = (1 - confidence) / 2

    def upper_tail(t: float) -> float:
        return 0.5 * beta_inc(dof / 2, 0.5, dof / (dof + t * t))

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper_tail(mid) > target else (lo, mid)
    return (lo + hi) / 2
