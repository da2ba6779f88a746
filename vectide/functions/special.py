"""Special functions that neither Spark nor NumPy has."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def log_gamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def log_mv_gamma(a: float, p: int) -> float:
    """Log of the multivariate gamma function of dimension p."""
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(a - j / 2) for j in range(p))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the continued fraction of modified Lentz steps."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def gamma_from_mode(mode: float, sd: float) -> tuple[float, float]:
    """Shape and rate of the gamma distribution with this mode and standard deviation."""
    r = 2 + mode * mode / (sd * sd)
    shape = (r + math.sqrt(r * r - 4)) / 2
    return shape, math.sqrt(shape) / sd
