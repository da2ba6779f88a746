"""Choice of lag orders and of prior tightness. Every objective needs cross-product sums only, so no Spark job runs
while an optimiser steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vectide.functions.design import Lags, with_design
from vectide.operators import criteria
from vectide.operators.gram import lag_grams
from vectide.operators.ols import from_gram
from vectide.operators.priors import MinnesotaSpec
from vectide.sources.series import SeriesFrame

CRITERIA = ("AIC", "BIC", "HQ", "FPE")


@dataclass(frozen=True)
class LagChoice:
    table: DataFrame
    best: dict[str, int]


def choose_var(sf: SeriesFrame, spark: SparkSession, lag_max: int = 5, include_mean: bool = True) -> LagChoice:
    """lag, AIC, BIC, HQ, FPE for each lag order, and the order with the least of each; one pass over the rows."""
    design = with_design(sf.single().doubles(), Lags(lag_max, None, include_mean), skip=0)
    orders = {p: Lags(p, None, include_mean) for p in range(1, lag_max + 1)}
    grams = lag_grams(design, {p: g.terms(sf.names) for p, g in orders.items()}, list(sf.names))
    rows = [(p, *[criteria.rss_criteria(from_gram(grams[p], sf.names, orders[p]))[c] for c in CRITERIA]) for p in orders]
    best = {c: min(rows, key=lambda r: r[i + 1])[0] for i, c in enumerate(CRITERIA)}
    return LagChoice(spark.createDataFrame(rows, "lag int, AIC double, BIC double, HQ double, FPE double"), best)


def numeric_gradient(f: Callable, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    out = np.empty(len(x))
    for i in range(len(x)):
        h = 1e-5 * max(1.0, abs(x[i]))
        a, b = x.copy(), x.copy()
        a[i] = x[i] - h if low is None else max(low[i], x[i] - h)
        b[i] = x[i] + h if high is None else min(high[i], x[i] + h)
        out[i] = (f(b) - f(a)) / (b[i] - a[i])
    return out


def numeric_hessian(f: Callable, x: np.ndarray) -> np.ndarray:
    h = 1e-4 * np.maximum(1.0, np.abs(x))
    return np.array([(numeric_gradient(f, x + h[i] * e) - numeric_gradient(f, x - h[i] * e)) / (2 * h[i]) for i, e in enumerate(np.eye(len(x)))])


def minimise(f: Callable, x0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60, tol: float = 1e-7) -> np.ndarray:
    """Least value of ``f`` in a box: quasi-Newton steps (BFGS) on the coordinates not held at a bound, projected."""
    x = np.clip(np.asarray(x0, dtype=float), low, high)
    fx, g, h = f(x), numeric_gradient(f, x, low, high), np.eye(len(x))
    for _ in range(rounds):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < tol:
            break
        step = np.where(free, -(h * np.outer(free, free)) @ g, 0.0)
        if step @ g >= 0:
            h, step = np.eye(len(x)), np.where(free, -g, 0.0)
        size = 1.0
        while size > 1e-10:
            new = np.clip(x + size * step, low, high)
            f_new = f(new)
            if np.isfinite(f_new) and f_new <= fx + 1e-4 * g @ (new - x):
                break
            size /= 2
        else:
            break
        g_new = numeric_gradient(f, new, low, high)
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            h = left @ h @ left.T + r * np.outer(s, s)
        done = abs(fx - f_new) < tol * (abs(fx) + tol)
        x, fx, g = new, f_new, g_new
        if done:
            break
    return x


@dataclass(frozen=True)
class Bounds:
    """Boxes of the tuned values, as factors of the standard deviations and as plain bounds."""

    sigma: tuple[float, float] = (1e-2, 1e2)
    lam: tuple[float, float] = (1e-4, 10.0)
    mean: tuple[float, float] = (-1.0, 2.0)


def choose_bayes(sf: SeriesFrame, p: int = 1, har: tuple[int, int] | None = None, spec: MinnesotaSpec | None = None, bounds: Bounds | None = None, long_memory: bool = False, include_mean: bool = True):
    """Empirical Bayes: sigma, lambda and delta (for HAR models with ``long_memory`` also the weekly and monthly means)
    that maximise the marginal likelihood. Returns the spec, the posterior under it, and the log marginal likelihood."""
    from vectide.operators.niw import data_gram, dummies_of, posterior, sample_sd

    spec, bounds, lags = spec or MinnesotaSpec(), bounds or Bounds(), Lags(p, har, include_mean)
    sd, g, m = sample_sd(sf), data_gram(sf, lags), sf.dim
    parts = 3 if har and long_memory else 1

    def unpack(z):
        sigma, lam, means = np.exp(z[:m]) * sd, float(np.exp(z[m])), z[m + 1 :].reshape(parts, m)
        more = {"weekly": tuple(means[1]), "monthly": tuple(means[2])} if parts == 3 else {}
        return MinnesotaSpec(tuple(sigma), lam, tuple(means[0]), spec.eps, **more)

    def at(z):
        s = unpack(z)
        return posterior(sf.names, lags, g, dummies_of(s, lags, np.asarray(s.sigma)))

    def loss(z):
        try:
            return -criteria.log_ml(at(z))
        except np.linalg.LinAlgError:
            return np.inf

    low = np.r_[np.full(m, np.log(bounds.sigma[0])), np.log(bounds.lam[0]), np.full(parts * m, bounds.mean[0])]
    high = np.r_[np.full(m, np.log(bounds.sigma[1])), np.log(bounds.lam[1]), np.full(parts * m, bounds.mean[1])]
    start = np.r_[np.zeros(m), np.log(spec.lam), np.tile(np.broadcast_to(np.asarray(spec.delta, dtype=float), (m,)), parts)]
    best = minimise(loss, start, low, high)
    return unpack(best), at(best), -loss(best)
