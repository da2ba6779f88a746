"""Simulation. Draws are keyed by block or path, never by partition, so they do not depend on the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vectide.functions.design import Lags, minnesota_dummies
from vectide.operators.gram import Gram
from vectide.operators.niw import draw_iw, draw_mn, minnesota_prior

BLOCK = 10_000


def root_of(sigma: np.ndarray, method: str = "eigen") -> np.ndarray:
    if method == "chol":
        return np.linalg.cholesky(sigma)
    w, v = np.linalg.eigh(sigma)
    return v * np.sqrt(np.maximum(w, 0)) @ v.T


def sim_mnormal(spark: SparkSession, n: int, mu: np.ndarray, sigma: np.ndarray, method: str = "eigen", seed: int = 1, df: float | None = None) -> DataFrame:
    """``n`` rows (i, y1..ym) of a multivariate normal, or of a Student t with ``df`` degrees of freedom."""
    mu, root = np.asarray(mu, dtype=float), root_of(np.asarray(sigma, dtype=float), method)
    m, blocks = len(mu), max(1, -(-n // BLOCK))
    names = [f"y{j + 1}" for j in range(m)]

    def run(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                k, rng = min(BLOCK, n - b * BLOCK), np.random.default_rng([seed, b])
                z = rng.standard_normal((k, m)) @ root.T
                if df is not None:
                    z /= np.sqrt(rng.chisquare(df, k) / df)[:, None]
                yield pd.DataFrame(z + mu, columns=names).assign(i=np.arange(b * BLOCK + 1, b * BLOCK + k + 1))[["i", *names]]

    return spark.range(0, blocks, 1, blocks).mapInPandas(run, "i long, " + ", ".join(f"{c} double" for c in names))


def sim_mvt(spark: SparkSession, n: int, df: float, mu: np.ndarray, sigma: np.ndarray, method: str = "eigen", seed: int = 1) -> DataFrame:
    return sim_mnormal(spark, n, mu, sigma, method, seed, df)


def sim_matgaussian(mean: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int = 1, seed: int = 1, precision: bool = False) -> np.ndarray:
    """(n, k, m) matrix normal draws; ``rows`` is the covariance across rows, or its inverse with ``precision``."""
    prec = np.asarray(rows, dtype=float) if precision else np.linalg.inv(rows)
    return draw_mn(np.asarray(mean, dtype=float), prec, np.repeat(np.asarray(columns, dtype=float)[None], n, axis=0), np.random.default_rng(seed))


def sim_iw(scale: np.ndarray, shape: float, n: int = 1, seed: int = 1) -> np.ndarray:
    return draw_iw(np.asarray(scale, dtype=float), shape, n, np.random.default_rng(seed))


def sim_mniw(n: int, mean: np.ndarray, rows: np.ndarray, scale: np.ndarray, shape: float, seed: int = 1, precision: bool = False) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    sigmas = draw_iw(np.asarray(scale, dtype=float), shape, n, rng)
    return draw_mn(np.asarray(mean, dtype=float), np.asarray(rows, dtype=float) if precision else np.linalg.inv(rows), sigmas, rng), sigmas


def sim_minnesota(spec, sigma: np.ndarray, lags: Lags, full: bool = True, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance from the Minnesota prior; with ``full`` the covariance is inverse Wishart, else diagonal."""
    dim = len(sigma)
    one = np.broadcast_to(np.asarray(spec.delta, dtype=float), (dim,))
    delta = [np.broadcast_to(np.asarray(x, dtype=float), (dim,)) for x in (spec.delta, spec.weekly, spec.monthly)] if lags.har and spec.weekly is not None else one
    y, x = minnesota_dummies(np.asarray(sigma, dtype=float), 3 if lags.har else lags.p, spec.lam, delta, spec.eps, lags.include_mean)
    mean, prec, scale, shape = minnesota_prior(Gram.of(x, y))
    rng = np.random.default_rng(seed)
    s = draw_iw(scale, max(shape, dim + 2), 1, rng) if full else np.diag(np.asarray(sigma, dtype=float) ** 2)[None]
    return draw_mn(mean, prec, s, rng)[0], s[0]


def sim_path(coef: np.ndarray, sigma: np.ndarray, lags: Lags, n: int, burn: int = 100, rng: np.random.Generator | None = None, df: float | None = None, init: np.ndarray | None = None, method: str = "eigen") -> np.ndarray:
    """``n`` rows of one path. Student errors are scaled to the covariance ``sigma``."""
    rng, m, q = rng or np.random.default_rng(1), len(sigma), lags.order
    b = lags.transform(m).T @ coef
    e = rng.standard_normal((n + burn, m)) @ root_of(np.asarray(sigma, dtype=float), method).T
    if df is not None:
        e *= np.sqrt((df - 2) / df) / np.sqrt(rng.chisquare(df, n + burn) / df)[:, None]
    state = np.zeros(m * q) if init is None else np.asarray(init, dtype=float)[::-1].ravel()
    const, out = b[m * q :].sum(axis=0), np.empty((n + burn, m))
    for t in range(n + burn):
        out[t] = state @ b[: m * q] + const + e[t]
        state = np.r_[out[t], state[:-m]]
    return out[burn:]


def sim_var(spark: SparkSession, coef: np.ndarray, sigma: np.ndarray, lags: Lags, n: int, burn: int = 100, paths: int = 1, seed: int = 1, df: float | None = None) -> DataFrame:
    """path, t, y1..ym: one task for each path, since a recursion has an order."""
    coef, sigma = np.asarray(coef, dtype=float), np.asarray(sigma, dtype=float)
    names = [f"y{j + 1}" for j in range(len(sigma))]

    def run(batches):
        for pdf in batches:
            for i in pdf["id"].tolist():
                y = sim_path(coef, sigma, lags, n, burn, np.random.default_rng([seed, i]), df)
                yield pd.DataFrame(y, columns=names).assign(path=i, t=np.arange(1, n + 1))[["path", "t", *names]]

    return spark.range(0, paths, 1, paths).mapInPandas(run, "path long, t long, " + ", ".join(f"{c} double" for c in names))
