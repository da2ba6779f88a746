"""Conjugate Bayesian autoregressions: matrix normal coefficients, inverse Wishart covariance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.design import Lags, minnesota_dummies, with_design
from vectide.operators.gram import Gram, gram
from vectide.operators.ols import VarModel
from vectide.operators.priors import MinnesotaSpec
from vectide.sources.series import SeriesFrame


@dataclass(frozen=True)
class NiwPosterior(VarModel):
    """``coef`` is the posterior mean and ``sigma`` the mean of the inverse Wishart."""

    prec: np.ndarray
    scale: np.ndarray
    shape: float
    prior_mean: np.ndarray
    prior_prec: np.ndarray
    prior_scale: np.ndarray
    prior_shape: float
    data_gram: Gram

    @property
    def rss(self) -> np.ndarray:
        g, b = self.data_gram, self.coef
        return g.yy - b.T @ g.xy - g.xy.T @ b + b.T @ g.xx @ b


def minnesota_prior(dummies: Gram) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, precision, scale and shape that dummy observations stand for."""
    mean = np.linalg.solve(dummies.xx, dummies.xy)
    scale = dummies.yy - mean.T @ dummies.xx @ mean
    return mean, dummies.xx, (scale + scale.T) / 2, dummies.n - len(dummies.xx) + 2


def fitted(data: Gram, prior: Gram) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual cross products of data and prior rows together. With a constant, both are taken about the
    data's means: each row less its constant's share of them, which keeps small differences beside large means."""
    if data.core is None:
        both = data + prior
        b = np.linalg.solve(both.xx, both.xy)
        return b, both.yy - b.T @ both.xx @ b
    k, total = len(data.xx), len(data.xx) + len(data.yy)
    use = np.arange(total) != k - 1
    shift = np.eye(total)
    shift[k - 1, use] = -data.means
    full = shift.T @ np.block([[prior.xx, prior.xy], [prior.xy.T, prior.yy]]) @ shift
    full[np.ix_(use, use)] += data.core
    full[k - 1, k - 1] += data.n
    b = np.linalg.solve(full[:k, :k], full[:k, k:])
    scale = full[k:, k:] - b.T @ full[:k, :k] @ b
    b[k - 1] += data.means[k - 1 :] - data.means[: k - 1] @ b[: k - 1]
    return b, scale


def posterior(names: tuple[str, ...], lags: Lags, data: Gram, dummies: Gram) -> NiwPosterior:
    mean0, prec0, scale0, shape0 = minnesota_prior(dummies)
    both = data + dummies
    mean, scale = fitted(data, dummies)
    scale, shape, m = (scale + scale.T) / 2, shape0 + data.n, len(names)
    return NiwPosterior(names, lags, mean, scale / max(shape - m - 1, 1), int(data.n), both.xx, scale, shape, mean0, prec0, scale0, shape0, data)


def data_gram(sf: SeriesFrame, lags: Lags) -> Gram:
    return gram(with_design(sf.single().doubles(), lags), lags.terms(sf.names), list(sf.names))


def sample_sd(sf: SeriesFrame) -> np.ndarray:
    row = sf.single().df.agg(*[F.stddev_samp(c).alias(c) for c in sf.names]).first()
    return np.array([row[c] for c in sf.names])


def dummies_of(spec: MinnesotaSpec, lags: Lags, sigma: np.ndarray, lam: float | None = None) -> Gram:
    dim = len(sigma)
    delta = np.broadcast_to(np.asarray(spec.delta, dtype=float), (dim,))
    means: np.ndarray | list[np.ndarray] = delta
    if lags.har and spec.weekly is not None:
        means = [np.broadcast_to(np.asarray(x, dtype=float), (dim,)) for x in (spec.delta, spec.weekly, spec.monthly)]
    y, x = minnesota_dummies(sigma, 3 if lags.har else lags.p, spec.lam if lam is None else lam, means, spec.eps, lags.include_mean)
    return Gram.of(x, y)


def var_minnesota(sf: SeriesFrame, p: int = 1, spec: MinnesotaSpec | None = None, include_mean: bool = True) -> NiwPosterior:
    spec, lags = spec or MinnesotaSpec(), Lags(p, None, include_mean)
    sigma = np.asarray(spec.sigma, dtype=float) if spec.sigma is not None else sample_sd(sf)
    return posterior(sf.names, lags, data_gram(sf, lags), dummies_of(spec, lags, sigma))


def vhar_minnesota(sf: SeriesFrame, har: tuple[int, int] = (5, 22), spec: MinnesotaSpec | None = None, include_mean: bool = True) -> NiwPosterior:
    """With ``weekly`` and ``monthly`` in the spec, prior means on all three parts; without, on the day part only."""
    spec, lags = spec or MinnesotaSpec(), Lags(1, tuple(har), include_mean)
    sigma = np.asarray(spec.sigma, dtype=float) if spec.sigma is not None else sample_sd(sf)
    return posterior(sf.names, lags, data_gram(sf, lags), dummies_of(spec, lags, sigma))


def var_flat(sf: SeriesFrame, p: int = 1, prior_prec: np.ndarray | float = 1.0, include_mean: bool = True, har: tuple[int, int] | None = None) -> NiwPosterior:
    """Flat prior with precision ``prior_prec`` (a number stands for that number times the identity)."""
    lags = Lags(p, har, include_mean)
    return flat_posterior(sf.names, lags, data_gram(sf, lags), prior_prec)


def flat_posterior(names: tuple[str, ...], lags: Lags, g: Gram, prior_prec: np.ndarray | float = 1.0) -> NiwPosterior:
    k, m = len(g.xx), len(names)
    u = np.eye(k) * prior_prec if np.isscalar(prior_prec) else np.asarray(prior_prec, dtype=float)
    prec = g.xx + u
    mean, scale = fitted(g, Gram(u, np.zeros((k, m)), np.zeros((m, m)), 0))
    scale, shape = (scale + scale.T) / 2, g.n - m - 1
    return NiwPosterior(names, lags, mean, scale / max(shape - m - 1, 1), int(g.n), prec, scale, shape, np.zeros((k, m)), u, np.zeros((m, m)), 0.0, g)


def draw_iw(scale: np.ndarray, shape: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` inverse Wishart matrices by Bartlett's decomposition."""
    m = len(scale)
    a = np.zeros((n, m, m))
    for i in range(m):
        a[:, i, i] = np.sqrt(rng.chisquare(shape - i, n))
        a[:, i, :i] = rng.standard_normal((n, i))
    # the precision is U a a' U' with U U' = scale^-1, so the matrix itself is B B' with B = chol(scale) a'^-1
    b = np.linalg.cholesky(scale) @ np.linalg.inv(np.swapaxes(a, 1, 2))
    return b @ np.swapaxes(b, 1, 2)


def draw_mn(mean: np.ndarray, prec: np.ndarray, sigmas: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One matrix normal draw for each covariance across columns; ``prec`` is the precision across rows."""
    c = np.linalg.cholesky(prec)
    z = np.linalg.solve(c.T, rng.standard_normal((len(sigmas), *mean.shape)))
    return mean + z @ np.swapaxes(np.linalg.cholesky(sigmas), 1, 2)


def draw_mniw(post: NiwPosterior, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    sigmas = draw_iw(post.scale, post.shape, n, rng)
    return draw_mn(post.coef, post.prec, sigmas, rng), sigmas


DRAWS = "chain int, iteration int, param string, idx int, value double"
BLOCK_DRAWS = 1_000


def draws_frame(chain: int, first: int, values: dict[str, np.ndarray]) -> pd.DataFrame:
    """Long form of draws: ``values`` holds one row for each iteration from ``first`` on."""
    parts = []
    for name, v in values.items():
        v = v.reshape(len(v), -1)
        n, k = v.shape
        parts.append(pd.DataFrame({"chain": np.int32(chain), "iteration": np.repeat(np.arange(first, first + n, dtype=np.int32), k), "param": name, "idx": np.tile(np.arange(1, k + 1, dtype=np.int32), n), "value": v.ravel()}))
    return pd.concat(parts, ignore_index=True)


def sample_posterior(post: NiwPosterior, spark: SparkSession, n_iter: int = 1000, seed: int = 1) -> DataFrame:
    """Draws of the coefficients (alpha) and the covariance (sigma), in blocks whose seeds depend on the block only."""
    blocks = max(1, -(-n_iter // BLOCK_DRAWS))

    def run(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                n = min(BLOCK_DRAWS, n_iter - b * BLOCK_DRAWS)
                a, s = draw_mniw(post, n, np.random.default_rng([seed, b]))
                yield draws_frame(1, b * BLOCK_DRAWS + 1, {"alpha": np.swapaxes(a, 1, 2), "sigma": s})

    return spark.range(0, blocks, 1, blocks).mapInPandas(run, DRAWS)


SPILLOVERS = "chain int, iteration int, t long, series string, shock string, spillover double"


def spillover_draws(post: NiwPosterior, spark: SparkSession, step: int = 10, n_iter: int = 1000, seed: int = 1) -> DataFrame:
    """chain, iteration, t (-1), series, shock, spillover of each draw of a conjugate posterior, in blocks of draws."""
    from vectide.operators.structure import connectedness

    blocks, names, lags = max(1, -(-n_iter // BLOCK_DRAWS)), post.names, post.lags
    m, to_lags = len(names), lags.transform(len(names)).T

    def run(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                n = min(BLOCK_DRAWS, n_iter - b * BLOCK_DRAWS)
                a, s = draw_mniw(post, n, np.random.default_rng([seed, b]))
                tables = np.array([connectedness(to_lags @ x, y, lags.order, step) for x, y in zip(a, s, strict=True)])
                first = np.repeat(np.arange(b * BLOCK_DRAWS + 1, b * BLOCK_DRAWS + n + 1, dtype=np.int32), m * m)
                yield pd.DataFrame({"chain": np.int32(1), "iteration": first, "t": np.int64(-1), "series": list(np.repeat(names, m)) * n, "shock": list(names) * (m * n), "spillover": tables.ravel()})

    return spark.range(0, blocks, 1, blocks).mapInPandas(run, SPILLOVERS)


def hierarchical_minnesota(sf: SeriesFrame, p: int = 1, spec: MinnesotaSpec | None = None, chains: int = 2, n_iter: int = 500, burn: int = 100, seed: int = 1, include_mean: bool = True, lam_prior: tuple[float, float] | None = None, psi_prior: tuple[float, float] = (0.0004, 0.0004), step: float = 0.1, har: tuple[int, int] | None = None) -> DataFrame:
    """Draws of the shrinkage (lambda), the scales (psi), coefficients and covariance: a Metropolis step on the marginal
    likelihood's (log lambda, log psi), then a conjugate draw. One task for each chain, which gets sums only. ``har`` makes
    it a VHAR, with long memory if the spec has weekly and monthly means."""
    from vectide.functions.special import gamma_from_mode
    from vectide.operators.criteria import log_ml
    from vectide.operators.tuning import minimise, numeric_hessian

    spec, lags = spec or MinnesotaSpec(), Lags(p, har, include_mean)
    sigma = np.asarray(spec.sigma, dtype=float) if spec.sigma is not None else sample_sd(sf)
    g, names, dim = data_gram(sf, lags), sf.names, sf.dim
    shape, rate = lam_prior or gamma_from_mode(0.2, 0.4)

    def target(z):
        lam, psi = math.exp(z[0]), np.exp(z[1:])
        post = posterior(names, lags, g, dummies_of(spec, lags, np.sqrt(psi), lam))
        prior = shape * z[0] - rate * lam + float((-psi_prior[0] * z[1:] - psi_prior[1] / psi).sum())
        return log_ml(post) + prior, post

    start = np.r_[math.log(spec.lam), 2 * np.log(sigma)]
    low, high = np.r_[math.log(1e-3), start[1:] - 4], np.r_[math.log(10.0), start[1:] + 4]
    mode = minimise(lambda z: -target(z)[0], start, low, high)
    h = numeric_hessian(lambda z: -target(z)[0], mode)
    w, v = np.linalg.eigh((h + h.T) / 2)
    root = v / np.sqrt(np.maximum(w, 1e-2)) * math.sqrt(step)

    def run(batches):
        for pdf in batches:
            for c in pdf["id"].tolist():
                rng = np.random.default_rng([seed, c])
                z = mode + root @ rng.standard_normal(dim + 1)
                now, post = target(z)
                lam, psi, alpha, cov = [], [], [], []
                for i in range(n_iter):
                    new = z + root @ rng.standard_normal(dim + 1)
                    then, other = target(new)
                    if math.log(rng.random()) < then - now:
                        z, now, post = new, then, other
                    if i >= burn:
                        a, s = draw_mniw(post, 1, rng)
                        lam.append(math.exp(z[0]))
                        psi.append(np.exp(z[1:]))
                        alpha.append(a[0].T)
                        cov.append(s[0])
                yield draws_frame(c + 1, 1, {"lambda": np.array(lam), "psi": np.array(psi), "alpha": np.array(alpha), "sigma": np.array(cov)})

    return sf.df.sparkSession.range(0, chains, 1, chains).mapInPandas(run, DRAWS)
