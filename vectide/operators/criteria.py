"""Likelihoods and information criteria; all need the small matrices of a fit only."""

from __future__ import annotations

import math

import numpy as np

from vectide.functions.special import log_mv_gamma
from vectide.operators.ols import OlsModel


def _logdet(a: np.ndarray) -> float:
    return float(np.linalg.slogdet(a)[1])


def log_lik(model) -> float:
    """Gaussian log likelihood at the coefficients, with the maximum likelihood covariance (for conjugate posteriors, the
    mean of the inverse Wishart)."""
    n, m = model.n, model.dim
    if isinstance(model, OlsModel):
        sigma = model.sigma * (n - model.k) / n
        rss = model.rss
    else:
        sigma, rss = model.sigma, model.rss
    return -n * m / 2 * math.log(2 * math.pi) - n / 2 * _logdet(sigma) - 0.5 * float(np.trace(np.linalg.solve(sigma, rss)))


def n_params(model) -> int:
    return model.k * model.dim + model.dim**2


def aic(model) -> float:
    return -2 * log_lik(model) + 2 * n_params(model)


def bic(model) -> float:
    return -2 * log_lik(model) + math.log(model.n) * n_params(model)


def hq(model) -> float:
    return -2 * log_lik(model) + 2 * math.log(math.log(model.n)) * n_params(model)


def rss_criteria(model: OlsModel) -> dict[str, float]:
    """AIC, BIC, HQ and FPE on the log determinant of the maximum likelihood covariance."""
    n, m, k = model.n, model.dim, model.k
    log_det, mk = _logdet(model.sigma * (n - k) / n), m * k
    return {
        "AIC": log_det + 2 / n * mk,
        "BIC": log_det + math.log(n) / n * mk,
        "HQ": log_det + 2 * math.log(math.log(n)) / n * mk,
        "FPE": ((n + k) / n) ** m * float(np.linalg.det(model.sigma)),
    }


def log_ml(post) -> float:
    """Log marginal likelihood of a conjugate posterior, by log1p of eigenvalues, so that no determinant overflows."""
    m, n, s0 = post.dim, post.n, post.prior_shape
    const = -m * n / 2 * math.log(math.pi) + log_mv_gamma((s0 + n) / 2, m) - log_mv_gamma(s0 / 2, m)

    def gain(base, more):  # log det(I + base^-1 more)
        c = np.linalg.cholesky((base + base.T) / 2)
        z = np.linalg.solve(c, np.linalg.solve(c, more).T)
        return float(np.log1p(np.maximum(np.linalg.eigvalsh((z + z.T) / 2), -1 + 1e-15)).sum())

    a = gain(post.prior_prec, post.data_gram.xx)
    b = gain(post.prior_scale, post.scale - post.prior_scale)
    return const - m / 2 * a - n / 2 * _logdet(post.prior_scale) - (s0 + n) / 2 * b


def _deviance(post, b: np.ndarray, s: np.ndarray) -> float:
    g = post.data_gram
    rss = g.yy - b.T @ g.xy - g.xy.T @ b + b.T @ g.xx @ b
    return post.n * post.dim * math.log(2 * math.pi) + post.n * _logdet(s) + float(np.trace(np.linalg.solve(s, rss)))


def deviance_at_mean(post) -> float:
    """Minus twice the log likelihood at the posterior means of coefficients and covariance."""
    return _deviance(post, post.coef, post.sigma)


def dic(post, n_iter: int = 100, seed: int = 1) -> float:
    """Deviance information criterion of a conjugate posterior: twice the mean deviance less the deviance at the means."""
    from vectide.operators.niw import draw_mniw

    coefs, sigmas = draw_mniw(post, n_iter, np.random.default_rng(seed))
    mean = float(np.mean([_deviance(post, b, s) for b, s in zip(coefs, sigmas, strict=True)]))
    return 2 * mean - _deviance(post, coefs.mean(axis=0), sigmas.mean(axis=0))
