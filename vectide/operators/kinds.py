"""What a value of this library is: predicates over models, fits, specifications and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vectide.operators.mcmc import BayesFit
from vectide.operators.niw import NiwPosterior
from vectide.operators.ols import OlsModel
from vectide.operators.priors import BayesSpec, Intercept, Ldlt, MinnesotaSpec, Shrinkage, StochasticVolatility
from vectide.operators.tuning import Bounds

FORECAST, IMPULSE, BACKTEST, SPILLOVER = {"h", "series", "forecast"}, {"impulse", "period", "response", "value"}, {"window", "t", "series", "forecast"}, {"series", "shock", "spillover"}


def is_var(x) -> bool:
    """A fitted model whose regressors are plain lags."""
    return hasattr(x, "lags") and x.lags.har is None


def is_vhar(x) -> bool:
    return hasattr(x, "lags") and x.lags.har is not None


def is_ols(x) -> bool:
    return isinstance(x, OlsModel)


def is_conjugate(x) -> bool:
    return isinstance(x, NiwPosterior)


def is_flat(x) -> bool:
    """A conjugate posterior whose prior has no rows: a precision alone."""
    return isinstance(x, NiwPosterior) and x.prior_shape == 0


def is_minnesota(x) -> bool:
    return isinstance(x, NiwPosterior) and not is_flat(x)


def is_sampled(x) -> bool:
    return isinstance(x, BayesFit)


def is_volatile(x) -> bool:
    """A sampled fit, or a specification, with stochastic volatility."""
    return isinstance(getattr(getattr(x, "spec", x), "cov", x), StochasticVolatility)


def is_prior(x, kind: type[Shrinkage] = Shrinkage) -> bool:
    """A prior of the Gibbs sampler, or one ``kind`` of them."""
    return isinstance(x, kind)


def is_spec(x) -> bool:
    return isinstance(x, (BayesSpec, MinnesotaSpec, Shrinkage, Ldlt, StochasticVolatility, Intercept))


def is_covariance(x) -> bool:
    return isinstance(x, (Ldlt, StochasticVolatility))


def is_intercept(x) -> bool:
    return isinstance(x, Intercept)


def is_bounds(x) -> bool:
    return isinstance(x, Bounds)


def _holds(x, columns: set[str]) -> bool:
    return isinstance(x, DataFrame) and columns <= set(x.columns)


def is_forecast(x) -> bool:
    return _holds(x, FORECAST)


def is_impulse(x) -> bool:
    return _holds(x, IMPULSE)


def is_backtest(x) -> bool:
    return _holds(x, BACKTEST)


def is_spillover(x) -> bool:
    return _holds(x, SPILLOVER)
