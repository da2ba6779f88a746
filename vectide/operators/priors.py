"""Prior specifications: small, frozen and checked, so that they travel to executors as they are."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import numpy as np


def _positive(**values) -> None:
    for name, v in values.items():
        if v is not None and (np.asarray(v, dtype=float) <= 0).any():
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class MinnesotaSpec:
    """``sigma``: scales of the series (None: sample standard deviations); ``lam``: tightness; ``delta``: prior means of own
    first lags (of day parts); ``weekly`` and ``monthly``: of the other parts of a HAR model."""

    sigma: tuple[float, ...] | None = None
    lam: float = 0.1
    delta: float | tuple[float, ...] = 1.0
    eps: float = 1e-4
    weekly: float | tuple[float, ...] | None = None
    monthly: float | tuple[float, ...] | None = None

    def __post_init__(self):
        _positive(sigma=self.sigma, lam=self.lam, eps=self.eps)
        if (self.weekly is None) != (self.monthly is None):
            raise ValueError("weekly and monthly means come together")
        if self.sigma is not None and not isinstance(self.delta, (int, float)) and len(self.delta) != len(self.sigma):
            raise ValueError("delta has a mean for each scale of sigma")


@dataclass(frozen=True)
class Shrinkage:
    """Common fields of the priors of the Gibbs sampler: ``groups`` (longrun, short or no) and whether the global level is
    sampled (``ggl``)."""

    groups: str = "longrun"
    ggl: bool = True

    def __post_init__(self):
        """Numbers are positive, but for prior means; pairs are two; grids hold two points or more."""
        if self.groups not in ("longrun", "short", "no"):
            raise ValueError(f"unknown groups {self.groups}")
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "grid" and (not isinstance(v, int) or v < 2):
                raise ValueError("grid must be 2 or more")
            if f.name in ("s1", "s2") and len(v) != 2:
                raise ValueError(f"{f.name} has a weight for own and one for cross lags")
            if f.name not in ("groups", "ggl", "delta"):
                _positive(**{f.name: v})


@dataclass(frozen=True)
class Minnesota(Shrinkage):
    lam: float = 0.1
    delta: float = 0.0
    eps: float = 1e-4


@dataclass(frozen=True)
class HierMinnesota(Shrinkage):
    shape: float = 0.01
    rate: float = 0.01
    delta: float = 0.0
    eps: float = 1e-4
    grid: int = 100


@dataclass(frozen=True)
class Ssvs(Shrinkage):
    slab_shape: float = 0.01
    slab_scale: float = 0.01
    s1: tuple[float, float] = (1.0, 1.0)  # own and cross weights of inclusion
    s2: tuple[float, float] = (1.0, 1.0)
    impact_s1: float = 1.0
    impact_s2: float = 1.0
    grid: int = 100


@dataclass(frozen=True)
class Horseshoe(Shrinkage):
    pass


@dataclass(frozen=True)
class NormalGamma(Shrinkage):
    shape_sd: float = 0.01
    group_shape: float = 0.01
    group_scale: float = 0.01
    global_shape: float = 0.01
    global_scale: float = 0.01
    impact_shape_sd: float = 0.01


@dataclass(frozen=True)
class DirichletLaplace(Shrinkage):
    grid: int = 100
    shape: float = 0.01
    scale: float = 0.01


@dataclass(frozen=True)
class Gdp(Shrinkage):
    grid: int = 100
    group_shape: float = 0.01
    group_rate: float = 0.01


PRIORS = {"minnesota": Minnesota, "hier_minnesota": HierMinnesota, "ssvs": Ssvs, "horseshoe": Horseshoe, "normal_gamma": NormalGamma, "dirichlet_laplace": DirichletLaplace, "gdp": Gdp}


@dataclass(frozen=True)
class Ldlt:
    """Homoskedastic variances, inverse gamma."""

    shape: float = 3.0
    scale: float = 0.01

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)


@dataclass(frozen=True)
class StochasticVolatility:
    """Log variances walk randomly; the walk's variance is inverse gamma, its start normal."""

    shape: float = 3.0
    scale: float = 0.01
    initial_mean: float = 1.0
    initial_prec: float = 0.1

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale, initial_prec=self.initial_prec)


@dataclass(frozen=True)
class Intercept:
    mean: float = 0.0
    sd: float = 0.1

    def __post_init__(self):
        _positive(sd=self.sd)


@dataclass(frozen=True)
class BayesSpec:
    prior: Shrinkage = field(default_factory=Horseshoe)
    cov: Ldlt | StochasticVolatility = field(default_factory=Ldlt)
    intercept: Intercept = field(default_factory=Intercept)
    #: Prior precision scale of the impact matrix where the prior has no rule for it.
    chains: int = 2
    n_iter: int = 1_000
    burn: int = 500
    thin: int = 1
    seed: int = 1

    def __post_init__(self):
        if not 0 <= self.burn < self.n_iter or self.thin < 1 or self.chains < 1:
            raise ValueError("0 <= burn < n_iter, thin >= 1 and chains >= 1 are needed")
