"""Each prior's step must leave its prior alone: coefficients and scales drawn from the prior keep their law when scales are
drawn given coefficients and coefficients given scales, in turns."""

import numpy as np
import pytest

from vectide.functions.design import Lags
from vectide.operators import gibbs, priors

TIMES, SWEEPS = 2_000, {"gdp": 12}


def inv_gamma(rng, shape, scale, size=None):
    return scale / rng.gamma(shape, 1.0, size)


def half_cauchy_sq(rng, size=None):
    return rng.standard_cauchy(size) ** 2


def laplace_prec(rng, rate):
    """Precisions of normals that are Laplace with ``rate`` when the precision is forgotten."""
    return 1 / rng.exponential(2 / rate**2)


def minnesota(p, rng):
    return p.prec, np.ones(p.n_impact)


def hier_minnesota(p, rng):
    p.lam, p.nu, p.contem = rng.gamma(3.0, 1 / 3.0), rng.choice(p.grid), rng.gamma(3.0, 1 / 3.0)
    return p.base / np.where(p.cross, p.lam * p.nu, p.lam), np.full(p.n_impact, 1 / p.contem)


def ssvs(p, rng):
    s1, s2 = (np.array([s[0] if g in p.own else s[1] for g in p.labels]) for s in (p.spec.s1, p.spec.s2))
    p.weight, p.a_weight = rng.beta(s1, s2), rng.beta(p.spec.impact_s1, p.spec.impact_s2)
    p.gamma, p.a_gamma = (rng.random(p.shape) < p.weight[p.of]).astype(float), (rng.random(p.n_impact) < p.a_weight).astype(float)
    p.slab, p.a_slab = inv_gamma(rng, 3.0, 3.0, p.shape), inv_gamma(rng, 3.0, 3.0, p.n_impact)
    p.kappa, p.a_kappa = rng.choice(p.grid), rng.choice(p.grid)
    return 1 / (p.slab * np.where(p.gamma > 0, 1.0, p.kappa)), 1 / (p.a_slab * np.where(p.a_gamma > 0, 1.0, p.a_kappa))


def horseshoe(p, rng):
    p.local, p.group, p.tau = half_cauchy_sq(rng, p.shape), half_cauchy_sq(rng, len(p.labels)), half_cauchy_sq(rng)
    p.a_local, p.a_tau = half_cauchy_sq(rng, p.n_impact), half_cauchy_sq(rng)
    return 1 / (p.tau * p.group[p.of] * p.local), 1 / (p.a_tau * p.a_local)


def normal_gamma(p, rng):
    p.shapes, p.a_shape = rng.exponential(size=len(p.labels)), rng.exponential()
    p.group, p.tau, p.a_tau = inv_gamma(rng, 3.0, 3.0, len(p.labels)), inv_gamma(rng, 3.0, 3.0), inv_gamma(rng, 3.0, 3.0)
    p.local = np.maximum(rng.gamma(p.shapes[p.of]) / p.shapes[p.of] * p.group[p.of] * p.tau, 1e-12)
    p.a_local = np.maximum(rng.gamma(p.a_shape, size=p.n_impact) / p.a_shape * p.a_tau, 1e-12)
    return 1 / p.local, 1 / p.a_local


def dirichlet_laplace(p, rng):
    n = p.groups.size
    p.conc, p.a_conc = rng.choice(p.grid), rng.choice(p.grid)
    p.phi, p.a_phi = (np.maximum(rng.dirichlet(np.full(k, c)), 1e-12) for k, c in ((n, p.conc), (p.n_impact, p.a_conc)))
    p.phi = p.phi.reshape(p.shape)
    p.tau, p.a_tau, p.group = rng.gamma(n * p.conc, 2.0), rng.gamma(p.n_impact * p.a_conc, 2.0), inv_gamma(rng, 3.0, 3.0, len(p.labels))
    return laplace_prec(rng, 1 / (p.tau * p.phi * p.group[p.of])), laplace_prec(rng, 1 / (p.a_tau * p.a_phi))


def gdp(p, rng):
    p.shape_hyper, p.rate_hyper, p.a_shape, p.a_rate_hyper = (1 - (u := rng.choice(p.grid, 4))) / u
    p.rate = rng.gamma(p.shape_hyper, 1 / p.rate_hyper, len(p.labels))
    return laplace_prec(rng, p.rate[p.of]), laplace_prec(rng, rng.gamma(p.a_shape, 1 / p.a_rate_hyper, p.n_impact))


CASES = {
    "minnesota": (priors.Minnesota(), minnesota),
    "hier_minnesota": (priors.HierMinnesota(shape=3.0, rate=3.0, grid=10), hier_minnesota),
    "ssvs": (priors.Ssvs(slab_shape=3.0, slab_scale=3.0, s1=(2.0, 1.0), s2=(1.0, 3.0), grid=10), ssvs),
    "horseshoe": (priors.Horseshoe(), horseshoe),
    "normal_gamma": (priors.NormalGamma(shape_sd=0.7, group_shape=3.0, group_scale=3.0, global_shape=3.0, global_scale=3.0, impact_shape_sd=0.7), normal_gamma),
    "dirichlet_laplace": (priors.DirichletLaplace(grid=20, shape=3.0, scale=3.0), dirichlet_laplace),
    "gdp": (priors.Gdp(grid=20), gdp),
}


def sizes_before_and_after(name, rng):
    """Log sizes of three coefficients (two cross, one own), two impacts and both sums, of independent prior draws and after
    the sweeps."""
    spec, from_prior = CASES[name]
    p = gibbs.SAMPLERS[type(spec)](spec, Lags(1), np.ones(3), rng)
    if name == "dirichlet_laplace":  # lower concentrations reach the floors of variances and shares
        p.grid = p.grid[p.grid > 0.25]
    if name == "gdp":  # lower shapes reach the floors of rates and precisions
        p.grid = p.grid[p.grid < 0.75]

    def normals(mean, prec):
        return mean + rng.standard_normal(np.shape(prec)) / np.sqrt(np.maximum(prec, 1e-30))

    def seen(alpha, a):
        x, y = np.log(np.abs(alpha) + 1e-8), np.log(np.abs(a) + 1e-8)
        return x[0, 1], x[2, 0], x[1, 1], y[0], y[2], x.sum(), y.sum()

    out = np.empty((2, TIMES, 7))
    for i in range(TIMES):
        prec, a_prec = from_prior(p, rng)
        alpha, a = normals(p.mean, prec), normals(0.0, a_prec)
        out[0, i] = seen(alpha, a)
        for _ in range(SWEEPS.get(name, 5)):
            alpha, a = normals(p.mean, p.coef_prec(alpha, rng)), normals(0.0, p.impact_prec(a, rng))
        out[1, i] = seen(alpha, a)
    return out


@pytest.mark.parametrize("name", list(priors.PRIORS))
def test_steps_leave_the_prior_alone(name):
    before, after = sizes_before_and_after(name, np.random.default_rng(11))
    for q in (0.1, 0.25, 0.5, 0.75, 0.9):
        at = np.quantile(np.concatenate([before, after]), q, axis=0)
        gap = (after < at).astype(float) - (before < at)
        z = gap.mean(axis=0) / np.maximum(gap.std(axis=0), 1e-9) * np.sqrt(TIMES)
        assert np.abs(z).max() < 4.5, (q, z.round(1))
