"""Gibbs sampler of autoregressions in triangular form: y_t = A' x_t + e_t, L e_t = v_t, v_t ~ N(0, D_t).

Coefficients are drawn equation by equation given all others. The data enter through cross products of regressors and
responses, weighted by the inverse variances of each series: with constant variances these are the moments of the design,
however many rows they sum up, and no step needs a row. Log variances come from a tridiagonal precision, in time
proportional to the number of rows.

A prior is a subclass of :class:`Prior` with ``coef_prec``, ``impact_prec`` and ``records``; :func:`register` names it for its
spec and lets it travel to executors by value.
"""

from __future__ import annotations

import sys

import numpy as np

from vectide.functions.design import Lags, group_matrix, minnesota_dummies, own_groups
from vectide.functions.special import log_gamma
from vectide.operators import priors
from vectide.operators.moments import Moments, Weighted
from vectide.operators.rng import from_grid, gig, inner_grid, inverse_gamma, inverse_gaussian

# The seven normals of Kim, Shephard and Chib (1998) for the log of a chi-square variable.
MIX_PROB = np.array([0.00730, 0.10556, 0.00002, 0.04395, 0.34001, 0.24566, 0.25750])
MIX_MEAN = np.array([-10.12999, -3.97281, -8.56686, 2.77786, 0.61942, 1.79518, -1.08819]) - 1.2704
MIX_VAR = np.array([5.79596, 2.61369, 5.17950, 0.16735, 0.64009, 0.34023, 1.26261])

FLOOR, CEILING = 1e-12, 1e12


def _clip(x):
    return np.clip(x, FLOOR, CEILING)


class Prior:
    """Protocol of priors, and what they share: ``groups`` is the group label of each coefficient (K x m), ``mean`` the prior
    mean, ``n_impact`` the number of impacts. ``coef_prec`` and ``impact_prec`` draw the prior's own values given coefficients
    and impacts, and return prior precisions; ``records`` names what a kept draw keeps of them. ``centred``: coefficients come
    less their prior mean."""

    centred = False

    def __init__(self, spec, lags: Lags, sigma: np.ndarray, rng: np.random.Generator):
        m = len(sigma)
        parts = 3 if lags.har else lags.p
        self.spec, self.sigma, self.parts, self.m = spec, np.asarray(sigma, dtype=float), parts, m
        self.groups = group_matrix(parts, m, spec.groups)
        self.labels = np.unique(self.groups)
        self.own = own_groups(parts, m, spec.groups)
        self.shape, self.n_impact = (parts * m, m), m * (m - 1) // 2
        self.mean = np.zeros(self.shape)
        self.of = np.searchsorted(self.labels, self.groups)
        self.size = np.bincount(self.of.ravel(), minlength=len(self.labels))

    def by_group(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of.ravel(), weights=x.ravel(), minlength=len(self.labels))

    def coef_prec(self, alpha: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def impact_prec(self, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return np.ones(self.n_impact)

    def records(self) -> dict[str, np.ndarray]:
        return {}

    def _minnesota(self, lam: float, delta: float, eps: float) -> np.ndarray:
        y, x = minnesota_dummies(self.sigma, self.parts, lam, np.full(self.m, delta), eps, False)
        prec = x.T @ x
        self.mean = np.linalg.solve(prec, x.T @ y)
        return np.diag(prec)[:, None] / self.sigma[None] ** 2


class MinnesotaPrior(Prior):
    centred = True

    def __init__(self, *args):
        super().__init__(*args)
        self.prec = self._minnesota(self.spec.lam, self.spec.delta, self.spec.eps)

    def coef_prec(self, alpha, rng):
        return self.prec


class HierMinnesotaPrior(Prior):
    """Shrinkage of all coefficients, and a further one of the cross lags, are sampled."""

    def __init__(self, *args):
        super().__init__(*args)
        self.base = self._minnesota(1.0, self.spec.delta, self.spec.eps)
        self.cross = ~np.isin(self.groups, list(self.own))
        self.grid, self.lam, self.nu, self.contem = inner_grid(self.spec.grid), 0.1, 0.5, 0.1

    def coef_prec(self, alpha, rng):
        k = (alpha - self.mean) ** 2 * self.base
        scaled = np.where(self.cross, k / self.nu, k).sum()
        self.lam = float(_clip(gig(self.spec.shape - alpha.size / 2, 2 * self.spec.rate, scaled, rng)))
        if self.cross.any():
            n, s = self.cross.sum(), k[self.cross].sum() / self.lam
            self.nu = from_grid(self.grid, -n / 2 * np.log(self.grid) - s / (2 * self.grid), rng)
        return self.base / np.where(self.cross, self.lam * self.nu, self.lam)

    def impact_prec(self, a, rng):
        if len(a):
            self.contem = float(_clip(gig(self.spec.shape - len(a) / 2, 2 * self.spec.rate, (a**2).sum(), rng)))
        return np.full(self.n_impact, 1 / self.contem)

    def records(self):
        return {"lambda": np.array([self.lam]), "nu": np.array([self.nu])}


class SsvsPrior(Prior):
    """Spike and slab: the spike's variance is the slab's times kappa."""

    def __init__(self, *args):
        super().__init__(*args)
        rng = args[3]
        self.gamma, self.slab = (rng.random(self.shape) < 0.5).astype(float), np.ones(self.shape)
        self.weight = np.full(len(self.labels), 0.5)
        self.a_gamma, self.a_slab, self.a_weight = np.ones(self.n_impact), np.ones(self.n_impact), 0.5
        self.grid, self.kappa, self.a_kappa = inner_grid(self.spec.grid), 0.01, 0.01

    def _draw(self, x, gamma, slab, kappa, weight, rng):
        """One sweep over scales and indicators of coefficients ``x``; returns gamma, slab and kappa."""
        var = np.where(gamma > 0, 1.0, kappa)
        slab = _clip(inverse_gamma(self.spec.slab_shape + 0.5, self.spec.slab_scale + x**2 / (2 * var), rng))
        out = gamma == 0
        s = (x[out] ** 2 / slab[out]).sum()
        kappa = from_grid(self.grid, -out.sum() / 2 * np.log(self.grid) - s / (2 * self.grid), rng)
        log_in = np.log(_clip(weight)) - 0.5 * x**2 / slab
        log_out = np.log(_clip(1 - weight)) - 0.5 * np.log(kappa) - 0.5 * x**2 / (slab * kappa)
        p = 1 / (1 + np.exp(np.clip(log_out - log_in, -700, 700)))
        return (rng.random(x.shape) < p).astype(float), slab, kappa

    def coef_prec(self, alpha, rng):
        self.gamma, self.slab, self.kappa = self._draw(alpha, self.gamma, self.slab, self.kappa, self.weight[self.of], rng)
        n_in = self.by_group(self.gamma)
        s1, s2 = (np.array([s[0] if g in self.own else s[1] for g in self.labels]) for s in (self.spec.s1, self.spec.s2))
        self.weight = np.clip(rng.beta(s1 + n_in, s2 + self.size - n_in), 1e-6, 1 - 1e-6)
        return 1 / _clip(self.slab * np.where(self.gamma > 0, 1.0, self.kappa))

    def impact_prec(self, a, rng):
        if not len(a):
            return np.ones(0)
        self.a_gamma, self.a_slab, self.a_kappa = self._draw(a, self.a_gamma, self.a_slab, self.a_kappa, np.full(len(a), self.a_weight), rng)
        self.a_weight = float(np.clip(rng.beta(self.spec.impact_s1 + self.a_gamma.sum(), self.spec.impact_s2 + (1 - self.a_gamma).sum()), 1e-6, 1 - 1e-6))
        return 1 / _clip(self.a_slab * np.where(self.a_gamma > 0, 1.0, self.a_kappa))

    def records(self):
        return {"gamma": self.gamma.T}


class HorseshoePrior(Prior):
    """Half-Cauchy scales on three levels: global, group and local, each with an auxiliary inverse gamma."""

    def __init__(self, *args):
        super().__init__(*args)
        self.local, self.group, self.tau = np.ones(self.shape), np.ones(len(self.labels)), 1.0
        self.a_local, self.a_tau = np.ones(self.n_impact), 1.0

    def coef_prec(self, alpha, rng):
        sq = alpha**2
        nu = inverse_gamma(1.0, 1 + 1 / self.local, rng)
        self.local = _clip(inverse_gamma(np.ones(self.shape), 1 / nu + sq / (2 * self.tau * self.group[self.of]), rng))
        zeta = inverse_gamma(1.0, 1 + 1 / self.group, rng)
        self.group = _clip(inverse_gamma((self.size + 1) / 2, 1 / zeta + self.by_group(sq / (2 * self.tau * self.local)), rng))
        if self.spec.ggl:
            xi = float(inverse_gamma(1.0, 1 + 1 / self.tau, rng))
            self.tau = float(_clip(inverse_gamma((alpha.size + 1) / 2, 1 / xi + (sq / (2 * self.local * self.group[self.of])).sum(), rng)))
        self.prec = 1 / _clip(self.tau * self.group[self.of] * self.local)
        return self.prec

    def impact_prec(self, a, rng):
        if not len(a):
            return np.ones(0)
        nu = inverse_gamma(1.0, 1 + 1 / self.a_local, rng)
        self.a_local = _clip(inverse_gamma(np.ones(len(a)), 1 / nu + a**2 / (2 * self.a_tau), rng))
        xi = float(inverse_gamma(1.0, 1 + 1 / self.a_tau, rng))
        self.a_tau = float(_clip(inverse_gamma((len(a) + 1) / 2, 1 / xi + (a**2 / (2 * self.a_local)).sum(), rng)))
        return 1 / _clip(self.a_tau * self.a_local)

    def records(self):
        return {"lambda": np.sqrt(self.local).T, "eta": np.sqrt(self.group), "tau": np.array([np.sqrt(self.tau)]), "kappa": (1 / (1 + self.prec)).T}


class NormalGammaPrior(Prior):
    """Local variances are gamma with a sampled shape for each group."""

    def __init__(self, *args):
        super().__init__(*args)
        self.local, self.group, self.tau = np.ones(self.shape), np.ones(len(self.labels)), 1.0
        self.shapes = np.ones(len(self.labels))
        self.a_local, self.a_tau, self.a_shape = np.ones(self.n_impact), 1.0, 1.0

    @staticmethod
    def _jump(shape, n, sum_log, total, sd, rng):
        """Metropolis step on log shape of n gamma(shape, shape) variables with these sums, exponential(1) prior."""
        from math import lgamma, log

        def target(s):
            return n * (s * log(s) - lgamma(s)) + (s - 1) * sum_log - s * total - s + log(s)

        new = float(np.clip(shape * np.exp(sd * rng.standard_normal()), 1e-3, 1e3))
        return new if log(max(rng.random(), 1e-300)) < target(new) - target(shape) else shape

    def coef_prec(self, alpha, rng):
        of, scale = self.of, self.group[self.of] * self.tau
        rel = _clip(self.local / scale)
        logs, sums = self.by_group(np.log(rel)), self.by_group(rel)
        self.shapes = np.array([self._jump(s, n, l, t, self.spec.shape_sd, rng) for s, n, l, t in zip(self.shapes, self.size, logs, sums, strict=True)])
        shapes = self.shapes[of]
        self.group = _clip(inverse_gamma(self.spec.group_shape + self.size * self.shapes, self.spec.group_scale + self.shapes * self.by_group(self.local / self.tau), rng))
        if self.spec.ggl:
            self.tau = float(_clip(inverse_gamma(self.spec.global_shape + (self.size * self.shapes).sum(), self.spec.global_scale + (shapes * self.local / self.group[of]).sum(), rng)))
        self.local = _clip(gig(shapes - 0.5, 2 * shapes / (self.group[of] * self.tau), alpha**2, rng))
        return 1 / self.local

    def impact_prec(self, a, rng):
        if not len(a):
            return np.ones(0)
        rel = _clip(self.a_local / self.a_tau)
        self.a_shape = self._jump(self.a_shape, len(a), float(np.log(rel).sum()), float(rel.sum()), self.spec.impact_shape_sd, rng)
        self.a_tau = float(_clip(inverse_gamma(self.spec.global_shape + len(a) * self.a_shape, self.spec.global_scale + self.a_shape * self.a_local.sum(), rng)))
        self.a_local = _clip(gig(self.a_shape - 0.5, 2 * self.a_shape / self.a_tau, a**2, rng))
        return 1 / self.a_local

    def records(self):
        return {"lambda": np.sqrt(self.local).T, "eta": np.sqrt(self.group), "tau": np.array([np.sqrt(self.tau)])}


class DirichletLaplacePrior(Prior):
    """Laplace scales that share a Dirichlet budget, with a scale for each group."""

    def __init__(self, *args):
        super().__init__(*args)
        n = int(np.prod(self.shape))
        self.phi, self.tau, self.group, self.conc = np.full(self.shape, 1 / n), 1.0, np.ones(len(self.labels)), 0.5
        self.grid = inner_grid(self.spec.grid) / 2
        self.a_phi, self.a_tau, self.a_conc = np.full(self.n_impact, 1 / max(1, self.n_impact)), 1.0, 0.5

    def _conc(self, phi, tau, rng):
        # the Dirichlet's log_gamma(n * conc) is also in the gamma law of tau and cancels
        n, logs = phi.size, np.log(np.maximum(phi, 1e-300)).sum()
        return from_grid(self.grid, self.grid * (logs + n * np.log(tau / 2)) - n * log_gamma(self.grid), rng)

    def coef_prec(self, alpha, rng):
        size = np.abs(alpha) + 1e-100
        eta = self.group[self.of]
        self.conc = self._conc(self.phi, self.tau, rng)
        self.group = _clip(inverse_gamma(self.spec.shape + self.size, self.spec.scale + self.by_group(size / (self.tau * self.phi)), rng))
        eta = self.group[self.of]
        raw = gig(self.conc - 1, 1.0, 2 * size / eta, rng)
        self.phi = np.maximum(raw / raw.sum(), 1e-12)
        if self.spec.ggl:
            self.tau = float(_clip(gig(alpha.size * (self.conc - 1), 1.0, 2 * (size / (self.phi * eta)).sum(), rng)))
        scale = self.tau * self.phi * eta
        psi = 1 / inverse_gaussian(scale / size, np.ones(self.shape), rng)
        return 1 / _clip(scale**2 * psi)

    def impact_prec(self, a, rng):
        if not len(a):
            return np.ones(0)
        size = np.abs(a) + 1e-100
        self.a_conc = self._conc(self.a_phi, self.a_tau, rng)
        raw = gig(self.a_conc - 1, 1.0, 2 * size, rng)
        self.a_phi = np.maximum(raw / raw.sum(), 1e-12)
        self.a_tau = float(_clip(gig(len(a) * (self.a_conc - 1), 1.0, 2 * (size / self.a_phi).sum(), rng)))
        scale = self.a_tau * self.a_phi
        return 1 / _clip(scale**2 / inverse_gaussian(scale / size, np.ones(len(a)), rng))

    def records(self):
        return {"lambda": self.phi.T, "tau": np.array([self.tau])}


class GdpPrior(Prior):
    """Generalised double Pareto: Laplace rates, one for each group of coefficients and one for each impact, are gamma, with
    gridded shape and rate."""

    def __init__(self, *args):
        super().__init__(*args)
        self.shape_hyper, self.rate_hyper, self.a_shape, self.a_rate_hyper = 1.0, 1.0, 1.0, 1.0
        self.grid = inner_grid(self.spec.grid)
        self.rate = np.ones(len(self.labels))

    def _hyper(self, total, count, rate, rng):
        """Shape and rate of the gamma law of rates, these integrated out: each is shared by ``count`` coefficients whose
        sizes sum to ``total``."""
        x = (1 - self.grid) / self.grid
        n, s = count[None], total[None]
        grown = log_gamma(x[:, None] + n) - log_gamma(x)[:, None]
        shape = from_grid(x, (grown + x[:, None] * np.log(rate) - (x[:, None] + n) * np.log(rate + s)).sum(axis=1), rng)
        rate = from_grid(x, (shape * np.log(x)[:, None] - (shape + n) * np.log(x[:, None] + s)).sum(axis=1), rng)
        return shape, rate

    def coef_prec(self, alpha, rng):
        size = np.abs(alpha) + 1e-100
        total = self.by_group(size)
        self.shape_hyper, self.rate_hyper = self._hyper(total, self.size, self.rate_hyper, rng)
        self.rate = _clip(rng.gamma(self.shape_hyper + self.size, 1 / (self.rate_hyper + total)))
        r = self.rate[self.of]
        # local variances are exponential(r^2 / 2); their inverses given the coefficients are inverse Gaussian
        return _clip(inverse_gaussian(r / size, r**2, rng))

    def impact_prec(self, a, rng):
        if not len(a):
            return np.ones(0)
        size = np.abs(a) + 1e-100
        self.a_shape, self.a_rate_hyper = self._hyper(size, np.ones(len(a)), self.a_rate_hyper, rng)
        r = _clip(rng.gamma(self.a_shape + 1, 1 / (self.a_rate_hyper + size)))
        return _clip(inverse_gaussian(r / size, r**2, rng))


SAMPLERS = {priors.Minnesota: MinnesotaPrior, priors.HierMinnesota: HierMinnesotaPrior, priors.Ssvs: SsvsPrior, priors.Horseshoe: HorseshoePrior, priors.NormalGamma: NormalGammaPrior, priors.DirichletLaplace: DirichletLaplacePrior, priors.Gdp: GdpPrior}


def register(spec: type[priors.Shrinkage], sampler: type[Prior]) -> None:
    """Let ``sampler`` serve fits whose prior is a ``spec``. Both travel to executors by value, wherever they are defined, so no
    worker needs their module."""
    from pyspark import cloudpickle

    for kind in (spec, sampler):
        if kind.__module__ != "__main__" and not kind.__module__.startswith("vectide."):
            cloudpickle.register_pickle_by_value(sys.modules[kind.__module__])
    SAMPLERS[spec] = sampler


def sampler_of(spec: priors.Shrinkage) -> type[Prior]:
    for kind in type(spec).__mro__:
        if kind in SAMPLERS:
            return SAMPLERS[kind]
    raise ValueError(f"no sampler is registered for {type(spec).__name__}")



def draw_normal(prec: np.ndarray, rhs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """From N(prec^-1 rhs, prec^-1), by one Cholesky factor."""
    c = np.linalg.cholesky(prec)
    return np.linalg.solve(c.T, np.linalg.solve(c, rhs) + rng.standard_normal(len(rhs)))


def savs(coef: np.ndarray, norms: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Sparse version of coefficients: soft thresholds of 1 / coef^2 against the regressors' squared norms; none at ``free``."""
    size = np.abs(coef)
    penalty = np.where(free, 0.0, 1 / np.maximum(coef**2, 1e-300))
    gain = size * norms[:, None]
    return coef * np.maximum(gain - penalty, 0) / np.maximum(gain, 1e-300)


def mixture(v: np.ndarray, h: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted values (n x m) of the normals that stand for log v^2 - h, components drawn given ``h``."""
    y = np.log(v**2 + 1e-4)
    log_p = np.log(MIX_PROB) - 0.5 * np.log(MIX_VAR) - 0.5 * (y[..., None] - h[..., None] - MIX_MEAN) ** 2 / MIX_VAR
    p = np.cumsum(np.exp(log_p - log_p.max(axis=-1, keepdims=True)), axis=-1)
    s = np.minimum((p < rng.random((*v.shape, 1)) * p[..., -1:]).sum(axis=-1), 6)
    w = 1 / MIX_VAR[s]
    return w, (y - MIX_MEAN[s]) * w


def draw_log_vol(v: np.ndarray, h: np.ndarray, h0: np.ndarray, var: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Log variances (n x m) of shocks ``v`` given the old ones: mixture indicators, then a draw from a tridiagonal precision,
    by stretches of about sqrt(n) rows at once (see volatility)."""
    from vectide.operators.volatility import draw_walk

    w, r = mixture(v, h, rng)
    return draw_walk(w, r, h0, var, rng)


class Chain:
    """State of one chain. Its steps need sums of the rows only: of (regressors, responses) weighted by the inverse variances of
    each series. With constant variances these are one set of moments, whatever the weights."""

    def __init__(self, g: Moments, lags: Lags, spec: priors.BayesSpec, rng: np.random.Generator, sampler: type[Prior] | None = None):
        self.lags, self.spec, self.rng, self.g, self.n = lags, spec, rng, g, float(g.n)
        self.k = len(g.mean) - (m := len(g.mean) // (len(lags.parts) + 1))
        self.m, self.const = m, lags.include_mean
        sigma = np.sqrt(np.diag(g.core)[self.k :] / (self.n - 1))
        self.prior = (sampler or sampler_of(spec.prior))(spec.prior, lags, sigma, rng)
        self.free = np.isin(self.prior.groups, list(self.prior.own))
        rows = self.k + self.const
        self.coef, self.low = rng.uniform(-1, 1, (rows, m)) * 0.1, np.eye(m)
        self.coef[: self.k] += self.prior.mean
        self.at = np.tril_indices(m, -1)
        self.d = np.exp(rng.uniform(-1, 1, m)) * sigma**2
        self.norms = np.diag(g.core)[: self.k] + self.n * g.mean[: self.k] ** 2
        self.plain = Weighted.plain(g, self.k, self.const)
        self.plain_xx = self.plain.xx()
        self.prec, self.mean = np.empty((rows, m)), np.zeros((rows, m))
        self.sparse_impacts = np.zeros(len(self.at[0]))

    @property
    def impacts(self) -> np.ndarray:
        return self.low[self.at]

    def coefficients(self, w: Weighted | None = None) -> None:
        """Coefficients equation by equation given all others, then impacts. ``w``: sums weighted for each series; without, the
        variances are constant, and the plain sums serve all series."""
        k, m, rng, low = self.k, self.m, self.rng, self.low
        about = self.coef[:k] - self.prior.mean if self.prior.centred else self.coef[:k]
        a = self.impacts
        self.prec[:k], self.mean[:k] = self.prior.coef_prec(about, rng), self.prior.mean
        self.prec[k:], self.mean[k:] = 1 / self.spec.intercept.sd**2, self.spec.intercept.mean
        sums, inv = (self.plain, 1 / self.d) if w is None else (w, np.ones(m))
        xx = self.plain_xx if w is None else w.xx()
        for j in range(m):
            rest = self.coef.copy()
            rest[:, j] = 0.0
            xe, load = sums.cross(rest), low[j:, j] * inv[j:]
            if w is None:
                omega, rhs = (low[j:, j] @ load) * xx[0], xe[0] @ (low[j:].T @ load)
            else:
                omega, rhs = np.tensordot(low[j:, j] * load, xx[j:], 1), np.einsum("i,ikl,il->k", load, xe[j:], low[j:])
            omega.flat[:: len(omega) + 1] += self.prec[:, j]
            self.coef[:, j] = draw_normal(omega, self.prec[:, j] * self.mean[:, j] + rhs, rng)
        if m == 1:
            self.prior.impact_prec(a, rng)
            return
        ee, same = sums.products(self.coef), w is None
        a_prec = self.prior.impact_prec(a, rng)
        for j in range(1, m):
            at, e = self.at[0] == j, ee[0] * inv[j] if same else ee[j]
            low[j, :j] = draw_normal(np.diag(a_prec[at]) + e[:j, :j], -e[:j, j], rng)
        size = np.diag(ee[0] if same else self.plain.products(self.coef)[0])
        self.sparse_impacts = savs(self.impacts[:, None], size[self.at[1]], np.zeros((len(a), 1), dtype=bool))[:, 0]

    def variances(self) -> None:
        """Constant variances."""
        total = ((self.low @ self.plain.products(self.coef)[0]) * self.low).sum(axis=1)
        cov = self.spec.cov
        self.d = np.maximum(inverse_gamma(cov.shape + self.n / 2, cov.scale + 0.5 * total, self.rng), 1e-12)

    def record(self, scales: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        k = self.k
        out = {"alpha": self.coef[:k].T.ravel().copy(), "alpha_sparse": savs(self.coef[:k], self.norms, self.free).T.ravel(), "a": self.impacts.copy(), "a_sparse": self.sparse_impacts.copy()}
        if self.const:
            out |= {"c": self.coef[k].copy(), "c_sparse": self.coef[k].copy()}  # constants are never thresholded
        return out | scales | {name: np.asarray(r, dtype=float).ravel().copy() for name, r in self.prior.records().items()}


class Walk:
    """Log variances of a chain: levels ``h`` at the rows a task holds, their start and the variance of their steps."""

    def __init__(self, chain: Chain):
        self.h0, self.var, self.cov = np.log(chain.d), np.full(chain.m, 0.1), chain.spec.cov

    def hyper(self, first: np.ndarray, squares: np.ndarray, n: float, rng: np.random.Generator) -> None:
        """Step variances and starts, given the first levels and the sums of squared steps (from the old start on)."""
        self.var = np.clip(inverse_gamma(self.cov.shape + n / 2, self.cov.scale + 0.5 * squares, rng), 1e-8, 1e4)
        q = self.cov.initial_prec + 1 / self.var
        self.h0 = (self.cov.initial_prec * self.cov.initial_mean + first / self.var) / q + rng.standard_normal(len(first)) / np.sqrt(q)


def run_moments(g: Moments, lags: Lags, spec: priors.BayesSpec, rng: np.random.Generator, z: np.ndarray | None = None, sampler: type[Prior] | None = None) -> dict[str, np.ndarray]:
    """Kept draws of one chain by name: alpha and alpha_sparse (vec of the coefficients without constant), c and c_sparse, a and
    a_sparse, d or (h, h0, sigh), and what the prior records. ``g``: moments of (regressors without constant, responses); ``z``:
    these rows, which stochastic volatility needs."""
    chain = Chain(g, lags, spec, rng, sampler)
    sv = isinstance(spec.cov, priors.StochasticVolatility)
    if sv:
        walk, h = Walk(chain), np.tile(np.log(chain.d), (len(z), 1))
        x = np.hstack([z[:, : chain.k], np.ones((len(z), int(chain.const)))])
    kept: dict[str, list] = {}
    for it in range(spec.n_iter):
        if sv:
            chain.coefficients(Weighted.of_rows(z, g.mean, np.exp(-h), chain.k, chain.const))
            h = draw_log_vol((z[:, chain.k :] - x @ chain.coef) @ chain.low.T, h, walk.h0, walk.var, rng)
            walk.hyper(h[0], (np.diff(np.vstack([walk.h0, h]), axis=0) ** 2).sum(axis=0), len(h), rng)
        else:
            chain.coefficients()
            chain.variances()
        if it >= spec.burn and (it - spec.burn) % spec.thin == 0:
            scales = {"h": h.ravel().copy(), "h0": walk.h0.copy(), "sigh": walk.var.copy()} if sv else {"d": chain.d.copy()}
            for name, r in chain.record(scales).items():
                kept.setdefault(name, []).append(r)
    return {name: np.array(v) for name, v in kept.items()}


def run_chain(x: np.ndarray, y: np.ndarray, lags: Lags, spec: priors.BayesSpec, rng: np.random.Generator, sampler: type[Prior] | None = None) -> dict[str, np.ndarray]:
    """:func:`run_moments` of rows: regressors ``x`` (with the constant, if the model has one) and responses ``y``."""
    z = np.hstack([x[:, : x.shape[1] - lags.include_mean], y])
    return run_moments(Moments.of(z), lags, spec, rng, z, sampler)
