"""Random numbers that NumPy's generator lacks."""

from __future__ import annotations

import numpy as np

TINY = 1e-300


def gig(lam, psi, chi, rng: np.random.Generator) -> np.ndarray:
    """Generalised inverse Gaussian numbers with density x^(lam-1) exp(-(psi x + chi / x) / 2), by the rejection method of
    Devroye (2014) for all elements at once."""
    lam, psi, chi = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (lam, psi, chi)))
    shape = lam.shape
    lam, psi, chi = (v.ravel() for v in (lam, np.maximum(psi, 1e-12), np.maximum(chi, 1e-12)))
    omega, scale = np.sqrt(psi * chi), np.sqrt(chi / psi)
    a = np.abs(lam)
    alpha = omega**2 / (np.sqrt(omega**2 + a**2) + a)  # sqrt(omega^2 + a^2) - a, without cancellation

    def f(x):
        return -alpha * (np.cosh(x) - 1) - a * (np.expm1(x) - x)

    def slope(x):
        return -alpha * np.sinh(x) - a * np.expm1(x)

    one = np.ones_like(a)
    up, down = -f(one), -f(-one)
    t = np.where(up > 2, np.sqrt(2 / (alpha + a)), np.where(up < 0.5, np.log(4 / (alpha + 2 * a)), 1.0))
    inv = 1 / alpha
    s = np.where(down > 2, np.sqrt(4 / (alpha * np.cosh(1) + a)), np.where(down < 0.5, np.minimum(1 / np.maximum(a, TINY), np.log1p(inv + np.sqrt(inv**2 + 2 * inv))), 1.0))
    eta, zeta, theta, xi = -f(t), -slope(t), -f(-s), slope(-s)
    p, r = 1 / xi, 1 / zeta
    right, left = t - r * eta, s - p * theta
    q = right + left
    out, todo = np.empty(len(a)), np.arange(len(a))
    while len(todo):
        u, v, w = rng.random((3, len(todo)))
        v = np.maximum(v, TINY)
        total = (p + q + r)[todo]
        mid = u * total < q[todo]
        high = ~mid & (u * total < (q + r)[todo])
        x = np.where(mid, -left[todo] + q[todo] * v, np.where(high, right[todo] - r[todo] * np.log(v), -left[todo] + p[todo] * np.log(v)))
        log_hat = np.where(x > right[todo], -eta[todo] - zeta[todo] * (x - t[todo]), np.where(x < -left[todo], -theta[todo] + xi[todo] * (x + s[todo]), 0.0))
        fx = -alpha[todo] * (np.cosh(x) - 1) - a[todo] * (np.expm1(x) - x)
        ok = np.log(np.maximum(w, TINY)) + log_hat <= fx
        out[todo[ok]] = x[ok]
        todo = todo[~ok]
    ratio = a / omega
    value = (ratio + np.sqrt(1 + ratio**2)) * np.exp(out)
    value = np.where(lam < 0, 1 / value, value) * scale
    return np.clip(value, 1e-100, 1e100).reshape(shape)


def inverse_gamma(shape, scale, rng: np.random.Generator) -> np.ndarray:
    return np.asarray(scale, dtype=float) / np.maximum(rng.gamma(shape, 1.0, np.broadcast_shapes(np.shape(shape), np.shape(scale))), TINY)


def inverse_gaussian(mean, shape, rng: np.random.Generator) -> np.ndarray:
    return np.maximum(rng.wald(np.clip(mean, 1e-12, 1e12), np.clip(shape, 1e-12, 1e12)), 1e-100)


def from_grid(grid: np.ndarray, log_weight: np.ndarray, rng: np.random.Generator) -> float:
    """One grid point, with probabilities in proportion to exp(log_weight)."""
    w = np.exp(log_weight - log_weight.max())
    return float(grid[np.searchsorted(np.cumsum(w), rng.random() * w.sum())])


def inner_grid(n: int) -> np.ndarray:
    """``n`` points inside (0, 1)."""
    return np.arange(1, n + 1) / (n + 1)
