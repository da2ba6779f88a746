"""Means and co-moments of design rows, of many windows at once.

All that least squares, conjugate models and homoskedastic sampling need of a window are the number of its rows, the means
of (regressors, responses) and the cross products about them. Two disjoint pieces merge without subtracting large sums, so
windows are built by merging only: a window of n rows is the tail of one stretch of n rows and the head of the next one, and
tails and heads are running merges. Large means beside small noise do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.design import CONST, Lags, with_design
from vectide.operators.gram import Gram
from vectide.sources.series import SeriesFrame


@dataclass(frozen=True)
class Moments:
    """``n`` rows, their ``mean`` (p) and the products about it (``core``, p x p); leading axes are windows."""

    n: np.ndarray
    mean: np.ndarray
    core: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        return Moments(np.float64(len(z)), mean, (z - mean).T @ (z - mean))

    @staticmethod
    def none(p: int) -> Moments:
        return Moments(np.float64(0), np.zeros(p), np.zeros((p, p)))

    def __getitem__(self, at) -> Moments:
        return Moments(self.n[at], self.mean[at], self.core[at])

    def merge(self, other: Moments) -> Moments:
        """Of both sets of rows."""
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros(np.shape(n)), where=n > 0) if np.ndim(n) else (other.n / n if n > 0 else 0.0)
        gap, share = other.mean - self.mean, np.asarray(share)
        weight = np.asarray(self.n * share)
        return Moments(n, self.mean + share[..., None] * gap, self.core + other.core + weight[..., None, None] * gap[..., :, None] * gap[..., None, :])

    def flat(self) -> np.ndarray:
        """One row of numbers for each window: n, means, products."""
        lead = np.shape(self.n)
        return np.concatenate([np.reshape(self.n, (*lead, 1)), self.mean, self.core.reshape(*lead, -1)], axis=-1)

    @staticmethod
    def from_flat(v: np.ndarray, p: int) -> Moments:
        return Moments(v[..., 0], v[..., 1 : p + 1], v[..., p + 1 :].reshape(*v.shape[:-1], p, p))

    def gram(self, k: int, const: bool) -> Gram:
        """Sums of ``k`` regressors (without the constant; with ``const`` it is added as the last one) and the responses."""
        if const:
            return Gram.centred(self.mean, self.core, k + 1, float(self.n))
        full = self.core + self.n * np.outer(self.mean, self.mean)
        return Gram(full[:k, :k], full[:k, k:], full[k:, k:], float(self.n))

    @staticmethod
    def from_gram(g: Gram) -> Moments:
        """Of sums with a constant."""
        return Moments(np.float64(g.n), g.means, g.core)


def heads(z: np.ndarray) -> Moments:
    """Of the first 1, 2, ... rows of ``z``: products grow by what each row adds about the mean before it."""
    n = np.arange(1, len(z) + 1, dtype=float)
    centre = z.mean(axis=0)
    d = z - centre
    mean = np.cumsum(d, axis=0) / n[:, None]
    step = d[1:] - mean[:-1]
    core = np.zeros((len(z), z.shape[1], z.shape[1]))
    core[1:] = np.cumsum(np.einsum("ni,nj->nij", step * ((n[1:] - 1) / n[1:])[:, None], step), axis=0)
    return Moments(n, mean + centre, core)


def tails(z: np.ndarray) -> Moments:
    """Of the last len(z), ..., 2, 1 rows of ``z``."""
    return heads(z[::-1])[::-1]


def stretches(z: np.ndarray, n: int) -> Iterator[tuple[int, Moments]]:
    """The first window and the moments of windows of ``n`` rows that begin in each stretch of n rows: n windows at a time."""
    p = z.shape[1]
    for a in range(0, len(z) - n + 1, n):
        tail, head = tails(z[a : a + n]), z[a + n : a + 2 * n - 1]
        if len(head):
            h = heads(head)
            before = Moments(np.insert(h.n, 0, 0.0), np.insert(h.mean, 0, 0.0, axis=0), np.insert(h.core, 0, 0.0, axis=0))
            yield a, tail[: len(head) + 1].merge(before)
        else:
            yield a, tail[:1]
    if len(z) < n:
        yield 0, Moments(np.zeros(0), np.zeros((0, p)), np.zeros((0, p, p)))


def windows(z: np.ndarray, n: int) -> Moments:
    """Of rows s .. s + n - 1 for s = 0, 1, ..., len(z) - n."""
    parts = [g for _, g in stretches(z, n)]
    return Moments(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("n", "mean", "core")))


def panel_moments(sf: SeriesFrame, lags: Lags) -> DataFrame:
    """The panel keys, n, mean and core (row by row) of each panel's design, regressors before responses: one aggregate, with
    partial sums before the shuffle."""
    design = with_design(sf.doubles(), lags)
    cols = [c for c in lags.terms(sf.names) if c != CONST] + list(sf.names)
    p, n = len(cols), F.count("*").cast("double")
    pair = lambda i, j: (n * F.covar_pop(cols[min(i, j)], cols[max(i, j)]))
    return design.groupBy(*sf.panel).agg(n.alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"), F.array(*[pair(i, j) for i in range(p) for j in range(p)]).alias("core"))


def running(parts: DataFrame, panel: list[str], kinds: str, p: int, fan: int, blocks: int) -> DataFrame:
    """Moments of all blocks before each block of ``parts`` (panel keys, block, flat), in levels: ``fan`` neighbours are merged
    in a task, their sums are scanned in the same way, and each task goes on from what its neighbours have before them. ``kinds``:
    the schema of the panel keys."""
    schema = f"{kinds}block long, flat array<double>"

    def states(pdf: pd.DataFrame) -> list[Moments]:
        return [Moments.from_flat(np.asarray(v, dtype=float), p) for v in pdf["flat"]]

    def merged(start: Moments, parts: list[Moments]) -> list[Moments]:
        out = [start]
        for x in parts:
            out.append(out[-1].merge(x))
        return out

    def scanned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start = Moments.from_flat(np.asarray(pdf["start"].iat[0], dtype=float), p) if "start" in pdf else Moments.none(p)
        return pdf[[*panel, "block"]].assign(flat=[x.flat() for x in merged(start, states(pdf))[:-1]])

    if blocks <= fan:
        return parts.withColumn("up", F.lit(0)).groupBy(*panel, "up").applyInPandas(scanned, schema)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[*panel]].iloc[:1].assign(block=int(pdf["block"].iat[0]) // fan, flat=[merged(Moments.none(p), states(pdf.sort_values("block")))[-1].flat()])

    up = F.floor(F.col("block") / fan)
    above = parts.withColumn("up", up).groupBy(*panel, "up").applyInPandas(total, schema)
    starts = running(above, panel, kinds, p, fan, -(-blocks // fan)).withColumnsRenamed({"block": "up", "flat": "start"})
    return parts.withColumn("up", up).join(starts, [*panel, "up"]).groupBy(*panel, "up").applyInPandas(scanned, schema)


#: (stacked moments, regressors without constant, whether there is one) -> stacked (coefficients, covariances).
Estimator = Callable[[Moments, int, bool], tuple[np.ndarray, np.ndarray]]


def _products(full: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Residual products at coefficients ``b`` from products of (regressors, responses)."""
    bt = np.swapaxes(b, -1, -2)
    return full[..., k:, k:] - bt @ full[..., :k, k:] - full[..., k:, :k] @ b + bt @ full[..., :k, :k] @ b


def _through_origin(core: np.ndarray, n: np.ndarray, mean: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual products without a constant: those about the means, moved by what n means add to the products.
    The means are one direction only, so they are never squared into the matrix that is solved."""
    x, y = mean[..., :k], mean[..., k:]
    b = np.linalg.solve(core[..., :k, :k], core[..., :k, k:])
    u = np.linalg.solve(core[..., :k, :k], x[..., None])[..., 0]
    left = y - (x[..., None, :] @ b)[..., 0, :]
    size = 1 + n * (x * u).sum(axis=-1)
    b = b + (n / size)[..., None, None] * u[..., :, None] * left[..., None, :]
    off = left / size[..., None]
    return b, _products(core, b, k) + n[..., None, None] * off[..., :, None] * off[..., None, :]


def least_squares(g: Moments, k: int, const: bool) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(g.n, dtype=float)
    if not const:
        b, rss = _through_origin(g.core, n, g.mean, k)
    else:
        b = np.linalg.solve(g.core[..., :k, :k], g.core[..., :k, k:])
        rss = _products(g.core, b, k)
        b = np.concatenate([b, (g.mean[..., k:] - (g.mean[..., None, :k] @ b)[..., 0, :])[..., None, :]], axis=-2)
    return b, rss / (n - k - const)[..., None, None]


def with_prior(g: Moments, k: int, const: bool, prior: Gram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior means, residual products and precisions of windows under the rows that ``prior`` sums up. With a constant all
    is taken about the window's means: prior rows less their constant's share of them."""
    full0 = np.block([[prior.xx, prior.xy], [prior.xy.T, prior.yy]])
    total, kk = len(full0), k + const
    n = np.asarray(g.n, dtype=float)
    if const:
        use = np.arange(total) != k
        shift = np.zeros((*np.shape(n), total, total)) + np.eye(total)
        shift[..., k, use] = -g.mean
        full = np.swapaxes(shift, -1, -2) @ full0 @ shift
        at = np.flatnonzero(use)
        full[..., at[:, None], at[None]] += g.core
        full[..., k, k] += n
        b = np.linalg.solve(full[..., :kk, :kk], full[..., :kk, kk:])
        scale = _products(full, b, kk)
        b[..., k, :] += g.mean[..., k:] - (g.mean[..., None, :k] @ b[..., :k, :])[..., 0, :]
    else:
        b, scale = _through_origin(full0 + g.core, n, g.mean, k)
    plain = np.zeros((*np.shape(n), kk, kk)) + prior.xx
    plain[..., :k, :k] += g.core[..., :k, :k] + n[..., None, None] * g.mean[..., :k, None] * g.mean[..., None, :k]
    if const:
        plain[..., :k, k] += n[..., None] * g.mean[..., :k]
        plain[..., k, :k] += n[..., None] * g.mean[..., :k]
        plain[..., k, k] += n
    return b, (scale + np.swapaxes(scale, -1, -2)) / 2, plain


@dataclass(frozen=True)
class Weighted:
    """Weighted sums about a fixed centre, one for each series (leading axis) or one for all: weights ``n``, first and second moments ``s``
    and ``ss`` of (regressors, responses) less ``centre``. What Gibbs steps need of the rows."""

    centre: np.ndarray
    n: np.ndarray
    s: np.ndarray
    ss: np.ndarray
    k: int
    const: bool

    @staticmethod
    def plain(g: Moments, k: int, const: bool) -> Weighted:
        """All rows weigh one: a single set of sums for all series."""
        return Weighted(g.mean, np.array([float(g.n)]), np.zeros((1, len(g.mean))), g.core[None], k, const)

    @staticmethod
    def of_rows(z: np.ndarray, centre: np.ndarray, weights: np.ndarray, k: int, const: bool) -> Weighted:
        """``weights``: rows by series."""
        d = z - centre
        wd = weights.T[:, :, None] * d[None]
        return Weighted(centre, weights.sum(axis=0), wd.sum(axis=1), np.swapaxes(wd, 1, 2) @ d, k, const)

    def xx(self) -> np.ndarray:
        """X'WX of each series."""
        k, m = self.k, self.centre[: self.k]
        n, s = self.n[:, None], self.s[:, :k]
        cross = s[:, :, None] * m[None, None]
        out = self.ss[:, :k, :k] + cross + np.swapaxes(cross, 1, 2) + n[:, :, None] * np.outer(m, m)
        if not self.const:
            return out
        side = s + n * m
        return np.concatenate([np.concatenate([out, side[:, :, None]], axis=2), np.concatenate([side, n], axis=1)[:, None]], axis=1)

    def _loads(self, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of E = Y - X coef: loads on (regressors, responses), the value at the centre, and both applied to the sums."""
        k = self.k
        load = np.vstack([-coef[:k], np.eye(len(self.centre) - k)])
        off = self.centre @ load - (coef[k] if self.const else 0.0)
        return load, off, self.s @ load, self.ss @ load

    def cross(self, coef: np.ndarray) -> np.ndarray:
        """X'WE of each series."""
        k = self.k
        _, off, first, half = self._loads(coef)
        mean = first + self.n[:, None] * off
        xe = half[:, :k] + self.s[:, :k, None] * off + self.centre[None, :k, None] * mean[:, None]
        return np.concatenate([xe, mean[:, None]], axis=1) if self.const else xe

    def products(self, coef: np.ndarray) -> np.ndarray:
        """E'WE of each series."""
        load, off, first, half = self._loads(coef)
        cross = first[:, :, None] * off
        return load.T @ half + cross + np.swapaxes(cross, 1, 2) + self.n[:, None, None] * np.outer(off, off)
