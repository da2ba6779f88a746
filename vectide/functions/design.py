"""Regression designs of vector autoregressions, as Spark columns and as small matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.sources.series import BLOCK_ROWS, SeriesFrame, blocked

CONST = "const"
HAR_PARTS = ("day", "week", "month")


@dataclass(frozen=True)
class Lags:
    """Which past values a model regresses on: p lags, or means over the last day, week and month rows."""

    p: int = 1
    har: tuple[int, int] | None = None
    include_mean: bool = True

    def __post_init__(self):
        if self.har is None and self.p < 1:
            raise ValueError("the lag is at least 1")
        if self.har is not None and not 1 < self.har[0] < self.har[1]:
            raise ValueError("1 < week < month is needed")

    @property
    def parts(self) -> list[str]:
        return list(HAR_PARTS) if self.har else [str(i) for i in range(1, self.p + 1)]

    @property
    def order(self) -> int:
        """Rows that the first response needs before it."""
        return self.har[1] if self.har else self.p

    def terms(self, names: tuple[str, ...]) -> list[str]:
        """Names of the regressors: variable and part, in blocks by part, then the constant."""
        return [f"{c}_{k}" for k in self.parts for c in names] + ([CONST] if self.include_mean else [])

    def k(self, dim: int) -> int:
        return len(self.parts) * dim + self.include_mean

    def transform(self, dim: int) -> np.ndarray:
        """Maps the rows of a lag design of ``order`` lags to this design: identity, or the means of a HAR design."""
        return har_matrix(dim, *self.har, self.include_mean) if self.har else np.eye(self.k(dim))


def har_matrix(dim: int, week: int = 5, month: int = 22, include_mean: bool = True) -> np.ndarray:
    """(3 dim + 1) x (month dim + 1): day, week and month means of each variable from its first ``month`` lags."""
    rows = np.zeros((3, month))
    for i, n in enumerate((1, week, month)):
        rows[i, :n] = 1 / n
    out = np.kron(rows, np.eye(dim))
    if not include_mean:
        return out
    return np.block([[out, np.zeros((3 * dim, 1))], [np.zeros((1, month * dim)), np.ones((1, 1))]])


def with_design(sf: SeriesFrame, lags: Lags, block_rows: int = BLOCK_ROWS, skip: int | None = None) -> DataFrame:
    """``sf`` with a column for each regressor, without the first ``skip`` (by default ``order``) rows of each panel. Long series are cut into
    blocks with a halo, so that windows stay inside a block."""
    block_rows = max(block_rows, lags.order + 1)
    rows, keys, own = blocked(sf, lags.order, block_rows)
    w = Window.partitionBy(*keys).orderBy("t")
    out = {}
    if lags.har:
        for part, n in zip(HAR_PARTS, (1, *lags.har), strict=True):
            for c in sf.names:
                v = F.lag(c, 1).over(w) if n == 1 else F.avg(c).over(w.rowsBetween(-n, -1))
                out[f"{c}_{part}"] = v
    else:
        for i in range(1, lags.p + 1):
            for c in sf.names:
                out[f"{c}_{i}"] = F.lag(c, i).over(w)
    if lags.include_mean:
        out[CONST] = F.lit(1.0)
    return rows.withColumns(out).filter(own & (F.col("t") > (lags.order if skip is None else skip))).drop("__own", "__block")


def group_matrix(p: int, dim: int, kind: str = "longrun") -> np.ndarray:
    """Shrinkage groups of the p * dim coefficients of each equation. ``longrun``: own and cross lags apart at every lag;
    ``short``: apart at the first lag, one group for each later lag; ``no``: one group."""
    eye = np.eye(dim, dtype=int)
    if kind == "no":
        return np.ones((p * dim, dim), dtype=int)
    if kind == "longrun":
        return np.vstack([2 * i + 1 + eye for i in range(p)])
    if kind == "short":
        return np.vstack([1 + eye if i == 0 else np.full((dim, dim), i + 2) for i in range(p)])
    raise ValueError(f"unknown groups {kind}")


def own_groups(p: int, dim: int, kind: str) -> set[int]:
    """Groups that hold own lags only."""
    g = group_matrix(p, dim, kind)
    own = np.tile(np.eye(dim, dtype=bool), (p, 1))
    return {int(x) for x in np.unique(g) if own[g == x].all()}


def minnesota_dummies(sigma: np.ndarray, p: int, lam: float, delta: np.ndarray | list[np.ndarray], eps: float = 1e-4, include_mean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Dummy observations (Y, X) of the Minnesota prior. ``delta`` holds the prior means of own first lags, or, as a
    list, those of own coefficients of each of the p parts."""
    sigma = np.asarray(sigma, dtype=float)
    dim = len(sigma)
    means = list(delta) if isinstance(delta, list) else [np.asarray(delta, dtype=float), *[np.zeros(dim)] * (p - 1)]
    k = p * dim + include_mean
    rows = p * dim + dim + include_mean
    y, x = np.zeros((rows, dim)), np.zeros((rows, k))
    for i, d in enumerate(means):
        y[i * dim : (i + 1) * dim] = np.diag(np.broadcast_to(d, dim) * sigma / lam)
        x[i * dim : (i + 1) * dim, i * dim : (i + 1) * dim] = np.diag((i + 1) * sigma / lam)
    y[p * dim : p * dim + dim] = np.diag(sigma)
    if include_mean:
        x[-1, -1] = eps
    return y, x
