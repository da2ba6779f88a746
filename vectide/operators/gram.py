"""Cross-product sums of a design: all that least squares and conjugate models need from the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.design import CONST

#: Up to so many columns the sums are one JVM aggregate; beyond, each task sums matrices.
JVM_COLUMNS = 24


@dataclass(frozen=True)
class Gram:
    """X'X, X'Y, Y'Y and the number of rows. Sums of Grams are Grams of the joined rows.

    Where X ends in a constant, ``means`` and ``core`` are the means of the other columns and their cross products about
    them: least squares takes these, as large means leave nothing of small differences in the plain sums."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: float
    means: np.ndarray | None = None
    core: np.ndarray | None = None

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n)

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, const: bool = False) -> Gram:
        """``const``: the last column of ``x`` is a constant of ones."""
        if const and len(x):
            z = np.hstack([x[:, :-1], y])
            return Gram.centred(z.mean(axis=0), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), x.shape[1], len(x))
        return Gram(x.T @ x, x.T @ y, y.T @ y, len(x))

    @staticmethod
    def centred(means: np.ndarray, core: np.ndarray, k: int, n: float) -> Gram:
        """Of ``k`` regressors, the last one a constant, from means and centred cross products of the other columns."""
        full = np.insert(np.insert(core + n * np.outer(means, means), k - 1, n * means, axis=0), k - 1, np.insert(n * means, k - 1, n), axis=1)
        return Gram(full[:k, :k], full[:k, k:], full[k:, k:], n, means, core)

    def inverse(self) -> np.ndarray:
        """Of X'X."""
        if self.core is None:
            return np.linalg.inv(self.xx)
        k = len(self.xx) - 1
        v, m = np.linalg.inv(self.core[:k, :k]), self.means[:k]
        return np.block([[v, -(v @ m)[:, None]], [-(m @ v)[None], np.array([[1 / self.n + m @ v @ m]])]])

    @staticmethod
    def from_full(full: np.ndarray, k: int, n: float) -> Gram:
        return Gram(full[:k, :k], full[:k, k:], full[k:, k:], n)


def gram(design: DataFrame, xs: list[str], ys: list[str]) -> Gram:
    """One pass over ``design``. With a constant among the regressors, products are summed about the means."""
    cols, k = [*xs, *ys], len(xs)
    m = len(cols)
    if xs and xs[-1] == CONST and m <= JVM_COLUMNS:
        use = [c for c in cols if c != CONST]
        row = design.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(use)], *_covariances(use)).first()
        return _centred(row, use, range(len(use)), k, "n", "m{}", "s{}_{}")
    if m <= JVM_COLUMNS:
        sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
        row = design.agg(F.count("*").alias("n"), *sums).first()
        full = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                full[i, j] = full[j, i] = row[f"s{i}_{j}"] or 0.0
        return Gram.from_full(full, k, row["n"])

    centre = np.zeros(m)
    if xs and xs[-1] == CONST:  # about a mean of early rows: the means themselves would take another pass
        some = design.select(*cols).limit(1_000).agg(*[F.avg(c) for c in cols if c != CONST]).first()
        centre = np.insert(np.array([x or 0.0 for x in some]), k - 1, 0.0)

    def run(batches):
        total, n = np.zeros((m, m)), 0
        for b in batches:
            z = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(m)]) - centre
            total += z.T @ z
            n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["s", "n"])

    parts = design.select(*cols).mapInArrow(run, "s array<double>, n long")
    at = F.posexplode("s")
    sums = {r["pos"]: r["v"] for r in parts.select(at).groupBy("pos").agg(F.sum("col").alias("v")).collect()}
    n = parts.agg(F.sum("n")).first()[0] or 0
    full = np.array([sums.get(i, 0.0) for i in range(m * m)]).reshape(m, m)
    if not centre.any() or not n:
        return Gram.from_full(full, k, n)
    off, use = full[k - 1] / n, np.arange(m) != k - 1  # the constant's row sums what is left of the means
    return Gram.centred((centre + off)[use], (full - n * np.outer(off, off))[np.ix_(use, use)], k, n)


def _covariances(cols: list[str], inside=None) -> list:
    pick = (lambda c: F.col(c)) if inside is None else (lambda c: F.when(inside, F.col(c)))
    return [F.covar_pop(pick(cols[i]), pick(cols[j])).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def _centred(row, use: list[str], at, k: int, n: str, mean: str, cov: str) -> Gram:
    count, at = row[n] or 0, list(at)
    core = np.zeros((len(use), len(use)))
    for i in range(len(use)):
        for j in range(i, len(use)):
            core[i, j] = core[j, i] = count * (row[cov.format(min(at[i], at[j]), max(at[i], at[j]))] or 0.0)
    return Gram.centred(np.array([row[mean.format(a)] or 0.0 for a in at]), core, k, count)


def lag_grams(design: DataFrame, xs_of: dict[int, list[str]], ys: list[str]) -> dict[int, Gram]:
    """Grams of several lag orders from one pass over the design of the largest: order p uses the rows with t > p."""
    largest = xs_of[max(xs_of)]
    if largest[-1] == CONST:
        names = [c for c in [*largest, *ys] if c != CONST]
        at, sums = {c: i for i, c in enumerate(names)}, []
        for p, xs in xs_of.items():
            inside, use = F.col("t") > p, [c for c in [*xs, *ys] if c != CONST]
            value = {c: F.when(inside, F.col(c)) for c in use}
            sums.append(F.sum(inside.cast("long")).alias(f"n{p}"))
            sums += [F.avg(value[c]).alias(f"m{p}_{at[c]}") for c in use]
            sums += [F.covar_pop(value[a], value[b]).alias(f"s{p}_{min(at[a], at[b])}_{max(at[a], at[b])}") for i, a in enumerate(use) for b in use[i:]]
        row, out = design.agg(*sums).first(), {}
        for p, xs in xs_of.items():
            use = [c for c in [*xs, *ys] if c != CONST]
            out[p] = _centred(row, use, [at[c] for c in use], len(xs), f"n{p}", f"m{p}_{{}}", f"s{p}_{{}}_{{}}")
        return out
    cols = [*largest, *ys]
    at = {c: i for i, c in enumerate(cols)}
    sums, want = [], {}
    for p, xs in xs_of.items():
        use = [*xs, *ys]
        inside = F.col("t") > p
        sums.append(F.sum(inside.cast("long")).alias(f"n{p}"))
        for i, a in enumerate(use):
            for b in use[i:]:
                sums.append(F.sum(F.when(inside, F.col(a) * F.col(b))).alias(f"s{p}_{at[a]}_{at[b]}"))
        want[p] = use
    row = design.agg(*sums).first()
    out = {}
    for p, use in want.items():
        full = np.zeros((len(use), len(use)))
        for i, a in enumerate(use):
            for j in range(i, len(use)):
                full[i, j] = full[j, i] = row[f"s{p}_{at[a]}_{at[use[j]]}"] or 0.0
        out[p] = Gram.from_full(full, len(use) - len(ys), row[f"n{p}"])
    return out
