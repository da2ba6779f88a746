"""Structure of fitted autoregressions: stability, moving-average form, impulse responses, variance decompositions and
spillovers. Inputs are small matrices; outputs that users join or filter are DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators.ols import VarModel


def companion(lag_coef: np.ndarray, dim: int, order: int) -> np.ndarray:
    out = np.zeros((dim * order, dim * order))
    out[:dim] = lag_coef[: dim * order].T
    out[dim:, : dim * (order - 1)] = np.eye(dim * (order - 1))
    return out


def stable_roots(model: VarModel) -> np.ndarray:
    """Moduli of the companion matrix's eigenvalues, largest first."""
    return np.sort(np.abs(np.linalg.eigvals(companion(model.lag_coef, model.dim, model.lags.order))))[::-1]


def is_stable(model: VarModel) -> bool:
    return bool((stable_roots(model) < 1).all())


def vma(lag_coef: np.ndarray, dim: int, order: int, lag_max: int) -> np.ndarray:
    """W_0 = I, W_1, ..., W_lag_max: (lag_max + 1, dim, dim), responses by shocks transposed, so row i is shock i."""
    b = lag_coef[: dim * order].reshape(order, dim, dim)
    out = [np.eye(dim)]
    for i in range(1, lag_max + 1):
        out.append(sum(out[i - j - 1] @ b[j] for j in range(min(i, order))))
    return np.array(out)


def model_vma(model: VarModel, lag_max: int, orthogonal: bool = False) -> np.ndarray:
    w = vma(model.lag_coef, model.dim, model.lags.order, lag_max)
    return np.linalg.cholesky(model.sigma).T @ w if orthogonal else w


def irf(model: VarModel, spark: SparkSession, lag_max: int = 10, orthogonal: bool = True, impulse: list[str] | None = None, response: list[str] | None = None) -> DataFrame:
    """impulse, period, response, value."""
    w = model_vma(model, lag_max, orthogonal)
    rows = [(a, h, b, float(w[h, i, j])) for h in range(lag_max + 1) for i, a in enumerate(model.names) for j, b in enumerate(model.names)]
    df = spark.createDataFrame(rows, "impulse string, period int, response string, value double")
    if impulse is not None:
        df = df.filter(F.col("impulse").isin(impulse))
    return df.filter(F.col("response").isin(response)) if response is not None else df


def forecast_mse(model: VarModel, step: int) -> np.ndarray:
    """(step, dim, dim): covariance of the forecast errors 1..step ahead."""
    w = model_vma(model, step - 1)
    return np.cumsum(np.einsum("hij,ik,hkl->hjl", w, model.sigma, w), axis=0)


def fevd(w: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Generalised decomposition (step, response, shock), rows scaled to sum 1, from a moving-average form ``w``."""
    a = np.swapaxes(w, 1, 2)  # response by shock
    numer = np.cumsum((a @ sigma) ** 2 / np.diag(sigma), axis=0)
    denom = np.cumsum(np.einsum("hij,jk,hik->hi", a, sigma, a), axis=0)
    out = numer / denom[:, :, None]
    return out / out.sum(axis=2, keepdims=True)


def fevd_last(w: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The decomposition at the last step for many models at once: ``w`` (models, step, dim, dim), ``sigma`` (models, dim, dim)."""
    a = np.swapaxes(w, -1, -2)
    var = np.diagonal(sigma, axis1=1, axis2=2)
    moved = a @ sigma[:, None]
    numer = (moved**2).sum(axis=1) / var[:, None, :]
    denom = (moved * a).sum(axis=(1, 3))
    out = numer / denom[:, :, None]
    return out / out.sum(axis=2, keepdims=True)


def connectedness(lag_coef: np.ndarray, sigma: np.ndarray, order: int, step: int) -> np.ndarray:
    """100 times the decomposition at the last step: response by shock."""
    return 100 * fevd(vma(lag_coef, len(sigma), order, step - 1), sigma)[-1]


def spillover_long(table: np.ndarray, names: tuple[str, ...], spark: SparkSession) -> DataFrame:
    """series, shock, spillover."""
    rows = [(a, b, float(table[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "series string, shock string, spillover double")


def spillover(model: VarModel, spark: SparkSession, step: int = 10) -> DataFrame:
    return spillover_long(connectedness(model.lag_coef, model.sigma, model.lags.order, step), model.names, spark)


def spillover_margins(long: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """series, to, from, net and total of tables (series, shock, spillover), one table for each value of ``keys``."""
    cross = F.when(F.col("series") != F.col("shock"), F.col("spillover")).otherwise(0.0)
    got = long.groupBy(*keys, F.col("series")).agg(F.sum(cross).alias("from"))
    sent = long.groupBy(*keys, F.col("shock").alias("series")).agg(F.sum(cross).alias("to"))
    total = long.groupBy(*keys).agg((F.sum(cross) / F.countDistinct("series")).alias("total"))
    both = got.join(sent, [*keys, "series"]).withColumn("net", F.col("to") - F.col("from"))
    both = both.join(total, list(keys)) if keys else both.crossJoin(F.broadcast(total))  # one row
    return both.select(*keys, "series", "to", "from", "net", "total")


def net_pairwise(long: DataFrame, dim: int) -> DataFrame:
    """series, shock, net: what a series sends to another less what it gets, over the dimension."""
    back = long.select(F.col("series").alias("shock"), F.col("shock").alias("series"), F.col("spillover").alias("__back"))
    return long.join(back, ["series", "shock"]).select("series", "shock", ((F.col("__back") - F.col("spillover")) / dim).alias("net"))
