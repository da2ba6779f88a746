"""Forecasts of fitted autoregressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions.special import normal_quantile
from vectide.operators.niw import NiwPosterior, draw_iw, draw_mn
from vectide.operators.ols import VarModel
from vectide.operators.structure import forecast_mse
from vectide.sources.series import SeriesFrame

FORECASTS = "h int, series string, forecast double, se double, lower double, upper double, lower_joint double, upper_joint double"


def path(lag_coef: np.ndarray, last: np.ndarray, order: int, n_ahead: int) -> np.ndarray:
    """Recursive point forecasts. ``last``: the last ``order`` rows, oldest first; leading axes are separate paths."""
    dim = last.shape[-1]
    state = np.concatenate([last[..., -i - 1, :] for i in range(order)], axis=-1)  # newest first
    slopes, const = lag_coef[..., : dim * order, :], lag_coef[..., dim * order :, :].sum(axis=-2)
    out = []
    for _ in range(n_ahead):
        y = (state[..., None, :] @ slopes)[..., 0, :] + const
        out.append(y)
        state = np.concatenate([y, state[..., :-dim]], axis=-1)
    return np.stack(out, axis=-2)


def last_rows(model: VarModel, sf: SeriesFrame) -> np.ndarray:
    rows = np.array(sf.last_rows(model.lags.order))
    if len(rows) < model.lags.order:
        raise ValueError(f"a forecast needs {model.lags.order} rows")
    return rows


def banded(point: np.ndarray, se: np.ndarray, names: tuple[str, ...], spark: SparkSession, level: float) -> DataFrame:
    """Point forecasts with marginal bands and with Bonferroni bands over all horizons."""
    h = len(point)
    z, zj = normal_quantile(1 - level / 2), normal_quantile(1 - level / (2 * h))
    rows = [(i + 1, c, *map(float, (f := point[i, j], s := se[i, j], f - z * s, f + z * s, f - zj * s, f + zj * s))) for i in range(h) for j, c in enumerate(names)]
    return spark.createDataFrame(rows, FORECASTS)


def predict(model: VarModel, sf: SeriesFrame, n_ahead: int, level: float = 0.05) -> DataFrame:
    """Least squares forecasts with normal bands."""
    point = path(model.lag_coef, last_rows(model, sf), model.lags.order, n_ahead)
    se = np.sqrt(np.diagonal(forecast_mse(model, n_ahead), axis1=1, axis2=2))
    return banded(point, se, model.names, sf.df.sparkSession, level)


def predict_panel(sf: SeriesFrame, model_of, n_ahead: int) -> DataFrame:
    """The panel keys, h, series, forecast: one least squares model for each member of a panel, from its moments, and its
    forecast from its last rows. ``model_of``: the lags."""
    from vectide.operators.ols import fit_panel

    lags, names, panel, q = model_of, sf.names, list(sf.panel), model_of.order
    m = sf.dim
    last = sf.df.groupBy(*panel).agg(F.max("t").alias("__last"))
    # the last rows only: an array of a fixed length for each member
    row = F.struct("t", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    ends = sf.df.join(last, panel).filter(F.col("t") > F.col("__last") - q).groupBy(*panel).agg(F.array_sort(F.collect_list(row)).alias("r"))
    ends = ends.select(*panel, F.flatten(F.transform("r", lambda x: F.array(*[x[f"c{i}"] for i in range(m)]))).alias("last"))

    def run(batches):
        for pdf in batches:
            for item in pdf.to_dict("records"):
                b = np.reshape(item["coef"], (-1, m))
                f = path(lags.transform(m).T @ b, np.reshape(item["last"], (-1, m)), q, n_ahead)
                out = pd.DataFrame({"h": np.repeat(np.arange(1, n_ahead + 1, dtype=np.int32), m), "series": list(names) * n_ahead, "forecast": f.ravel()})
                yield out.assign(**{c: [item[c]] * len(out) for c in panel})[[*panel, "h", "series", "forecast"]]

    fits = fit_panel(sf, lags).filter("coef IS NOT NULL").join(ends, panel)
    return fits.mapInPandas(run, f"{sf.panel_schema}h int, series string, forecast double")


PREDICTIVE = "h int, draw int, series string, value double"
BLOCK_DRAWS = 500


def _predictive(h: int, first: int, values: np.ndarray, names: tuple[str, ...]) -> pd.DataFrame:
    """Long form of (draws, h, dim)."""
    n = len(values)
    return pd.DataFrame({
        "h": np.tile(np.repeat(np.arange(1, h + 1, dtype=np.int32), len(names)), n),
        "draw": np.repeat(np.arange(first, first + n, dtype=np.int32), h * len(names)),
        "series": list(names) * (h * n),
        "value": values.reshape(-1),
    })


def predict_density(post: NiwPosterior, sf: SeriesFrame, n_ahead: int, n_iter: int = 100, seed: int = 1, along: str = "mean") -> DataFrame:
    """Predictive draws of a conjugate model: h, draw, series, value. ``along`` = "mean" conditions each step on the path of
    posterior means; "draw" lets every draw run along its own path."""
    start, names, lags = last_rows(post, sf), post.names, post.lags
    dim, order, to_lags = post.dim, post.lags.order, lags.transform(post.dim).T
    mean_path = path(post.lag_coef, start, order, n_ahead)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"].tolist():
                n, rng = min(BLOCK_DRAWS, n_iter - b * BLOCK_DRAWS), np.random.default_rng([seed, b])
                sigmas = draw_iw(post.scale, post.shape, n, rng)
                root = np.linalg.cholesky(sigmas)
                out = np.empty((n, n_ahead, dim))
                if along == "draw":
                    coefs = to_lags @ draw_mn(post.coef, post.prec, sigmas, rng)
                    state = np.repeat(np.concatenate(start[::-1])[None], n, axis=0)
                    for h in range(n_ahead):
                        y = (state[:, None] @ coefs[:, : dim * order])[:, 0] + coefs[:, dim * order :].sum(axis=1)
                        out[:, h] = y + (root @ rng.standard_normal((n, dim, 1)))[..., 0]
                        state = np.concatenate([out[:, h], state[:, :-dim]], axis=1)
                else:
                    known = np.vstack([start, mean_path])
                    for h in range(n_ahead):
                        x = np.concatenate(known[h : h + order][::-1])
                        x = lags.transform(dim) @ np.r_[x, np.ones(int(lags.include_mean))]
                        spread = np.sqrt(1 + x @ np.linalg.solve(post.prec, x))
                        out[:, h] = x @ post.coef + spread * (root @ rng.standard_normal((n, dim, 1)))[..., 0]
                yield _predictive(n_ahead, b * BLOCK_DRAWS + 1, out, names)

    blocks = max(1, -(-n_iter // BLOCK_DRAWS))
    return sf.df.sparkSession.range(0, blocks, 1, blocks).mapInPandas(run, PREDICTIVE)


def summarise(draws: DataFrame, level: float = 0.05, median: bool = False) -> DataFrame:
    """h, series, forecast, se, lower, upper, lower_joint, upper_joint of predictive draws; joint bands split the level over
    the horizons."""
    v, last = F.col("value"), F.max("h").over(Window.partitionBy("series"))
    sums = draws.groupBy("h", "series").agg((F.median(v) if median else F.avg(v)).alias("forecast"), F.stddev_samp(v).alias("se"), F.percentile(v, level / 2).alias("lower"), F.percentile(v, 1 - level / 2).alias("upper"), F.sort_array(F.collect_list(v)).alias("__all"))
    sums = sums.withColumn("__h", last)

    def quantile(p):  # linear between order statistics, like percentile, which takes constants only
        at = p * (F.size("__all") - 1)
        low = F.floor(at)
        a, b = F.element_at("__all", (low + 1).cast("int")), F.element_at("__all", F.least(low + 2, F.size("__all")).cast("int"))
        return a + (b - a) * (at - low)

    tail = F.lit(level / 2) / F.col("__h")
    return sums.select("h", "series", "forecast", "se", "lower", "upper", quantile(tail).alias("lower_joint"), quantile(1 - tail).alias("upper_joint"))
