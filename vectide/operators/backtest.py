"""Rolling and expanding re-estimation. The moments of windows are merged from those of neighbouring stretches (see moments), so
T rows cost O(T k^2) and not O(windows * rows * k^2), and nothing large is subtracted; blocks of a long series run as separate
tasks with a halo of one window, and members of a panel apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.design import Lags
from vectide.operators.forecast import path
from vectide.operators.gram import Gram
from vectide.operators.moments import Estimator, Moments, heads, least_squares, running, stretches, with_prior
from vectide.operators.ols import from_gram
from vectide.operators.structure import connectedness
from vectide.sources.series import SeriesFrame

BLOCK_WINDOWS = 20_000
#: Blocks whose sums one task merges (see moments.running).
FAN = 1_024
FORECAST_ROWS = "window long, t long, series string, forecast double"


def design_arrays(y: np.ndarray, lags: Lags) -> tuple[np.ndarray, np.ndarray]:
    """X and Y of a dense series, in the order of the regressors of ``lags``."""
    n, q = len(y), lags.order
    if n <= q:
        raise ValueError(f"{n} rows are too few for {q} lags")
    if lags.har:
        sums = np.vstack([np.zeros(y.shape[1]), np.cumsum(y, axis=0)])
        at = np.arange(q, n)
        parts = [(sums[at] - sums[at - w]) / w for w in (1, *lags.har)]
        parts[0] = y[q - 1 : n - 1]
    else:
        parts = [y[q - i : n - i] for i in range(1, q + 1)]
    x = np.column_stack([*parts, np.ones(n - q)] if lags.include_mean else parts)
    return x, y[q:]


def fit_arrays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x, x.T @ y)


def conjugate_estimator(prior: Gram) -> Estimator:
    """Posterior mean under dummy observations, and the mean of the inverse Wishart."""
    shape = prior.n - len(prior.xx) + 2

    def estimate(g: Moments, k: int, const: bool):
        b, scale, _ = with_prior(g, k, const, prior)
        return b, scale / np.maximum(shape + np.asarray(g.n) - scale.shape[-1] - 1, 1)[..., None, None]

    return estimate


def flat_estimator(prior_prec: np.ndarray) -> Estimator:
    """Posterior under a flat prior with precision ``prior_prec``."""

    def estimate(g: Moments, k: int, const: bool):
        m = g.mean.shape[-1] - k
        b, scale, _ = with_prior(g, k, const, Gram(prior_prec, np.zeros((len(prior_prec), m)), np.zeros((m, m)), 0))
        return b, scale / np.maximum(np.asarray(g.n) - 2 * m - 2, 1)[..., None, None]

    return estimate


def design_rows(y: np.ndarray, lags: Lags) -> np.ndarray:
    """(regressors without constant, responses) of a dense series."""
    x, r = design_arrays(y, lags)
    return np.hstack([x[:, : x.shape[1] - lags.include_mean], r])


@dataclass(frozen=True)
class Windows:
    """Windows of one task: their last rows (``ends``), moments, the ``order`` rows up to the end and the rows ahead of it."""

    ends: np.ndarray
    moments: Moments
    last: np.ndarray
    ahead: np.ndarray


def _emitted(parts: list[pd.DataFrame], pdf: pd.DataFrame, panel: list[str], columns: list[str]) -> pd.DataFrame:
    parts = [p for p in parts if len(p)]
    out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
    return out.assign(**{c: [pdf[c].iat[0]] * len(out) for c in panel})[[*panel, *columns]]


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _doubles(sf: SeriesFrame) -> DataFrame:
    return sf.df.select(*sf.panel, "t", *[F.col(c).cast("double").alias(c) for c in sf.names])


def rolling(sf: SeriesFrame, lags: Lags, window: int, emit: Callable[[Windows], pd.DataFrame], schema: str, first: int | None = None, last: int | None = None, ahead: int = 0) -> DataFrame:
    """Hand the windows of ``window`` rows that end at t in first..last, and have ``ahead`` rows after them, to ``emit``, some at a
    time; the result has the panel keys before the columns of ``schema``."""
    names, panel, q = list(sf.names), list(sf.panel), lags.order
    if window <= q + lags.k(sf.dim):
        raise ValueError("the window is too short for the model")
    lo = window if first is None else first
    size = max(BLOCK_WINDOWS, window)
    # a row serves the windows that end in t - ahead .. t + window - 1
    own = F.greatest(F.floor((F.col("t") - ahead - 1) / size), F.lit((lo - 1) // size))
    reach = F.floor((F.col("t") + window - 2) / size)
    if last is None and not panel:
        last = sf.df.agg(F.max("t")).first()[0] or 0
    if last is not None:
        reach = F.least(reach, F.lit((last - 1) // size))
    rows = _doubles(sf).filter(own <= reach).withColumn("block", F.explode(F.sequence(own, reach)))
    columns = _columns(schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, y, block = pdf["t"].to_numpy(), pdf[names].to_numpy(dtype=float), int(pdf["block"].iat[0])
        # stretches begin at a block's first window, whatever the first one asked for: results do not depend on it
        from_, to = max(block * size + 1, int(t[0]) + window - 1), min((block + 1) * size, int(t[-1]) - ahead, int(t[-1]) if last is None else last)
        if to < max(from_, lo):
            return _emitted([], pdf, panel, columns)
        at = from_ - window + 1 - t[0]  # the first window's first row
        y = y[at : to + ahead + 1 - t[0]]
        z, out = design_rows(y, lags), []
        for a, g in stretches(z[: len(z) - ahead], window - q):
            early = max(0, lo - from_ - a)
            if early >= len(g.n):
                continue
            ends = from_ + a + np.arange(early, len(g.n))
            e = ends - from_ + window - 1
            out.append(emit(Windows(ends, g[early:], y[e[:, None] + np.arange(1 - q, 1)], y[e[:, None] + np.arange(1, ahead + 1)])))
        return _emitted(out, pdf, panel, columns)

    return rows.groupBy(*panel, "block").applyInPandas(run, sf.panel_schema + schema)


def expanding(sf: SeriesFrame, lags: Lags, n_train: int, emit: Callable[[Windows], pd.DataFrame], schema: str, n_total: int, ahead: int = 0) -> DataFrame:
    """As :func:`rolling`, for windows that start at the first row and end at t in n_train..n_total - ahead. A block of rows goes
    on from the moments of all blocks before it, which are merged in levels."""
    names, panel, q, size = list(sf.names), list(sf.panel), lags.order, max(BLOCK_WINDOWS, lags.order + 1)
    k, m = lags.k(sf.dim) - lags.include_mean, sf.dim
    own, until = F.floor((F.col("t") - 1) / size), F.lit((n_total - 1) // size)
    from_before, for_after = (F.col("t") - 1) % size >= size - q, (F.col("t") - 1) % size < ahead
    copies = F.array_distinct(F.array(F.when(for_after, F.greatest(own - 1, F.lit(0))).otherwise(own), own, F.least(F.when(from_before, own + 1).otherwise(own), until)))
    rows = _doubles(sf).filter(F.col("t") <= n_total).withColumn("block", F.explode(copies))
    columns = _columns(schema)

    def own_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
        """All values of a block, its design rows, their first t, and the first t of the values."""
        pdf = pdf.sort_values("t")
        t, y, block = pdf["t"].to_numpy(), pdf[names].to_numpy(dtype=float), int(pdf["block"].iat[0])
        stop = int(min(t[-1], (block + 1) * size)) + 1 - t[0]
        z = design_rows(y[:stop], lags) if stop > q else np.empty((0, k + m))
        return y, z, int(t[0]) + q, int(t[0])

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        _, z, _, _ = own_rows(pdf)
        g = Moments.of(z) if len(z) else Moments.none(k + m)
        return pdf[[*panel, "block"]].iloc[:1].assign(flat=[g.flat()])

    def run(pdf: pd.DataFrame, start: Moments) -> pd.DataFrame:
        y, z, t0, y0 = own_rows(pdf)
        out = []
        if len(z):
            g = start.merge(heads(z))
            ends = t0 + np.arange(len(z))
            use = (ends >= n_train) & (ends <= n_total - ahead) & (ends + ahead <= y0 + len(y) - 1)
            if use.any():
                e = ends[use] - y0
                out.append(emit(Windows(ends[use], g[use], y[e[:, None] + np.arange(1 - q, 1)], y[e[:, None] + np.arange(1, ahead + 1)])))
        return _emitted(out, pdf, panel, columns)

    kinds, blocks, keys = sf.panel_schema, -(-n_total // size), [*panel, "block"]
    if blocks == 1:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: run(pdf, Moments.none(k + m)), kinds + schema)
    parts = rows.groupBy(*keys).applyInPandas(totals, f"{kinds}block long, flat array<double>")
    before = running(parts, panel, kinds, k + m, FAN, blocks)

    def from_before_on(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, Moments.from_flat(np.asarray(states["flat"].iat[0], dtype=float), k + m))

    return rows.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(from_before_on, kinds + schema)


def _h_step(sf: SeriesFrame, lags: Lags, h: int, first: int, estimate: Estimator):
    names, m, k = list(sf.names), sf.dim, lags.k(sf.dim) - lags.include_mean
    to_lags = lags.transform(m).T

    def emit(w: Windows):
        b, _ = estimate(w.moments, k, lags.include_mean)
        f = path(to_lags @ b, w.last, lags.order, h)[:, -1] if len(w.ends) else np.empty((0, m))
        return pd.DataFrame({"window": np.repeat(w.ends - first, m), "t": np.repeat(w.ends + h, m), "series": names * len(w.ends), "forecast": f.ravel()})

    return emit


def forecast_roll(sf: SeriesFrame, lags: Lags, n_train: int, h: int, n_total: int | None = None, estimator: Estimator = least_squares) -> DataFrame:
    """window, t, series, forecast: the h-step forecast of every window of ``n_train`` rows whose target lies in the table of
    ``n_total`` rows (training rows followed by test rows; None: all rows). Members of a panel apart, keys first."""
    return rolling(sf, lags, n_train, _h_step(sf, lags, h, n_train, estimator), FORECAST_ROWS, n_train, None if n_total is None else n_total - h, h)


def forecast_expand(sf: SeriesFrame, lags: Lags, n_train: int, h: int, n_total: int, estimator: Estimator = least_squares) -> DataFrame:
    """As :func:`forecast_roll`, with windows that start at the first row."""
    return expanding(sf, lags, n_train, _h_step(sf, lags, h, n_train, estimator), FORECAST_ROWS, n_total, h)


def dynamic_spillover(sf: SeriesFrame, lags: Lags, window: int, step: int = 10, estimator: Estimator = least_squares) -> DataFrame:
    """t_end, series, shock, spillover: a table of connectedness for every window of ``window`` rows."""
    names, to_lags, k = list(sf.names), lags.transform(sf.dim).T, lags.k(sf.dim) - lags.include_mean
    m = len(names)

    def emit(w: Windows):
        tables = [connectedness(to_lags @ x, z, lags.order, step).ravel() for x, z in zip(*estimator(w.moments, k, lags.include_mean), strict=True)]
        return pd.DataFrame({"t_end": np.repeat(w.ends, m * m), "series": [a for a in names for _ in names] * len(w.ends), "shock": names * (m * len(w.ends)), "spillover": np.concatenate(tables) if tables else np.empty(0)})

    return rolling(sf, lags, window, emit, "t_end long, series string, shock string, spillover double")


def dynamic_spillover_conjugate(sf: SeriesFrame, lags: Lags, prior: Gram, window: int, step: int = 10, n_iter: int = 100, seed: int = 1) -> DataFrame:
    """t_end, series, shock, spillover (posterior mean), sd, lower, upper (95 %) of a conjugate model refitted on every window
    under the dummy observations ``prior``; each window's draws depend on its end only."""
    from vectide.operators.niw import draw_iw, draw_mn

    names, to_lags, k = list(sf.names), lags.transform(sf.dim).T, lags.k(sf.dim) - lags.include_mean
    m, shape0 = len(names), prior.n - len(prior.xx) + 2

    def emit(w: Windows):
        parts = []
        for end, n, mean, scale, prec in zip(w.ends, w.moments.n, *with_prior(w.moments, k, lags.include_mean, prior), strict=True):
            rng = np.random.default_rng([seed, int(end)])
            sigmas = draw_iw(scale, shape0 + n, n_iter, rng)
            tables = np.array([connectedness(to_lags @ x, z, lags.order, step).ravel() for x, z in zip(draw_mn(mean, prec, sigmas, rng), sigmas, strict=True)])
            low, high = np.quantile(tables, [0.025, 0.975], axis=0)
            parts.append(pd.DataFrame({"t_end": end, "series": np.repeat(names, m), "shock": names * m, "spillover": tables.mean(axis=0), "sd": tables.std(axis=0, ddof=1), "lower": low, "upper": high}))
        return pd.concat(parts) if parts else pd.DataFrame()

    return rolling(sf, lags, window, emit, "t_end long, series string, shock string, spillover double, sd double, lower double, upper double")


WINDOW_ROWS = "window long, moments array<double>, last array<double>, ahead array<double>"


def window_moments(sf: SeriesFrame, lags: Lags, n_train: int, h: int, n_total: int, grow: bool = False, first: int = 0) -> DataFrame:
    """A row for each window from number ``first`` on: its moments, its last rows and the ``h`` rows ahead of it, flat. This is all
    that sampling a window needs, so no row of the series is copied to windows."""

    def emit(w: Windows):
        return pd.DataFrame({"window": w.ends - n_train, "moments": list(w.moments.flat()), "last": list(w.last.reshape(len(w.ends), -1)), "ahead": list(w.ahead.reshape(len(w.ends), -1))})

    if grow:
        return expanding(sf, lags, n_train + first, emit, WINDOW_ROWS, n_total, h)
    return rolling(sf, lags, n_train, emit, WINDOW_ROWS, n_train + first, n_total - h, h)


def window_model(sf: SeriesFrame, lags: Lags, end: int, window: int):
    """The model of one window, refitted from its rows: what the running sums must agree with."""
    rows = sf.single().df.filter(F.col("t").between(end - window + 1, end)).orderBy("t").toPandas()[list(sf.names)].to_numpy(dtype=float)
    x, y = design_arrays(rows, lags)
    return from_gram(Gram.of(x, y, lags.include_mean), sf.names, lags)

