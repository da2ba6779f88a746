"""Vector autoregressions by least squares."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.design import CONST, Lags, with_design
from vectide.functions.special import t_two_sided
from vectide.operators.gram import Gram, gram
from vectide.sources.series import SeriesFrame


def solve(g: Gram, method: str = "nor") -> np.ndarray:
    """Coefficients from a Gram matrix, by its inverse or by its Cholesky factor; with a constant, from the centred sums."""
    if method not in ("nor", "chol"):
        raise ValueError(f"unknown method {method}")

    def solved(a, b):
        if method == "nor":
            return np.linalg.solve(a, b)
        c = np.linalg.cholesky(a)
        return np.linalg.solve(c.T, np.linalg.solve(c, b))

    if g.core is None:
        return solved(g.xx, g.xy)
    k = len(g.xx) - 1
    slopes = solved(g.core[:k, :k], g.core[:k, k:])
    return np.vstack([slopes, g.means[k:] - g.means[:k] @ slopes])


def residual_products(g: Gram, b: np.ndarray) -> np.ndarray:
    """Cross products of the residuals at least squares coefficients, without a second pass over the rows."""
    xx, xy, yy = g.xx, g.xy, g.yy
    if g.core is not None:
        k = len(g.xx) - 1
        xx, xy, yy, b = g.core[:k, :k], g.core[:k, k:], g.core[k:, k:], b[:k]
    return yy - b.T @ xy - xy.T @ b + b.T @ xx @ b


#: Triangles that one task reduces to one.
QR_FAN = 16


def solve_qr(design: DataFrame, xs: list[str], ys: list[str], fan: int = QR_FAN) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual cross products by tall-skinny QR: each task reduces its rows to one triangle, and rounds of
    tasks reduce ``fan`` triangles to one until one is left, which is all that the driver gets."""
    cols, k = [*xs, *ys], len(xs)
    m, kind = len(cols), "part long, r array<double>"

    def run(batches):
        from pyspark import TaskContext

        r = np.empty((0, m))
        for b in batches:
            z = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(m)])
            r = np.linalg.qr(np.vstack([r, z]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, m)) for x in pdf.sort_values("part")["r"]]), mode="r")
        return pd.DataFrame({"part": [int(pdf["part"].min()) // fan], "r": [r.ravel()]})

    triangles = design.select(*cols).mapInArrow(run, kind)
    # the design is shuffled by blocks, so it has so many tasks at most
    tasks = max(int(design.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    while tasks > 1:
        triangles = triangles.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up").applyInPandas(reduced, kind)
        tasks = -(-tasks // fan)
    rows = triangles.orderBy("part").toArrow()["r"].to_pylist()  # one, unless a session made more tasks than it was set to
    r = np.linalg.qr(np.vstack([np.reshape(x, (-1, m)) for x in rows]), mode="r")
    return np.linalg.solve(r[:k, :k], r[:k, k:]), r[k:, k:].T @ r[k:, k:]


@dataclass(frozen=True)
class VarModel:
    """What any fitted autoregression of this package has: coefficients (regressors by responses) and a covariance."""

    names: tuple[str, ...]
    lags: Lags
    coef: np.ndarray
    sigma: np.ndarray
    n: int

    @property
    def dim(self) -> int:
        return len(self.names)

    @property
    def k(self) -> int:
        return len(self.coef)

    @property
    def terms(self) -> list[str]:
        return self.lags.terms(self.names)

    @cached_property
    def lag_coef(self) -> np.ndarray:
        """Coefficients on the plain lags 1..order (and the constant): those of a HAR design spread over its lags."""
        return self.lags.transform(self.dim).T @ self.coef

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """term, part, predictor, response, estimate."""
        rows = []
        for i, term in enumerate(self.terms):
            part, predictor = (None, CONST) if term == CONST else (term.rpartition("_")[2], term.rpartition("_")[0])
            rows += [(term, part, predictor, y, float(self.coef[i, j])) for j, y in enumerate(self.names)]
        return spark.createDataFrame(rows, "term string, part string, predictor string, response string, estimate double")

    def with_fitted(self, sf: SeriesFrame) -> DataFrame:
        """t, and for each variable its fitted value and residual, as column expressions over the design."""
        design = with_design(sf, self.lags)
        out = [F.col(c) for c in (*sf.panel, "t")]
        for j, y in enumerate(self.names):
            fit = sum((F.col(t) * float(self.coef[i, j]) for i, t in enumerate(self.terms)), F.lit(0.0))
            out += [fit.alias(f"fitted_{y}"), (F.col(y) - fit).alias(f"residual_{y}")]
        return design.select(*out)


@dataclass(frozen=True)
class OlsModel(VarModel):
    gram: Gram
    rss: np.ndarray  # cross products of the residuals
    method: str = "nor"


def from_gram(g: Gram, names: tuple[str, ...], lags: Lags, method: str = "nor", fitted: tuple[np.ndarray, np.ndarray] | None = None) -> OlsModel:
    """``fitted``: coefficients and residual cross products, if they do not come from the sums."""
    k = len(g.xx)
    if g.n <= k:
        raise ValueError(f"{g.n} usable rows are too few for {k} coefficients")
    b, rss = fitted or (b := solve(g, method), residual_products(g, b))
    return OlsModel(names, lags, b, rss / (g.n - k), int(g.n), g, rss, method)


def fit_ols(sf: SeriesFrame, lags: Lags, method: str = "nor") -> OlsModel:
    """VAR (``Lags(p)``) or VHAR (``Lags(har=(week, month))``) by ``nor``, ``chol`` or ``qr``."""
    design = with_design(sf.single().doubles(), lags)
    xs, ys = lags.terms(sf.names), list(sf.names)
    g = gram(design, xs, ys)
    if method != "qr":
        return from_gram(g, sf.names, lags, method)
    if g.n <= len(xs):
        raise ValueError(f"{g.n} usable rows are too few for {len(xs)} coefficients")
    return from_gram(g, sf.names, lags, method, solve_qr(design, xs, ys))


def var_lm(sf: SeriesFrame, p: int = 1, include_mean: bool = True, method: str = "nor") -> OlsModel:
    return fit_ols(sf, Lags(p, None, include_mean), method)


def vhar_lm(sf: SeriesFrame, har: tuple[int, int] = (5, 22), include_mean: bool = True, method: str = "nor") -> OlsModel:
    return fit_ols(sf, Lags(1, tuple(har), include_mean), method)


def fit_panel(sf: SeriesFrame, lags: Lags) -> DataFrame:
    """One least squares model for each member of a panel: its keys, n, coef (terms by responses, row by row) and sigma. Members
    are reduced to moments by one aggregate and solved side by side; members with too few rows have null coefficients."""
    from vectide.operators.moments import Moments, least_squares, panel_moments

    m, const = sf.dim, lags.include_mean
    k, panel = lags.k(m) - const, list(sf.panel)

    def run(batches):
        for pdf in batches:
            p = k + m
            g = Moments(pdf["n"].to_numpy(), np.stack(pdf["mean"].to_numpy()).reshape(-1, p), np.stack(pdf["core"].to_numpy()).reshape(-1, p, p)) if len(pdf) else None
            enough = pdf["n"].to_numpy() > k + const
            coef, sigma = [None] * len(pdf), [None] * len(pdf)
            for i in np.flatnonzero(enough):
                b, s = least_squares(g[[i]], k, const)
                coef[i], sigma[i] = b[0].ravel(), s[0].ravel()
            yield pdf[panel].assign(n=pdf["n"].astype("int64"), coef=coef, sigma=sigma)

    return panel_moments(sf, lags).mapInPandas(run, f"{sf.panel_schema}n long, coef array<double>, sigma array<double>")


def panel_coefficients(fits: DataFrame, sf: SeriesFrame, lags: Lags) -> DataFrame:
    """The panel keys, term, response, estimate of :func:`fit_panel`."""
    terms, m = lags.terms(sf.names), sf.dim
    name = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    at = fits.select(*sf.panel, F.posexplode("coef").alias("__i", "estimate"))
    return at.select(*sf.panel, name(terms, F.floor(F.col("__i") / m)).alias("term"), name(sf.names, F.col("__i") % m).alias("response"), "estimate")


def infer(model: OlsModel, spark: SparkSession) -> DataFrame:
    """term, response, estimate, std_error, statistic, p_value of each coefficient."""
    inv = model.gram.inverse()
    se = np.sqrt(np.outer(np.diag(inv), np.diag(model.sigma)))
    df = model.n - model.k
    rows = [(t, y, float(model.coef[i, j]), float(se[i, j]), float(model.coef[i, j] / se[i, j]), t_two_sided(float(model.coef[i, j] / se[i, j]), df)) for j, y in enumerate(model.names) for i, t in enumerate(model.terms)]
    return spark.createDataFrame(rows, "term string, response string, estimate double, std_error double, statistic double, p_value double")


@dataclass(frozen=True)
class Summary:
    coefficients: DataFrame
    correlation: np.ndarray
    roots: np.ndarray
    is_stable: bool
    log_lik: float
    aic: float
    bic: float
    hq: float


def summary(model: OlsModel, spark: SparkSession) -> Summary:
    from vectide.operators import criteria, structure

    sd = np.sqrt(np.diag(model.sigma))
    roots = structure.stable_roots(model)
    return Summary(infer(model, spark), model.sigma / np.outer(sd, sd), roots, bool((roots < 1).all()), criteria.log_lik(model), criteria.aic(model), criteria.bic(model), criteria.hq(model))
