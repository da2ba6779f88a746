"""Bayesian autoregressions by Gibbs sampling.

Constant variances: Spark reduces the design to moments (of the series, of each member of a panel, of each window), and a task
that samples a chain gets these numbers only. Stochastic volatility needs the rows: a chain in memory is one task, and
``volatility.fit_long`` samples series of any length by stretches. Random numbers depend on keys only, never on the
partitioning. Panels: keys come before the other columns of all results.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.design import Lags, with_design
from vectide.operators.backtest import design_arrays, window_moments
from vectide.operators.gibbs import run_chain, run_moments, sampler_of
from vectide.operators.gram import gram
from vectide.operators.moments import Moments, panel_moments
from vectide.operators.niw import DRAWS, draws_frame
from vectide.operators.priors import BayesSpec, StochasticVolatility
from vectide.operators.structure import connectedness, fevd_last, vma
from vectide.sources.series import SeriesFrame

BLOCK_DRAWS = 500
#: Tasks that windows and chains are dealt to at most; a row is copied once for each task that needs it.
WINDOW_TASKS = 4_000
#: Draws at a date whose tables are made at once.
DATES = 2_000


@dataclass(frozen=True)
class BayesFit:
    """``draws``: chain, iteration, param, idx, value, lazily sampled (persist or write it before using it twice)."""

    names: tuple[str, ...]
    lags: Lags
    spec: BayesSpec
    draws: DataFrame
    panel: tuple[str, ...] = ()

    def with_draws(self, draws: DataFrame) -> BayesFit:
        return replace(self, draws=draws)

    def single(self) -> BayesFit:
        if self.panel:
            raise ValueError(f"a panel by {', '.join(self.panel)}: filter the draws of one member")
        return self


def _values(sf: SeriesFrame) -> DataFrame:
    return sf.df.select(*sf.panel, "t", *[F.col(c).cast("double").alias(c) for c in sf.names])


def seed_of(*keys) -> list[int]:
    """Numbers that stand for the keys of a panel member in a seed."""
    return [zlib.crc32(repr(k).encode()) for k in keys]


def series_moments(sf: SeriesFrame, lags: Lags) -> Moments:
    """Of the design of a single series, from one pass."""
    with_const = replace(lags, include_mean=True)
    return Moments.from_gram(gram(with_design(sf.single().doubles(), with_const), with_const.terms(sf.names), list(sf.names)))


def fit_bayes(sf: SeriesFrame, lags: Lags, spec: BayesSpec | None = None) -> BayesFit:
    spec, names, panel = spec or BayesSpec(), list(sf.names), list(sf.panel)
    sampler, spark = sampler_of(spec.prior), sf.df.sparkSession
    p = (len(lags.parts) + 1) * sf.dim
    if isinstance(spec.cov, StochasticVolatility):
        rows = _values(sf).withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(spec.chains))))

        def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
            chain, keys = int(pdf["chain"].iat[0]), [pdf[c].iat[0] for c in panel]
            x, y = design_arrays(pdf.sort_values("t")[names].to_numpy(), lags)
            out = draws_frame(chain, 1, run_chain(x, y, lags, spec, np.random.default_rng([spec.seed, 0, chain, *seed_of(*keys)]), sampler))
            return out.assign(**dict(zip(panel, keys, strict=True)))[[*panel, *out.columns]]

        return BayesFit(sf.names, lags, spec, rows.groupBy(*panel, "chain").applyInPandas(rows_of, sf.panel_schema + DRAWS), sf.panel)

    if panel:
        sums = panel_moments(sf, lags)
    else:
        g = series_moments(sf, lags)
        if g.n < 2:
            raise ValueError(f"{g.n:.0f} usable rows are too few")
        sums = spark.createDataFrame([(float(g.n), g.mean.tolist(), g.core.ravel().tolist())], "n double, mean array<double>, core array<double>")
    tasks = sums.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(spec.chains)))).repartition(spec.chains if not panel else int(spark.conf.get("spark.sql.shuffle.partitions")), *panel, "chain")

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                keys = [row[c] for c in panel]
                g = Moments(np.float64(row["n"]), np.asarray(row["mean"]), np.asarray(row["core"]).reshape(p, p))
                out = draws_frame(row["chain"], 1, run_moments(g, lags, spec, np.random.default_rng([spec.seed, 0, row["chain"], *seed_of(*keys)]), sampler=sampler))
                yield out.assign(**{c: [k] * len(out) for c, k in zip(panel, keys, strict=True)})[[*panel, *out.columns]]

    return BayesFit(sf.names, lags, spec, tasks.mapInPandas(run, sf.panel_schema + DRAWS), sf.panel)


def var_bayes(sf: SeriesFrame, p: int = 1, spec: BayesSpec | None = None, include_mean: bool = True) -> BayesFit:
    return fit_bayes(sf, Lags(p, None, include_mean), spec)


def vhar_bayes(sf: SeriesFrame, har: tuple[int, int] = (5, 22), spec: BayesSpec | None = None, include_mean: bool = True) -> BayesFit:
    return fit_bayes(sf, Lags(1, tuple(har), include_mean), spec)


class Draws:
    """Arrays of a block of draws: lag coefficients, impacts and scales."""

    def __init__(self, values: dict[str, np.ndarray], lags: Lags, dim: int, sparse: bool = False):
        alpha = values["alpha_sparse" if sparse else "alpha"]
        self.n, self.dim, self.lags = len(alpha), dim, lags
        coef = np.swapaxes(alpha.reshape(self.n, dim, -1), 1, 2)
        if lags.include_mean:
            coef = np.concatenate([coef, values["c"][:, None]], axis=1)
        self.lag_coef = lags.transform(dim).T @ coef
        self.low = np.repeat(np.eye(dim)[None], self.n, axis=0)
        r, c = np.tril_indices(dim, -1)
        self.low[:, r, c] = values["a_sparse" if sparse else "a"] if len(r) else np.empty((self.n, 0))
        self.log_vol = values["h"].reshape(self.n, -1, dim) if "h" in values else None
        self.walk = np.sqrt(values["sigh"]) if "h" in values else None
        self.scale = np.sqrt(values["d"]) if "d" in values else None

    def stable(self) -> np.ndarray:
        from vectide.operators.structure import companion

        roots = [np.abs(np.linalg.eigvals(companion(b, self.dim, self.lags.order))).max() for b in self.lag_coef]
        return np.array(roots) < 1

    def covariances(self, t: int | None = None) -> np.ndarray:
        """Of each draw; with stochastic volatility at row ``t``, or with the mean scales over all rows."""
        if self.scale is not None:
            s = self.scale
        else:
            s = np.exp(self.log_vol / 2).mean(axis=1) if t is None else np.exp(self.log_vol[:, t] / 2)
        root = np.linalg.solve(self.low, np.eye(self.dim) * s[:, None, :])
        return root @ np.swapaxes(root, 1, 2)

    def simulate(self, last: np.ndarray, n_ahead: int, rng: np.random.Generator, use_sv: bool = True, actual: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Predictive paths (draws, n_ahead, dim), and the log predictive densities (draws, n_ahead) of ``actual`` rows."""
        m, q = self.dim, self.lags.order
        state = np.repeat(np.concatenate(last[::-1])[None], self.n, axis=0)
        h = None if self.log_vol is None else self.log_vol[:, -1].copy()
        out, lpd = np.empty((self.n, n_ahead, m)), None if actual is None else np.empty((self.n, n_ahead))
        for s in range(n_ahead):
            mean = (state[:, None] @ self.lag_coef[:, : m * q])[:, 0] + self.lag_coef[:, m * q :].sum(axis=1)
            if h is not None and use_sv:
                h = h + self.walk * rng.standard_normal((self.n, m))
            scale = self.scale if h is None else np.exp(h / 2)
            noise = scale * rng.standard_normal((self.n, m))
            out[:, s] = mean + np.linalg.solve(self.low, noise[..., None])[..., 0]
            if lpd is not None:
                v = (self.low @ (actual[s] - mean)[..., None])[..., 0] / scale
                lpd[:, s] = -m / 2 * np.log(2 * np.pi) - np.log(scale).sum(axis=1) - 0.5 * (v**2).sum(axis=1)
            state = np.concatenate([out[:, s], state[:, :-m]], axis=1)
        return out, lpd


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Arrays (draw, idx) by parameter from the long form of whole draws."""
    pdf = pdf.sort_values(["param", "chain", "iteration", "idx"])
    return {name: g["value"].to_numpy().reshape(len(g) // int(g["idx"].max()), -1) for name, g in pdf.groupby("param")}


def _blocks(draws: DataFrame) -> DataFrame:
    return draws.withColumn("block", F.floor((F.col("iteration") - 1) / BLOCK_DRAWS))


def _zeroed(fit: BayesFit, level: float) -> np.ndarray:
    """Which coefficients have a credible interval of ``level`` that holds zero: one flag for each, on the driver."""
    from vectide.operators.posterior import select_by_interval

    flags = select_by_interval(fit.draws.filter("param = 'alpha'"), level).select("idx", "selected").collect()
    out = np.zeros(max(r["idx"] for r in flags), dtype=bool)
    for r in flags:
        out[r["idx"] - 1] = not r["selected"]
    return out


def stable_draws(fit: BayesFit) -> DataFrame:
    """chain, iteration, stable of each draw."""
    names, lags = fit.names, fit.lags

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[["chain", "iteration"]].drop_duplicates().sort_values(["chain", "iteration"]).reset_index(drop=True)
        return ids.assign(stable=Draws(_arrays(pdf), lags, len(names)).stable())

    return _blocks(fit.draws).groupBy("chain", "block").applyInPandas(run, "chain int, iteration int, stable boolean")


def predict(fit: BayesFit, sf: SeriesFrame, n_ahead: int, sparse: bool | float = False, stable: bool = False, use_sv: bool = True, seed: int = 1) -> DataFrame:
    """Predictive draws: h, draw, series, value, in blocks of draws. ``sparse`` uses the thresholded coefficients, or, as a
    number, sets those to zero whose credible interval of that level holds zero. ``stable`` drops explosive draws, and
    raises an error if no other is left; both of these read the draws once more."""
    from vectide.operators.forecast import PREDICTIVE, _predictive

    last, names, lags = np.array(sf.last_rows(fit.lags.order)), fit.single().names, fit.lags
    zero = _zeroed(fit, sparse) if not isinstance(sparse, bool) else None
    if stable and stable_draws(fit).filter("stable").isEmpty():
        raise ValueError("no draw is stable")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain, block = int(pdf["chain"].iat[0]), int(pdf["block"].iat[0])
        values = _arrays(pdf)
        if zero is not None:
            values["alpha"] = np.where(zero, 0.0, values["alpha"])
        d = Draws(values, lags, len(names), sparse is True)
        y, _ = d.simulate(last, n_ahead, np.random.default_rng([seed, 1, chain, block]), use_sv)
        if stable:
            y = y[d.stable()]
        return _predictive(n_ahead, (chain - 1) * 10_000_000 + block * BLOCK_DRAWS + 1, y, names)

    return _blocks(fit.draws).groupBy("chain", "block").applyInPandas(run, PREDICTIVE)


def spillover_draws(fit: BayesFit, step: int = 10, sparse: bool = False, times: list[int] | range | None = None) -> DataFrame:
    """chain, iteration, t, series, shock, spillover of each draw. ``times``: design rows (from 0) of a stochastic volatility
    model, each of which has its own covariance; without, t is -1 and scales are means over all rows."""
    names, lags = fit.single().names, fit.lags
    m, schema = len(names), "chain int, iteration int, t long, series string, shock string, spillover double"

    def long(pdf: pd.DataFrame, tables: np.ndarray) -> pd.DataFrame:
        n = m * m
        return pd.DataFrame({"chain": np.repeat(pdf["chain"].to_numpy(np.int32), n), "iteration": np.repeat(pdf["iteration"].to_numpy(np.int32), n), "t": np.repeat(pdf["t"].to_numpy(np.int64), n), "series": list(np.repeat(names, m)) * len(pdf), "shock": list(names) * (m * len(pdf)), "spillover": tables.ravel()})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = Draws(_arrays(pdf), lags, m, sparse)
        ids = pdf[["chain", "iteration"]].drop_duplicates().sort_values(["chain", "iteration"]).assign(t=-1)
        return long(ids, np.array([connectedness(b, s, lags.order, step) for b, s in zip(d.lag_coef, d.covariances(), strict=True)]))

    if times is None:
        return _blocks(fit.draws).groupBy("chain", "block").applyInPandas(run, schema)

    # a draw's moving-average form serves all its dates: it meets them in a join, a date being the m scales of one draw
    def forms(pdf: pd.DataFrame) -> pd.DataFrame:
        d = Draws(_arrays(pdf), lags, m, sparse)
        ids = pdf[["chain", "iteration"]].drop_duplicates().sort_values(["chain", "iteration"])
        return ids.assign(form=[vma(b, m, lags.order, step - 1).ravel() for b in d.lag_coef], low=[x.ravel() for x in d.low])

    used = ["alpha_sparse" if sparse else "alpha", "c", "a_sparse" if sparse else "a"]
    draws = fit.draws
    of_draw = _blocks(draws.filter(F.col("param").isin(used))).groupBy("chain", "block").applyInPandas(forms, "chain int, iteration int, form array<double>, low array<double>")
    at, j = F.floor((F.col("idx") - 1) / m).cast("long"), (F.col("idx") - 1) % m
    low, high = min(times, default=0), max(times, default=-1)
    wanted = F.col("t").between(low, high) if len(set(times)) == high - low + 1 else F.col("t").isin(list(times))
    scales = draws.filter("param = 'h'").groupBy("chain", "iteration", at.alias("t")).agg(*[F.max(F.when(j == i, F.exp(F.col("value") / 2))).alias(f"s{i}") for i in range(m)]).filter(wanted)

    def dated(batches):
        for pdf in batches:
            for a in range(0, len(pdf), DATES):
                part = pdf.iloc[a : a + DATES]
                low = np.stack(part["low"].to_numpy()).reshape(-1, m, m)
                root = np.linalg.solve(low, np.eye(m) * part[[f"s{i}" for i in range(m)]].to_numpy()[:, None, :])
                w = np.stack(part["form"].to_numpy()).reshape(-1, step, m, m)
                yield long(part, 100 * fevd_last(w, root @ np.swapaxes(root, 1, 2)))

    return scales.join(of_draw, ["chain", "iteration"]).mapInPandas(dated, schema)


def spillover_summary(draws: DataFrame, level: float = 0.05) -> DataFrame:
    """t, series, shock, spillover (mean), sd, lower, upper."""
    v = F.col("spillover")
    return draws.groupBy("t", "series", "shock").agg(F.avg(v).alias("spillover"), F.stddev_samp(v).alias("sd"), F.percentile(v, level / 2).alias("lower"), F.percentile(v, 1 - level / 2).alias("upper"))


def spillover_margins(draws: DataFrame, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Posterior mean, sd and interval of what each series sends, gets, its net and the total (t, series, measure, value, sd,
    lower, upper), and of net pairs (t, series, shock, net, sd, lower, upper), from spillover_draws."""
    keys = ["chain", "iteration", "t"]
    n = draws.select("series").distinct().count()
    v = F.col("value")
    stats = [F.avg(v).alias("value"), F.stddev_samp(v).alias("sd"), F.percentile(v, level / 2).alias("lower"), F.percentile(v, 1 - level / 2).alias("upper")]
    cross = draws.filter("series <> shock")
    both = cross.select(*keys, "series", F.lit(0.0).alias("to"), F.col("spillover").alias("from")).union(cross.select(*keys, "shock", "spillover", F.lit(0.0)))
    sums = both.groupBy(*keys, "series").agg(F.sum("to").alias("to"), F.sum("from").alias("from")).withColumn("net", F.col("to") - F.col("from"))
    long = sums.unpivot([*keys, "series"], ["to", "from", "net"], "measure", "value")
    total = cross.groupBy(*keys).agg((F.sum("spillover") / n).alias("value")).select(*keys, F.lit(None).cast("string").alias("series"), F.lit("total").alias("measure"), "value")
    margins = long.unionByName(total).groupBy("t", "series", "measure").agg(*stats)
    # a pair's net: what a series sends to the other less what it gets, over the dimension
    pair = cross.select(*keys, "series", "shock", (-F.col("spillover")).alias("value")).union(cross.select(*keys, "shock", "series", "spillover"))
    nets = pair.groupBy(*keys, "series", "shock").agg((F.sum("value") / n).alias("value")).groupBy("t", "series", "shock").agg(*stats)
    return margins, nets.withColumnRenamed("value", "net")


def _windows(sf: SeriesFrame, n_train: int, first: int, n_windows: int, chains: int, h: int, expanding: bool):
    """Rows by block of windows (first .. n_windows - 1) and chain, each row once for every block that needs it, and what
    gives the windows of a block: (window, rows, the h rows after them). A block has one window where few are asked for."""
    names, per = list(sf.names), max(1, -(-(n_windows - first) * chains // WINDOW_TASKS))
    lo = F.greatest(F.col("t") - n_train - h, F.lit(first))
    hi = F.lit(n_windows - 1) if expanding else F.least(F.col("t") - 1, F.lit(n_windows - 1))
    rows = _values(sf).withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long")).filter("lo <= hi")
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(lo div {per}, hi div {per})"))).withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(chains)))).drop("lo", "hi")

    def of(pdf: pd.DataFrame):
        pdf, block = pdf.sort_values("t"), int(pdf["block"].iat[0])
        t, y = int(pdf["t"].iat[0]), pdf[names].to_numpy()
        for w in range(max(first, block * per), min(n_windows, (block + 1) * per)):
            a, b = 0 if expanding else w + 1 - t, w + n_train + 1 - t
            yield w, y[a:b], y[b : b + h]

    return rows, of


def _sampled_windows(sf: SeriesFrame, lags: Lags, spec: BayesSpec, n_train: int, h: int, n_total: int, grow: bool, first: int) -> DataFrame:
    """Windows by chain, from their moments."""
    tasks = min(WINDOW_TASKS, max(1, (n_total - n_train - h + 1 - first) * spec.chains))
    rows = window_moments(sf, lags, n_train, h, n_total, grow, first)
    return rows.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(spec.chains)))).repartition(tasks, *sf.panel, "window", "chain")


def backtest(sf: SeriesFrame, lags: Lags, spec: BayesSpec, n_train: int, h: int, n_total: int, expanding: bool = False, sparse: bool = False, use_sv: bool = True, fit: BayesFit | None = None) -> DataFrame:
    """window, chain, t, series, forecast (mean over the chain's draws) and lpl (the log predictive density of the actual
    rows, averaged over draws and steps), for the h-step forecast of each window. Windows and chains are sampled side by
    side. ``fit``: a fit of the training rows, which serves window 0 as it is."""
    names, panel, n = list(sf.names), list(sf.panel), n_total - n_train - h + 1
    schema = f"{sf.panel_schema}window long, chain int, t long, series string, forecast double, lpl double"
    m, first, sampler = sf.dim, 0 if fit is None else 1, sampler_of(spec.prior)
    p = (len(lags.parts) + 1) * m

    def found(d: Draws, w: int, chain: int, last: np.ndarray, actual: np.ndarray, rng: np.random.Generator, keys: tuple = ()) -> pd.DataFrame:
        path, lpd = d.simulate(last, h, rng, use_sv, actual)
        out = pd.DataFrame({"window": w, "chain": chain, "t": w + n_train + h, "series": names, "forecast": path[:, -1].mean(axis=0), "lpl": float(lpd.mean())})
        return out.assign(**{c: [k] * len(out) for c, k in zip(panel, keys, strict=True)})[[*panel, *out.columns]]

    def from_moments(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                w, chain, keys = row["window"], row["chain"], [row[c] for c in panel]
                rng = np.random.default_rng([spec.seed, w + 1, chain, *seed_of(*keys)])
                d = Draws(run_moments(Moments.from_flat(np.asarray(row["moments"]), p), lags, spec, rng, sampler=sampler), lags, m, sparse)
                yield found(d, w, chain, np.reshape(row["last"], (-1, m)), np.reshape(row["ahead"], (-1, m)), rng, keys)

    if not isinstance(spec.cov, StochasticVolatility):
        sampled = _sampled_windows(sf, lags, spec, n_train, h, n_total, expanding, first).mapInPandas(from_moments, schema)
    else:
        rows, windows = _windows(sf.single(), n_train, first, n, spec.chains, h, expanding)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain, out = int(pdf["chain"].iat[0]), []
            for w, y, actual in windows(pdf):
                rng = np.random.default_rng([spec.seed, w + 1, chain])
                d = Draws(run_chain(*design_arrays(y, lags), lags, spec, rng, sampler), lags, m, sparse)
                out.append(found(d, w, chain, y[-lags.order :], actual, rng))
            return pd.concat(out)

        sampled = rows.groupBy("block", "chain").applyInPandas(run, schema)
    if fit is None:
        return sampled
    near = sf.single().df.filter(F.col("t").between(n_train - lags.order + 1, n_train + h)).orderBy("t").select(*names).collect()
    near = np.array([[float(x) for x in r] for r in near])  # lags and steps only

    def given(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iat[0])
        d = Draws(_arrays(pdf), lags, m, sparse)
        return found(d, 0, chain, near[: lags.order], near[lags.order :], np.random.default_rng([spec.seed, 1, chain]))

    return fit.draws.groupBy("chain").applyInPandas(given, schema).union(sampled)


def dynamic_spillover(sf: SeriesFrame, lags: Lags, spec: BayesSpec, window: int, n_total: int, step: int = 10) -> DataFrame:
    """t_end, series, shock, spillover: the posterior mean table of a refit on every window (homoskedastic models), sampled from
    the windows' moments."""
    if isinstance(spec.cov, StochasticVolatility):
        raise ValueError("with stochastic volatility one fit has a covariance for each time: use spillover_draws")
    names, m, panel, sampler = list(sf.names), sf.dim, list(sf.panel), sampler_of(spec.prior)
    p = (len(lags.parts) + 1) * m

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                keys = [row[c] for c in panel]
                rng = np.random.default_rng([spec.seed, row["window"] + 1, row["chain"], *seed_of(*keys)])
                d = Draws(run_moments(Moments.from_flat(np.asarray(row["moments"]), p), lags, spec, rng, sampler=sampler), lags, m)
                w = np.array([vma(b, m, lags.order, step - 1) for b in d.lag_coef])
                mean = 100 * fevd_last(w, d.covariances()).mean(axis=0)
                out = pd.DataFrame({"t_end": row["window"] + window, "series": np.repeat(names, m), "shock": names * m, "spillover": mean.ravel()})
                yield out.assign(**{c: [k] * len(out) for c, k in zip(panel, keys, strict=True)})[[*panel, *out.columns]]

    per = _sampled_windows(sf, lags, spec, window, 0, n_total, False, 0).mapInPandas(run, f"{sf.panel_schema}t_end long, series string, shock string, spillover double")
    return per.groupBy(*panel, "t_end", "series", "shock").agg(F.avg("spillover").alias("spillover"))
