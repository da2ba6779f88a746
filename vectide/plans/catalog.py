"""Registered queries and their SQL.

Queries with SQL have closed forms (plans/sql.py for one or two variables, plans/sweeps.py for any number); those without
draw random numbers or step an optimiser, and are tested against NumPy.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.design import Lags, group_matrix, har_matrix, minnesota_dummies, with_design
from vectide.functions.special import gamma_from_mode
from vectide.operators import backtest, criteria, forecast, gibbs, gram, mcmc, metrics, niw, ols, posterior, priors, simulate, structure, tidy, tuning, volatility
from vectide.sources.series import SeriesFrame, daily_prices, hourly_events, interpolate, panel_prices, read_series, split_tail, weekly_prices
from vectide.sources.sinks import kept_table, scratch, write_table
from vectide.streaming import online

HOLD_OUT = 20
H = 3


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def rows(spark: SparkSession, schema: str, data: list) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else int(x) if isinstance(x, np.integer) else x for x in r) for r in data], schema)


def one(spark, d: str, name: str = "y_A") -> SeriesFrame:
    return SeriesFrame(weekly_prices(spark, d).df.select("t", name), (name,))


def two(spark, d: str) -> SeriesFrame:
    return SeriesFrame(weekly_prices(spark, d).df.select("t", "y_A", "y_N"), ("y_A", "y_N"))


PLAIN = Lags(1, None, False)
#: Chains of windows are shorter than those of fits: there are hundreds of them.
WINDOW_SPEC = partial(priors.BayesSpec, n_iter=200, burn=100)


def kept(sf: SeriesFrame) -> SeriesFrame:
    """``sf`` written to the shared folder, for queries that read it in several jobs."""
    return sf.with_df(kept_table(sf.df, "series")[0])


def naive_and_mean(spark, d: str):
    """Hold-out rows with two forecasts: the last training value, and the training mean as the benchmark."""
    train, test = split_tail(weekly_prices(spark, d), HOLD_OUT)
    long = train.long()
    by = long.groupBy("series").agg(F.max_by("value", "t").alias("forecast"), F.avg("value").alias("benchmark"))
    return test.long().withColumnRenamed("value", "actual").join(by, "series"), train


# Series

def series_wide(spark, d):
    return rounded(weekly_prices(spark, d).df.select("t", "w", "y_A", "y_N", "y_R"), 4)


def series_long(spark, d):
    return rounded(weekly_prices(spark, d).long(), 4)


def interpolate_linear(spark, d):
    return rounded(interpolate(hourly_events(spark, d)).df.select("t", "h", *[f"y_{c}" for c in ("click", "error", "purchase", "signup", "view")]))


def split_tail_query(spark, d):
    train, test = split_tail(weekly_prices(spark, d), HOLD_OUT)
    part = lambda s, n: s.df.select("t", F.lit(n).alias("part"), F.round("y_A", 4).alias("y_A"))
    return part(train, "train").unionByName(part(test, "test"))


def lag_design(spark, d):
    return rounded(with_design(two(spark, d), Lags(2)).select("t", "y_A_1", "y_N_1", "y_A_2", "y_N_2", "const"), 4)


def har_design(spark, d):
    return rounded(with_design(one(spark, d), Lags(har=(5, 22))).select("t", "y_A_day", "y_A_week", "y_A_month", "const"), 4)


# Small matrices

def har_matrix_query(spark, d):
    m = har_matrix(2, 5, 22)
    return rounded(rows(spark, "r int, c int, value double", [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(m)]))


def _groups(kind):
    return lambda spark, d: rows(spark, "r int, c int, grp int", [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(group_matrix(3, 2, kind))])


def minnesota_dummies_query(spark, d):
    y, x = minnesota_dummies(np.array([2.0, 5.0]), 3, 0.1, np.array([1.0, 0.5]), 1e-4)
    both = np.hstack([y, x])
    return rounded(rows(spark, "r int, c int, value double", [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(both)]))


# Least squares

def gram_lag1(spark, d):
    g = gram.gram(with_design(two(spark, d), PLAIN), ["y_A_1", "y_N_1"], ["y_A", "y_N"])
    cells = [("xx", g.xx), ("xy", g.xy), ("yy", g.yy)]
    return rounded(rows(spark, "part string, r int, c int, value double", [(n, i + 1, j + 1, v / 1e6) for n, a in cells for (i, j), v in np.ndenumerate(a)]), 3)


def ar1_ols(spark, d):
    data = [(c, *ols.var_lm(one(spark, d, c), 1).coef[:, 0]) for c in ("y_A", "y_N", "y_R")]
    return rounded(rows(spark, "series string, slope double, intercept double", data), 6, intercept=3)


def ar1_infer(spark, d):
    return rounded(ols.infer(ols.var_lm(one(spark, d), 1), spark).drop("p_value"), 4, estimate=3, std_error=3)


def var1_ols_2d(spark, d):
    return rounded(ols.fit_ols(two(spark, d), PLAIN).coefficients(spark).select("term", "response", "estimate"))


def har_ols_1d(spark, d):
    return rounded(ols.vhar_lm(one(spark, d), (5, 22), False).coefficients(spark).select("term", "estimate"))


def var1_fitted(spark, d):
    return rounded(ols.fit_ols(two(spark, d), PLAIN).with_fitted(two(spark, d)), 3)


def var1_resid_cov(spark, d):
    s = ols.fit_ols(two(spark, d), PLAIN).sigma
    return rounded(rows(spark, "r int, c int, value double", [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(s)]), 1)


def ic_table_ar(spark, d):
    t = tuning.choose_var(SeriesFrame(one(spark, d).df, ("y_A",)), spark, 2, False)
    return rounded(t.table.withColumn("FPE", F.col("FPE") / 1e6), 5, FPE=3)


def loglik_ar1(spark, d):
    m = ols.var_lm(one(spark, d), 1)
    return rounded(rows(spark, "log_lik double, aic double, bic double, hq double", [(criteria.log_lik(m), criteria.aic(m), criteria.bic(m), criteria.hq(m))]), 4)


# Structure

def stableroot_2d(spark, d):
    r = structure.stable_roots(ols.fit_ols(two(spark, d), PLAIN))
    return rounded(rows(spark, "i int, root double", [(i + 1, v) for i, v in enumerate(r)]))


def vma_2d(spark, d):
    w = structure.model_vma(ols.fit_ols(two(spark, d), PLAIN), 5)
    return rounded(rows(spark, "period int, shock int, response int, value double", [(h, i + 1, j + 1, v) for (h, i, j), v in np.ndenumerate(w)]))


def irf_2d(spark, d):
    return rounded(structure.irf(ols.fit_ols(two(spark, d), PLAIN), spark, 5, False, impulse=["y_A"]))


def irf_ortho_2d(spark, d):
    return rounded(structure.irf(ols.fit_ols(two(spark, d), PLAIN), spark, 5, True, response=["y_N"]), 2)


def fevd_2d(spark, d):
    m = ols.fit_ols(two(spark, d), PLAIN)
    f = structure.fevd(structure.model_vma(m, 1), m.sigma)
    return rounded(rows(spark, "step int, response int, shock int, value double", [(h + 1, i + 1, j + 1, v) for (h, i, j), v in np.ndenumerate(f)]))


def spillover_2d(spark, d):
    return rounded(structure.spillover_margins(structure.spillover(ols.fit_ols(two(spark, d), PLAIN), spark, 2)), 4)


def spillover_pairs_2d(spark, d):
    return rounded(structure.net_pairwise(structure.spillover(ols.fit_ols(two(spark, d), PLAIN), spark, 2), 2), 4)


# Forecasts

def forecast_ar1(spark, d):
    sf = one(spark, d)
    return rounded(forecast.predict(ols.var_lm(sf, 1), sf, 5).select("h", "forecast", "se"), 2)


def forecast_bands_ar1(spark, d):
    sf = one(spark, d)
    return rounded(forecast.predict(ols.var_lm(sf, 1), sf, 5), 2).drop("series", "se", "forecast")


def roll_ar1(spark, d):
    sf = kept(one(spark, d))
    return rounded(backtest.forecast_roll(sf, Lags(1), 100, 2, sf.count()).select("window", "t", "forecast"), 2)


def expand_ar1(spark, d):
    sf = kept(one(spark, d))
    return rounded(backtest.forecast_expand(sf, Lags(1), 100, 2, sf.count()).select("window", "t", "forecast"), 2)


def dynamic_spillover_2d(spark, d):
    long = backtest.dynamic_spillover(two(spark, d), PLAIN, 120, 1)
    return rounded(structure.spillover_margins(long, ("t_end",)).select("t_end", "series", "to", "from", "net", "total"), 3)


# Conjugate models

def minnesota_post_1d(spark, d):
    p = niw.var_minnesota(one(spark, d), 1, priors.MinnesotaSpec((4000.0,), 0.1, 1.0), False)
    return rounded(rows(spark, "mean double, prec double, scale double, shape double", [(p.coef[0, 0], p.prec[0, 0] / 1e6, p.scale[0, 0] / 1e6, float(p.shape))]), 6, prec=1, scale=1)


def flat_post_1d(spark, d):
    p = niw.var_flat(one(spark, d), 1, 1.0, False)
    return rounded(rows(spark, "mean double, prec double, scale double, shape double", [(p.coef[0, 0], p.prec[0, 0] / 1e6, p.scale[0, 0] / 1e6, float(p.shape))]), 6, prec=1, scale=1)


def gamma_hyper(spark, d):
    return rounded(rows(spark, "mode double, sd double, shape double, rate double", [(m, s, *gamma_from_mode(m, s)) for m in (0.2, 1.0) for s in (0.4, 2.0)]))


# Losses

def _loss(name):
    def query(spark, d):
        joined, train = naive_and_mean(spark, d)
        f = getattr(metrics, name)
        return rounded(f(joined, train) if name in ("mase", "rmase") else f(joined), 4)

    return query


LOSSES = ("mse", "mae", "mape", "mase", "mrae", "relmae", "rmape", "rmase", "rmsfe", "rmafe")


def gather_loss(spark, d):
    joined, _ = naive_and_mean(spark, d)
    other = joined.withColumn("forecast", F.col("benchmark"))
    return rounded(metrics.gather_loss({m: {"mae": metrics.mae(r), "mape": metrics.mape(r)} for m, r in (("naive", joined), ("mean", other))}), 3)


def gather_predictions(spark, d):
    train, _ = split_tail(one(spark, d), HOLD_OUT)
    last = train.df.agg(F.max_by("y_A", "t").alias("f"), F.avg("y_A").alias("m"))
    make = lambda c: last.select(F.explode(F.sequence(F.lit(1), F.lit(H))).alias("h"), F.lit("y_A").alias("series"), F.col(c).alias("forecast"))
    return rounded(tidy.gather_predictions({"naive": make("f"), "mean": make("m")}, train), 4)


# Draws: the embeddings table read as draws of a parameter vector in two chains

def pseudo_draws(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    thr = F.col("value").cast("double")
    value = F.when(F.abs(thr) < 0.05, 0.0).otherwise(thr)
    return e.select((F.col("vec_id") % 2).cast("int").alias("chain"), (F.floor(F.col("vec_id") / 2) + 1).cast("int").alias("iteration"), F.lit("alpha").alias("param"), (F.col("pos") + 1).cast("int").alias("idx"), value.alias("value"))


def draw_summary(spark, d):
    return rounded(posterior.summarise(posterior.thin(pseudo_draws(spark, d), 10, 2), 0.1))


def pip(spark, d):
    return rounded(posterior.inclusion(pseudo_draws(spark, d)))


def ci_select(spark, d):
    return rounded(posterior.select_by_interval(pseudo_draws(spark, d), 0.9))


def pip_select(spark, d):
    draws = pseudo_draws(spark, d)
    return rounded(posterior.select_by_inclusion(draws, posterior.inclusion(draws), 0.7))


def rhat(spark, d):
    return rounded(posterior.rhat(pseudo_draws(spark, d)))


def tail_quantile(spark, d):
    return rounded(posterior.tail_quantile(pseudo_draws(spark, d), 0.1))


def _halves(spark, d):
    s = pseudo_draws(spark, d).groupBy("param", "idx", "chain").agg(F.avg("value").alias("value"))
    return s.filter("chain = 0").drop("chain"), s.filter("chain = 1").drop("chain")


def confusion(spark, d):
    return posterior.confusion(*_halves(spark, d), 0.004)


def selection_scores(spark, d):
    return rounded(posterior.selection_scores(confusion(spark, d)))


def fromse(spark, d):
    return rounded(posterior.frobenius_error(*_halves(spark, d), 32, 2))


# Without SQL

def _bayes(prior, cov, har):
    def query(spark, d):
        sf = weekly_prices(spark, d)
        spec = priors.BayesSpec(priors.PRIORS[prior](), cov)
        fit = mcmc.vhar_bayes(sf, (5, 22), spec) if har else mcmc.var_bayes(sf, 1, spec)
        return posterior.summarise(fit.draws.filter("param IN ('alpha', 'alpha_sparse', 'c', 'a', 'd', 'h0', 'sigh')"))

    return query


def predict_density_minnesota(spark, d):
    sf = weekly_prices(spark, d)
    return forecast.summarise(forecast.predict_density(niw.var_minnesota(sf, 2), sf, 5, 200))


def predict_density_bayes(spark, d):
    sf = weekly_prices(spark, d)
    return forecast.summarise(mcmc.predict(mcmc.var_bayes(sf, 1, priors.BayesSpec(priors.Horseshoe(), priors.StochasticVolatility())), sf, 5))


def roll_mcmc(spark, d):
    sf = kept(weekly_prices(spark, d))
    n = sf.count()
    out = mcmc.backtest(sf, Lags(1), WINDOW_SPEC(priors.Minnesota()), 150, 1, n)
    return out.groupBy("window", "t", "series").agg(F.avg("forecast").alias("forecast"), F.avg("lpl").alias("lpl"))


def expand_mcmc(spark, d):
    sf = kept(weekly_prices(spark, d))
    n = sf.count()
    return mcmc.backtest(sf, Lags(1), WINDOW_SPEC(priors.Ssvs()), 150, 1, n, expanding=True)


def alpl(spark, d):
    return metrics.alpl(roll_mcmc(spark, d).select("window", "lpl").distinct())


def roll_minnesota(spark, d):
    sf = kept(weekly_prices(spark, d))
    prior = niw.dummies_of(priors.MinnesotaSpec(), Lags(1), niw.sample_sd(sf))
    return rounded(backtest.forecast_roll(sf, Lags(1), 150, 1, sf.count(), backtest.conjugate_estimator(prior)), 2)


def expand_minnesota(spark, d):
    sf = kept(weekly_prices(spark, d))
    prior = niw.dummies_of(priors.MinnesotaSpec(), Lags(1), niw.sample_sd(sf))
    return rounded(backtest.forecast_expand(sf, Lags(1), 150, 1, sf.count(), backtest.conjugate_estimator(prior)), 2)


def roll_flat(spark, d):
    sf = kept(weekly_prices(spark, d))
    return rounded(backtest.forecast_roll(sf, Lags(har=(5, 22)), 150, 1, sf.count(), backtest.flat_estimator(np.eye(10))), 2)


def spillover_posterior(spark, d):
    sf = weekly_prices(spark, d)
    return mcmc.spillover_summary(mcmc.spillover_draws(mcmc.var_bayes(sf, 1, priors.BayesSpec(priors.Horseshoe())), 5))


def dynamic_spillover_sv(spark, d):
    sf = kept(weekly_prices(spark, d))
    fit = mcmc.var_bayes(sf, 1, priors.BayesSpec(priors.Horseshoe(), priors.StochasticVolatility()))
    fit = fit.with_draws(kept_table(fit.draws, "draws")[0])  # dates and forms both read them
    return mcmc.spillover_summary(mcmc.spillover_draws(fit, 5, times=list(range(sf.count() - 1))))


def spillover_minnesota(spark, d):
    draws = niw.spillover_draws(niw.vhar_minnesota(weekly_prices(spark, d)), spark, 10)
    return mcmc.spillover_margins(draws)[0]


def dynamic_spillover_minnesota(spark, d):
    sf = kept(weekly_prices(spark, d))
    return backtest.dynamic_spillover_conjugate(sf, Lags(1), niw.dummies_of(priors.MinnesotaSpec(), Lags(1), niw.sample_sd(sf)), 150, 5)


def hierarchical_minnesota_vhar(spark, d):
    return posterior.summarise(niw.hierarchical_minnesota(two(spark, d), har=(5, 22)))


def predict_density_selected(spark, d):
    """Forecasts from the coefficients whose 90 % interval leaves out zero, and from stable draws only."""
    sf = weekly_prices(spark, d)
    fit = mcmc.var_bayes(sf, 1, priors.BayesSpec(priors.Horseshoe()))
    return forecast.summarise(mcmc.predict(fit.with_draws(kept_table(fit.draws, "draws")[0]), sf, 5, sparse=0.9, stable=True))


def dynamic_spillover_mcmc(spark, d):
    sf = kept(weekly_prices(spark, d))
    return mcmc.dynamic_spillover(sf, Lags(1), WINDOW_SPEC(priors.NormalGamma()), 150, sf.count(), 5)


def choose_bayes(spark, d):
    spec, _, ml = tuning.choose_bayes(two(spark, d), 1)
    return rows(spark, "lam double, log_ml double", [(spec.lam, ml)])


def log_ml(spark, d):
    return rounded(rows(spark, "log_ml double", [(criteria.log_ml(niw.vhar_minnesota(weekly_prices(spark, d))),)]), 3)


def log_ml_var2(spark, d):
    return rounded(rows(spark, "log_ml double", [(criteria.log_ml(niw.var_minnesota(weekly_prices(spark, d), 2)),)]), 3)


def dic(spark, d):
    return rows(spark, "dic double", [(criteria.dic(niw.vhar_minnesota(weekly_prices(spark, d))),)])


def hierarchical_minnesota(spark, d):
    return posterior.summarise(niw.hierarchical_minnesota(two(spark, d), 1))


def summary_pvalue(spark, d):
    found = ols.summary(ols.var_lm(weekly_prices(spark, d), 2), spark).coefficients
    return by_term(found, 5, ("estimate", "std_error")).withColumns({c: F.round(c, 4) for c in ("statistic", "p_value")})


def resid_corr_3d(spark, d):
    c = ols.summary(ols.var_lm(weekly_prices(spark, d), 2), spark).correlation
    return rounded(rows(spark, "r int, c int, value double", [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(c)]))


# Three variables

def by_term(coefficients: DataFrame, digits: int = 6, columns: tuple[str, ...] = ("estimate",), const_digits: int = 2) -> DataFrame:
    """Rounded coefficients; constants are large and keep fewer digits."""
    return coefficients.withColumns({c: F.when(F.col("term") == "const", F.round(c, const_digits)).otherwise(F.round(c, digits)) for c in columns})


def _coefs(model, spark, const_digits: int = 2) -> DataFrame:
    return by_term(model.coefficients(spark).select("term", "response", "estimate"), const_digits=const_digits)


def var2_chol_3d(spark, d):
    return _coefs(ols.var_lm(weekly_prices(spark, d), 2, method="chol"), spark)


def var2_qr_3d(spark, d):
    return _coefs(ols.var_lm(weekly_prices(spark, d), 2, method="qr"), spark)


def vhar_ols_3d(spark, d):
    return _coefs(ols.vhar_lm(weekly_prices(spark, d)), spark)


def heat_map_3d(spark, d):
    return rounded(tidy.heat_map(ols.var_lm(weekly_prices(spark, d), 2).coefficients(spark)))


def sample_sd(spark, d):
    sf = weekly_prices(spark, d)
    return rounded(rows(spark, "series string, sd double", list(zip(sf.names, niw.sample_sd(sf), strict=True))), 4)


def best_lag_ar(spark, d):
    best = tuning.choose_var(SeriesFrame(one(spark, d).df, ("y_A",)), spark, 2, False).best
    return rows(spark, "criterion string, lag int", sorted(best.items()))


HAR_PLAIN = Lags(1, (5, 22), False)


def vhar_vma_2d(spark, d):
    w = structure.model_vma(ols.fit_ols(two(spark, d), HAR_PLAIN), 5)
    return rounded(rows(spark, "period int, shock int, response int, value double", [(h, i + 1, j + 1, v) for (h, i, j), v in np.ndenumerate(w)]))


def vhar_spillover_2d(spark, d):
    return rounded(structure.spillover(ols.fit_ols(two(spark, d), HAR_PLAIN), spark, 2), 4)


def forecast_vhar_1d(spark, d):
    sf = one(spark, d)
    return rounded(forecast.predict(ols.vhar_lm(sf), sf, 5).select("h", "series", "forecast"), 2)


LONG_MEMORY = priors.MinnesotaSpec(weekly=0.5, monthly=0.25)


def minnesota_var2_3d(spark, d):
    return _coefs(niw.var_minnesota(weekly_prices(spark, d), 2), spark)


def minnesota_vhar_s_3d(spark, d):
    return _coefs(niw.vhar_minnesota(weekly_prices(spark, d)), spark)


def minnesota_vhar_l_3d(spark, d):
    return _coefs(niw.vhar_minnesota(weekly_prices(spark, d), spec=LONG_MEMORY), spark)


def minnesota_vhar_l_scale(spark, d):
    s = niw.vhar_minnesota(weekly_prices(spark, d), spec=LONG_MEMORY).scale
    return rounded(rows(spark, "r int, c int, value double", [(i + 1, j + 1, v / 1e6) for (i, j), v in np.ndenumerate(s)]), 3)


def flat_vhar_3d(spark, d):
    return _coefs(niw.var_flat(weekly_prices(spark, d), har=(5, 22)), spark, 4)


def sim_mnormal(spark, d):
    return simulate.sim_mnormal(spark, 500, np.zeros(2), np.array([[1.0, 0.3], [0.3, 2.0]]))


def sim_var(spark, d):
    return simulate.sim_var(spark, np.array([[0.5, 0.0], [0.1, 0.4], [1.0, 1.0]]), np.eye(2), Lags(1), 100, paths=4)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """VAR(1) on the training weeks, forecasts of the hold-out weeks, and their mean squared errors."""
    sf = kept(interpolate(weekly_prices(spark, d)))
    train, test = split_tail(sf, HOLD_OUT)
    f = forecast.predict(ols.var_lm(train, 1), train, HOLD_OUT)
    first = F.broadcast(test.df.agg(F.min("t").alias("first")))  # one row
    ahead = f.crossJoin(first).select((F.col("first") + F.col("h") - 1).alias("t"), "series", "forecast")
    got = metrics.mse(metrics.joined(ahead, test.long()))
    return got.select("series", F.round(F.col("mse") / 1e6, 6).alias("mse")).orderBy("series")


def flagship_daily(spark, d):
    """Rolling one-step forecasts of a daily VAR(5)."""
    sf = kept(interpolate(daily_prices(spark, d)))
    return rounded(backtest.forecast_roll(sf, Lags(5), 1000, 1, sf.count()), 2)


# Panels: weekly prices, a series for each return flag and line status

def panel_ar1(spark, d):
    sf = panel_prices(spark, d)
    return by_term(ols.panel_coefficients(ols.fit_panel(sf, Lags(1)), sf, Lags(1)))


def panel_forecast(spark, d):
    return rounded(forecast.predict_panel(panel_prices(spark, d), Lags(1), H), 2)


def panel_roll(spark, d):
    return rounded(backtest.forecast_roll(panel_prices(spark, d), Lags(1), 100, 2), 2)


def panel_bayes(spark, d):
    return posterior.summarise(mcmc.var_bayes(panel_prices(spark, d), 1, priors.BayesSpec(priors.Horseshoe())).draws)


# Conjugate models at the posterior mean

TWO_SCALES = priors.MinnesotaSpec((4000.0, 5000.0), 0.1, 1.0)


def forecast_minnesota_1d(spark, d):
    sf = one(spark, d)
    return rounded(forecast.predict(niw.var_minnesota(sf, 1, priors.MinnesotaSpec((4000.0,), 0.1, 1.0), False), sf, 5).select("h", "forecast", "se"), 2)


def forecast_minnesota_2d(spark, d):
    sf = two(spark, d)
    return rounded(forecast.predict(niw.var_minnesota(sf, 1, TWO_SCALES, False), sf, 5).select("h", "series", "forecast"), 2)


def spillover_minnesota_2d(spark, d):
    return rounded(structure.spillover_margins(structure.spillover(niw.var_minnesota(two(spark, d), 1, TWO_SCALES, False), spark, 2)), 4)


def dic_plug_in(spark, d):
    """The deviance at the posterior mean: the part of the criterion that draws no random numbers."""
    return rounded(rows(spark, "deviance double", [(criteria.deviance_at_mean(niw.var_minnesota(two(spark, d), 1, TWO_SCALES, False)),)]), 3)


# Convergence and distances

def rank_rhat(spark, d):
    return rounded(posterior.rank_rhat(pseudo_draws(spark, d)))


def pip_constants(spark, d):
    return rounded(posterior.inclusion(pseudo_draws(spark, d), constants=2))


def spectral(spark, d):
    return rounded(posterior.spectral_norms(*_halves(spark, d), 32, 2))


# Models whose draws are read off the embeddings: two series, one lag, impacts and scales

def pseudo_fit(spark, d) -> mcmc.BayesFit:
    """Each vector is a draw: twice its first four numbers are coefficients, the fifth the impact, the next two log scales, and
    four times the next six the log variances of three dates."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    at = lambda i: F.col("embedding")[i - 1].cast("double")
    cells = [*[("alpha", i, 2 * at(i)) for i in range(1, 5)], ("a", 1, at(5)), *[("d", i, F.exp(at(i + 5))) for i in (1, 2)], *[("h", i, 4 * at(i + 7)) for i in range(1, 7)]]
    long = e.select((F.col("vec_id") % 2).cast("int").alias("chain"), (F.floor(F.col("vec_id") / 2) + 1).cast("int").alias("iteration"), F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.lit(i).alias("idx"), v.alias("value")) for n, i, v in cells])).alias("c"))
    return mcmc.BayesFit(("x", "y"), PLAIN, priors.BayesSpec(), long.select("chain", "iteration", "c.param", "c.idx", "c.value"))


def stable_draws(spark, d):
    return mcmc.stable_draws(constant_scales(pseudo_fit(spark, d)))


def constant_scales(fit: mcmc.BayesFit) -> mcmc.BayesFit:
    return fit.with_draws(fit.draws.filter("param <> 'h'"))


def spillover_draw_margins(spark, d):
    return rounded(mcmc.spillover_margins(mcmc.spillover_draws(constant_scales(pseudo_fit(spark, d)), 2))[0], 4)


def spillover_draw_pairs(spark, d):
    return rounded(mcmc.spillover_margins(mcmc.spillover_draws(constant_scales(pseudo_fit(spark, d)), 2))[1], 4)


def spillover_dates(spark, d):
    return rounded(mcmc.spillover_summary(mcmc.spillover_draws(pseudo_fit(spark, d), 2, times=[0, 1, 2])), 4)


def lpl_given(spark, d):
    """Log predictive density of the last week (in ten thousands) under given draws, which serve its window as a fit."""
    y = two(spark, d)
    sf = kept(SeriesFrame(y.df.select("t", (F.col("y_A") / 1e4).alias("x"), (F.col("y_N") / 1e4).alias("y")), ("x", "y")))
    n = sf.count()
    out = mcmc.backtest(sf, PLAIN, WINDOW_SPEC(), n - 1, 1, n, fit=constant_scales(pseudo_fit(spark, d)))
    return rounded(out.select("window", "chain", "t", "lpl").distinct(), 5)


def savs_means(spark, d):
    """Soft thresholds of a hundred times the mean of each embedding column, against its sum of squares."""
    got = pseudo_draws(spark, d).groupBy("idx").agg(F.avg("value").alias("m"), F.sum(F.col("value") ** 2).alias("q")).orderBy("idx").collect()
    out = gibbs.savs(np.array([[100 * r["m"]] for r in got]), np.array([r["q"] for r in got]), np.array([[r["idx"] > 60] for r in got]))
    return rounded(rows(spark, "idx int, value double", [(r["idx"], v) for r, v in zip(got, out[:, 0], strict=True)]))


def dynamic_spillover_minnesota_2d(spark, d):
    """Spillovers of windows at the posterior mean under the dummy rows of TWO_SCALES."""
    prior = niw.dummies_of(TWO_SCALES, PLAIN, np.asarray(TWO_SCALES.sigma))
    long = backtest.dynamic_spillover(two(spark, d), PLAIN, 120, 1, backtest.conjugate_estimator(prior))
    return rounded(structure.spillover_margins(long, ("t_end",)).select("t_end", "series", "to", "from", "net", "total"), 3)


def alpl_naive(spark, d):
    """Mean and median log density of one-step errors of the last value, with variance 1e8."""
    w = with_design(one(spark, d), PLAIN).select(F.col("t").alias("window"), (-0.5 * F.log(F.lit(2e8 * np.pi)) - (F.col("y_A") - F.col("y_A_1")) ** 2 / 2e8).alias("lpl"))
    return rounded(metrics.alpl(w).crossJoin(F.broadcast(metrics.alpl(w, True).withColumnRenamed("alpl", "median"))))  # one row each


# Groups, hyperparameters and simulations that a table's own models and scales give

def _group_means(kind):
    def query(spark, d):
        """Mean size of the coefficients of each shrinkage group of a VAR(2)."""
        m = ols.var_lm(weekly_prices(spark, d), 2)
        groups = group_matrix(2, m.dim, kind)
        label = rows(spark, "term string, response string, grp int", [(t, y, groups[i, j]) for i, t in enumerate(m.terms[: len(groups)]) for j, y in enumerate(m.names)])
        found = _coefs(m, spark).join(F.broadcast(label), ["term", "response"])  # one row for each coefficient
        return rounded(found.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.abs("estimate")).alias("size")), 5)

    return query


def gamma_hyper_series(spark, d):
    """Gamma shape and rate of each series: the mode is its coefficient of variation, the standard deviation 0.4."""
    sf = weekly_prices(spark, d)
    got = sf.df.agg(*[(F.stddev_samp(c) / F.avg(c)).alias(c) for c in sf.names]).first()
    return rounded(rows(spark, "series string, mode double, shape double, rate double", [(c, got[c], *gamma_from_mode(got[c], 0.4)) for c in sf.names]), 5)


def dummies_series(spark, d):
    """Dummy rows (nonzero cells) whose scales are the series' standard deviations."""
    sf = weekly_prices(spark, d)
    y, x = minnesota_dummies(niw.sample_sd(sf), 1, 0.2, np.ones(3), 1e-4)
    return rounded(rows(spark, "r int, c int, value double", [(i + 1, j + 1, v) for (i, j), v in np.ndenumerate(np.hstack([y, x])) if v]), 4)


def vhar_lag_coef(spark, d):
    """The coefficients of a VHAR on its 22 plain lags."""
    m = ols.vhar_lm(one(spark, d), (5, 22), False)
    return rounded(rows(spark, "lag int, estimate double", [(i + 1, m.lag_coef[i, 0]) for i in range(22)]), 5)


def coef_parts(spark, d):
    """The coefficient matrix of each lag of a VAR(2), cell by cell."""
    parts = tidy.by_part(ols.var_lm(weekly_prices(spark, d), 2).coefficients(spark))
    cells = parts.select("part", F.explode("matrix").alias("cell", "estimate"))
    return rounded(cells.select("part", "cell.predictor", "cell.response", "estimate"))


def sink_round_trip(spark, d):
    """The weekly series written as CSV files by quarter of a year and read back as a series."""
    sf = weekly_prices(spark, d)
    path = f"{scratch(spark, 'sink')}/series"
    write_table(sf.df.drop("t").withColumn("q", F.quarter("w")), path, ("q",), "csv", header="true")
    back = read_series(spark, path, list(sf.names), "csv", "w", header="true", inferSchema="true")
    return rounded(back.df.select("t", "w", *sf.names), 4)


def sim_var_fitted(spark, d):
    m = ols.var_lm(weekly_prices(spark, d), 1)
    return simulate.sim_var(spark, m.coef, m.sigma, m.lags, 200, paths=4)


def sim_vhar_fitted(spark, d):
    """Paths of a fitted VHAR with Student errors."""
    m = ols.vhar_lm(weekly_prices(spark, d))
    return simulate.sim_var(spark, m.coef, m.sigma, m.lags, 200, paths=4, df=5)


def _tuned(long_memory):
    def query(spark, d):
        spec, _, ml = tuning.choose_bayes(two(spark, d), har=(5, 22), long_memory=long_memory)
        means = [("delta", spec.delta), ("weekly", spec.weekly), ("monthly", spec.monthly)]
        data = [("lambda", 1, spec.lam), ("log_ml", 1, ml), *[("sigma", i + 1, v) for i, v in enumerate(spec.sigma)], *[(n, i + 1, v) for n, x in means if x is not None for i, v in enumerate(x)]]
        return rows(spark, "name string, idx int, value double", data)

    return query


def volatility_long(spark, d):
    """Mean log variances of a stochastic volatility model sampled by stretches of 100 weeks."""
    spec = priors.BayesSpec(priors.Horseshoe(), priors.StochasticVolatility(), chains=1, n_iter=16, burn=8)
    return volatility.fit_long(weekly_prices(spark, d), Lags(1), spec, 100).levels


def online_ar1(spark, d):
    """AR(1) models of the weekly series, kept up to date over a stream of the series' rows in several files."""
    _, path = kept_table(weekly_prices(spark, d).long().repartitionByRange(4, "t"), "stream")
    stream = spark.readStream.schema("t long, series string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    out = f"{path}/_fits"  # goes with the table; readers of the folder pass it over
    fits = online.online_least_squares(stream, ["series"], ["value"], Lags(1))
    query = fits.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = online.latest(spark.read.parquet(out), ["series"])
    return rounded(last.select("series", F.col("coef")[0].alias("slope"), F.col("coef")[1].alias("intercept"), "n"), 6, intercept=3)


def queries() -> dict:
    out = {
        "series_wide": series_wide, "series_long": series_long, "interpolate_linear": interpolate_linear, "split_tail": split_tail_query, "lag_design": lag_design, "har_design": har_design,
        "har_matrix": har_matrix_query, "minnesota_dummies": minnesota_dummies_query, "gram_lag1": gram_lag1, "ar1_ols": ar1_ols, "ar1_infer": ar1_infer, "var1_ols_2d": var1_ols_2d, "har_ols_1d": har_ols_1d,
        "var1_fitted": var1_fitted, "var1_resid_cov": var1_resid_cov, "ic_table_ar": ic_table_ar, "loglik_ar1": loglik_ar1, "stableroot_2d": stableroot_2d, "vma_2d": vma_2d, "irf_2d": irf_2d, "irf_ortho_2d": irf_ortho_2d,
        "fevd_2d": fevd_2d, "spillover_2d": spillover_2d, "spillover_pairs_2d": spillover_pairs_2d, "forecast_ar1": forecast_ar1, "forecast_bands_ar1": forecast_bands_ar1, "roll_ar1": roll_ar1, "expand_ar1": expand_ar1,
        "dynamic_spillover_2d": dynamic_spillover_2d, "minnesota_post_1d": minnesota_post_1d, "flat_post_1d": flat_post_1d, "gamma_hyper": gamma_hyper, "gather_loss": gather_loss, "gather_predictions": gather_predictions,
        "draw_summary": draw_summary, "pip": pip, "ci_select": ci_select, "pip_select": pip_select, "rhat": rhat, "tail_quantile": tail_quantile, "confusion": confusion, "selection_scores": selection_scores, "fromse": fromse,
    }
    out |= {f"group_matrix_{k}": _groups(k) for k in ("longrun", "short", "no")}
    out |= {f"loss_{n}": _loss(n) for n in LOSSES}
    for name in priors.PRIORS:
        for label, cov in (("ldlt", priors.Ldlt()), ("sv", priors.StochasticVolatility())):
            out[f"var_bayes_{name}_{label}"] = _bayes(name, cov, False)
            out[f"vhar_bayes_{name}_{label}"] = _bayes(name, cov, True)
    out |= {f.__name__: f for f in (predict_density_minnesota, predict_density_bayes, roll_mcmc, expand_mcmc, alpl, roll_minnesota, roll_flat, spillover_posterior, dynamic_spillover_sv, dynamic_spillover_mcmc, choose_bayes, log_ml, log_ml_var2, dic, hierarchical_minnesota, summary_pvalue, resid_corr_3d, sim_mnormal, sim_var, flagship, flagship_daily)}
    out |= {f.__name__: f for f in (var2_chol_3d, var2_qr_3d, vhar_ols_3d, heat_map_3d, sample_sd, best_lag_ar, vhar_vma_2d, vhar_spillover_2d, forecast_vhar_1d, minnesota_var2_3d, minnesota_vhar_s_3d, minnesota_vhar_l_3d, minnesota_vhar_l_scale, flat_vhar_3d, expand_minnesota, spillover_minnesota, dynamic_spillover_minnesota, hierarchical_minnesota_vhar, predict_density_selected)}
    out |= {f.__name__: f for f in (panel_ar1, panel_forecast, panel_roll, panel_bayes, forecast_minnesota_1d, forecast_minnesota_2d, spillover_minnesota_2d, dic_plug_in, rank_rhat, pip_constants, spectral, gamma_hyper_series, dummies_series, vhar_lag_coef, sim_var_fitted, sim_vhar_fitted, volatility_long, online_ar1, coef_parts, sink_round_trip, stable_draws, spillover_draw_margins, spillover_draw_pairs, spillover_dates, savs_means, dynamic_spillover_minnesota_2d, alpl_naive, lpl_given)}
    out |= {f"group_means_{k}": _group_means(k) for k in ("longrun", "short", "no")}
    out |= {"choose_bayes_vhar_s": _tuned(False), "choose_bayes_vhar_l": _tuned(True)}
    return out


def oracle_sql() -> dict[str, str]:
    from vectide.plans import members, sql, sweeps

    return sql.SQL | sweeps.SQL | members.SQL


