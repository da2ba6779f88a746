"""Moments of windows against refits, sampling from moments against sampling from rows, and walks by stretches against one
draw over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions.design import Lags
from vectide.functions.special import normal_quantile
from vectide.operators import backtest, gibbs, mcmc, moments, niw, priors, simulate, structure, volatility
from vectide.operators.gram import Gram
from vectide.operators.rng import inverse_gamma
from vectide.sources.series import SeriesFrame, weekly_prices

A = np.array([[0.5, 0.1], [0.0, 0.4], [0.2, -0.3]])
S = np.array([[1.0, 0.3], [0.3, 0.5]])


def frame(spark, y, panel=None):
    m = y.shape[-1]
    names, cols = tuple(f"y{j + 1}" for j in range(m)), ", ".join(f"y{j + 1} double" for j in range(m))
    if panel is None:
        return SeriesFrame(spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(y)], f"t long, {cols}"), names)
    rows = [(k, i + 1, *map(float, r)) for k, z in zip(panel, y, strict=True) for i, r in enumerate(z)]
    return SeriesFrame(spark.createDataFrame(rows, f"k string, t long, {cols}"), names, ("k",))


@pytest.fixture(scope="module")
def y():
    return simulate.sim_path(A, S, Lags(1), 300, rng=np.random.default_rng(3))


def test_windows_are_merged_exactly():
    z = np.random.default_rng(1).standard_normal((61, 3)) + 1e8
    for n in (1, 2, 7, 30, 31, 60, 61):
        g = moments.windows(z, n)
        assert len(g.n) == 62 - n and (g.n == n).all()
        for s in range(62 - n):
            w = z[s : s + n]
            d = w - w.mean(axis=0)
            assert np.allclose(g.mean[s], w.mean(axis=0), rtol=1e-15) and np.allclose(g.core[s], d.T @ d, atol=1e-6)
    assert len(moments.windows(z, 62).n) == 0


@pytest.mark.parametrize("mean", [0.0, 1e8])
@pytest.mark.parametrize("const", [True, False])
def test_estimators_match_refits(mean, const):
    z = np.random.default_rng(2).standard_normal((90, 5)) + mean
    x = np.hstack([z[:, :3], np.ones((90, int(const)))])
    k = 3 + const
    prior = Gram.of(np.eye(k) * (2.0 if mean == 0 else 1e-3), np.ones((k, 2)) * (mean == 0))
    g = moments.windows(z, 40)
    b, s = moments.least_squares(g, 3, const)
    pb, scale, prec = moments.with_prior(g, 3, const, prior)
    for w in (0, 11, 50):
        xs, ys = x[w : w + 40], z[w : w + 40, 3:]
        if not mean or not const:
            want = np.linalg.lstsq(xs, ys, rcond=None)[0]
            tol = 1e-6 if mean else 1e-9
            assert np.allclose(b[w], want, atol=tol) and np.allclose(s[w], (ys - xs @ want).T @ (ys - xs @ want) / (40 - k), rtol=1e-6)
        if not mean:
            post = np.linalg.solve(xs.T @ xs + prior.xx, xs.T @ ys + prior.xy)
            assert np.allclose(pb[w], post) and np.allclose(prec[w], xs.T @ xs + prior.xx)
            assert np.allclose(scale[w], ys.T @ ys + prior.yy - post.T @ prec[w] @ post)
        elif const:  # the slopes and covariance of the same noise without its mean
            near = moments.Moments.of(z[w : w + 40] - mean)
            want, cov = moments.least_squares(near, 3, True)
            assert np.allclose(b[w, :3], want[:3], atol=1e-6) and np.allclose(s[w], cov, rtol=1e-6, atol=1e-7)


def test_scans_of_one_row_blocks(spark, monkeypatch, y):
    sf = frame(spark, y[:40])
    whole = {h: backtest.forecast_expand(sf, Lags(2), 12, h, 40).orderBy("window", "series").toPandas() for h in (1, 3)}
    monkeypatch.setattr(backtest, "BLOCK_WINDOWS", 3)
    monkeypatch.setattr(backtest, "FAN", 2)
    for h, want in whole.items():
        got = backtest.forecast_expand(sf, Lags(2), 12, h, 40).orderBy("window", "series").toPandas()
        assert got[["window", "t", "series"]].equals(want[["window", "t", "series"]]) and np.allclose(got.forecast, want.forecast)
    z = np.random.default_rng(4).standard_normal((23, 2))
    parts = spark.createDataFrame([(k, i, moments.Moments.of(z[i : i + 1] + k).flat().tolist()) for k in (0, 5) for i in range(23)], "k int, block long, flat array<double>")
    got = moments.running(parts, ["k"], "k int, ", 2, 3, 23).collect()
    assert len(got) == 46
    for r in got:
        g = moments.Moments.from_flat(np.array(r["flat"]), 2)
        assert g.n == r["block"] and (g.n == 0 or np.allclose(g.mean, z[: r["block"]].mean(axis=0) + r["k"]))


def row_form(x, y, lags, spec, rng):
    """The sampler for constant variances over rows: what the form over moments must agree with, draw by draw."""
    n, m = y.shape
    K = x.shape[1] - lags.include_mean
    sigma = y.std(axis=0, ddof=1)
    prior = gibbs.SAMPLERS[type(spec.prior)](spec.prior, lags, sigma, rng)
    coef, low = rng.uniform(-1, 1, (x.shape[1], m)) * 0.1, np.eye(m)
    coef[:K] += prior.mean
    rows, _ = np.tril_indices(m, -1)
    d = np.exp(rng.uniform(-1, 1, m)) * sigma**2
    prec, mean, kept = np.empty(coef.shape), np.zeros(coef.shape), []
    for it in range(spec.n_iter):
        a = low[np.tril_indices(m, -1)]
        prec[:K] = prior.coef_prec(coef[:K] - prior.mean if type(spec.prior) is priors.Minnesota else coef[:K], rng)
        mean[:K] = prior.mean
        prec[K:], mean[K:] = 1 / spec.intercept.sd**2, spec.intercept.mean
        for j in range(m):
            e = y - x @ coef
            e[:, j] = y[:, j]
            u = e @ low[j:].T / d[j:]
            omega = np.diag(prec[:, j]) + sum(low[i, j] ** 2 / d[i] * x.T @ x for i in range(j, m))
            coef[:, j] = gibbs.draw_normal(omega, prec[:, j] * mean[:, j] + x.T @ (u @ low[j:, j]), rng)
        e = y - x @ coef
        a_prec = prior.impact_prec(a, rng)
        for j in range(1, m):
            z = -e[:, :j]
            low[j, :j] = gibbs.draw_normal(np.diag(a_prec[rows == j]) + z.T @ z / d[j], z.T @ e[:, j] / d[j], rng)
        v = e @ low.T
        d = np.maximum(inverse_gamma(spec.cov.shape + n / 2, spec.cov.scale + 0.5 * (v**2).sum(axis=0), rng), 1e-12)
        if it >= spec.burn:
            kept.append(np.r_[coef.ravel(), low[np.tril_indices(m, -1)], d])
    return np.array(kept)


@pytest.mark.parametrize("prior", list(priors.PRIORS))
@pytest.mark.parametrize("lags", [Lags(1), Lags(har=(5, 22), include_mean=False)])
def test_moments_draw_what_rows_draw(spark, prior, lags):
    pdf = weekly_prices(spark, "/root/testdata/sf0.001").df.orderBy("t").toPandas()[["y_A", "y_N", "y_R"]]
    y = pdf.interpolate(limit_direction="both").to_numpy(dtype=float)
    x, r = backtest.design_arrays(y, lags)
    spec = priors.BayesSpec(priors.PRIORS[prior](), n_iter=25, burn=15)
    want = row_form(x, r, lags, spec, np.random.default_rng(7))
    got = gibbs.run_moments(moments.Moments.of(backtest.design_rows(y, lags)), lags, spec, np.random.default_rng(7))
    k, m = x.shape[1], 3
    coef = np.swapaxes(got["alpha"].reshape(10, m, -1), 1, 2)
    if lags.include_mean:
        coef = np.concatenate([coef, got["c"][:, None]], axis=1)
    mine = np.hstack([coef.reshape(10, k * m), got["a"], got["d"]])
    gap = np.abs(mine - want) / np.abs(want).max(axis=0)
    assert gap.max() < (1e-8 if lags.include_mean else 1e-6)  # without a constant the row form itself rounds beside large means


def test_no_row_reaches_the_sampler(spark, y):
    sf = frame(spark, y)
    fit = mcmc.var_bayes(sf, 1, priors.BayesSpec(n_iter=4, burn=2))
    plan = fit.draws._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "y1" not in plan and "FlatMapGroups" not in plan
    windows = mcmc.backtest(sf, Lags(1), priors.BayesSpec(n_iter=4, burn=2), 290, 1, 300)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :].split("FlatMapGroupsInPandas")[0]
    assert "moments" in below and "y1" not in below


def test_sparse_impacts_are_recorded_and_used(y):
    x, r = backtest.design_arrays(y, Lags(1))
    out = gibbs.run_chain(x, r, Lags(1), priors.BayesSpec(priors.Horseshoe(), n_iter=40, burn=20), np.random.default_rng(1))
    coef = np.concatenate([np.swapaxes(out["alpha"].reshape(20, 2, 2), 1, 2), out["c"][:, None]], axis=1)
    for i in range(20):
        e = r - x @ coef[i]
        size, gain = abs(out["a"][i, 0]), abs(out["a"][i, 0]) * (e[:, 0] ** 2).sum()
        assert abs(out["a_sparse"][i, 0]) == pytest.approx(size * max(gain - 1 / size**2, 0) / gain, rel=1e-6)
    assert np.array_equal(out["c"], out["c_sparse"])
    d = mcmc.Draws(out | {"a_sparse": np.zeros((20, 1))}, Lags(1), 2, True)
    assert np.allclose(d.low, np.eye(2)) and np.allclose(d.covariances()[:, 0, 1], 0)


class Ridge(priors.Shrinkage):
    pass


class RidgePrior(gibbs.Prior):
    """One normal variance for all coefficients; it counts its steps."""

    steps = 0

    def coef_prec(self, alpha, rng):
        self.steps += 1
        return np.full(self.shape, 1e6)

    def records(self):
        return {"steps": np.array([self.steps])}


def test_a_prior_of_ones_own_travels_to_workers(spark, y):
    with pytest.raises(ValueError, match="registered"):
        mcmc.var_bayes(frame(spark, y), 1, priors.BayesSpec(Ridge()))
    gibbs.register(Ridge, RidgePrior)
    draws = mcmc.var_bayes(frame(spark, y), 1, priors.BayesSpec(Ridge(), n_iter=12, burn=8)).draws.toPandas()
    assert sorted(draws[(draws.param == "steps") & (draws.chain == 1)].value) == [9, 10, 11, 12]
    assert draws[draws.param == "alpha"].value.abs().max() < 0.01
    del gibbs.SAMPLERS[Ridge]


@pytest.mark.parametrize("n", [1, 2, 3, 13])
def test_walks_by_stretches_keep_the_law(n):
    r = np.random.default_rng(n)
    w, v, h0, var, times = r.random((n, 2)) + 0.3, r.standard_normal((n, 2)), r.standard_normal(2), np.array([0.5, 0.2]), 20_000
    got = np.array([volatility.draw_walk(w, v, h0, var, r) for _ in range(times)])
    for j in range(2):
        q = 1 / var[j]
        prec = np.diag(w[:, j] + 2 * q) - q * (np.eye(n, k=1) + np.eye(n, k=-1))
        prec[-1, -1] -= q
        cov = np.linalg.inv(prec)
        mean = cov @ (v[:, j] + np.r_[q * h0[j], np.zeros(n - 1)])
        assert np.abs(got[:, :, j].mean(axis=0) - mean).max() < 4.5 * np.sqrt(cov.max() / times)
        assert np.abs(np.cov(got[:, :, j].T).reshape(n, n) - cov).max() < 0.06 * cov.max()


def test_spillovers_by_date_match_each_draw(spark, y):
    fit = mcmc.var_bayes(frame(spark, y[:40]), 1, priors.BayesSpec(priors.Horseshoe(), priors.StochasticVolatility(), chains=2, n_iter=8, burn=4))
    fit = fit.with_draws(fit.draws.persist())
    got = mcmc.spillover_draws(fit, 4, times=list(range(39))).toPandas()
    assert len(got) == 2 * 4 * 39 * 4
    values = mcmc._arrays(fit.draws.toPandas())
    d = mcmc.Draws(values, Lags(1), 2)
    at = got.set_index(["chain", "iteration", "t", "series", "shock"]).spillover
    for t in (0, 17, 38):
        for i, (b, s) in enumerate(zip(d.lag_coef, d.covariances(t), strict=True)):
            want = structure.connectedness(b, s, 1, 4)
            assert np.allclose(want.ravel(), [at[i // 4 + 1, i % 4 + 1, t, a, c] for a in ("y1", "y2") for c in ("y1", "y2")])
    some = mcmc.spillover_draws(fit, 4, times=[3, 20]).select("t").distinct().collect()
    assert {r["t"] for r in some} == {3, 20}


def test_panels_are_kept_apart_or_refused(spark):
    r = np.random.default_rng(9)
    both = np.zeros((2, 300, 1))
    for p, slope in enumerate((0.9, -0.9)):
        for t in range(1, 300):
            both[p, t] = slope * both[p, t - 1] + r.standard_normal()
    sf = frame(spark, both, ("a", "b"))
    one = {k: frame(spark, both[i]) for i, k in enumerate(("a", "b"))}
    from vectide.operators import forecast, ols, tuning

    for f in (lambda: ols.var_lm(sf), lambda: niw.var_minnesota(sf), lambda: niw.sample_sd(sf), lambda: tuning.choose_var(sf, spark, 2), lambda: sf.last_rows(1), lambda: mcmc.predict(mcmc.var_bayes(sf), one["a"], 1)):
        with pytest.raises(ValueError, match="panel"):
            f()
    fits = ols.panel_coefficients(ols.fit_panel(sf, Lags(1)), sf, Lags(1)).toPandas()
    slopes = mcmc.var_bayes(sf, 1, priors.BayesSpec(n_iter=60, burn=20)).draws.filter("param = 'alpha'").groupBy("k").agg(F.avg("value")).toPandas().set_index("k")["avg(value)"]
    roll = backtest.forecast_roll(sf, Lags(1), 100, 2).toPandas()
    expand = backtest.forecast_expand(sf, Lags(1), 100, 2, 300).toPandas()
    spill = backtest.dynamic_spillover(sf, Lags(1), 290, 2).toPandas()
    sampled = mcmc.backtest(sf, Lags(1), priors.BayesSpec(n_iter=20, burn=10, chains=1), 297, 1, 300).toPandas()
    ahead = forecast.predict_panel(sf, Lags(1), 3).toPandas()
    assert len(sampled) == 2 * 3 and len(spill) == 2 * 11
    for k, sign in (("a", 1), ("b", -1)):
        want = ols.var_lm(one[k])
        got = fits[fits.k == k].set_index("term").estimate
        assert np.allclose([got["y1_1"], got["const"]], want.coef[:, 0]) and sign * slopes[k] > 0.75
        for mine, theirs in ((roll, backtest.forecast_roll(one[k], Lags(1), 100, 2)), (expand, backtest.forecast_expand(one[k], Lags(1), 100, 2, 300))):
            x, z = mine[mine.k == k].sort_values("window"), theirs.toPandas().sort_values("window")
            assert len(x) == len(z) == 199 and np.allclose(x.forecast, z.forecast)
        assert np.allclose(ahead[ahead.k == k].sort_values("h").forecast, forecast.predict(want, one[k], 3).orderBy("h").toPandas().forecast)
    assert normal_quantile(0.5) == 0


def test_a_long_series_is_sampled_by_stretches(spark):
    r = np.random.default_rng(2)
    h = np.cumsum(0.2 * r.standard_normal((230, 2)), axis=0)
    y = np.zeros((230, 2))
    for t in range(1, 230):
        y[t] = 0.6 * y[t - 1] + np.exp(h[t] / 2) * r.standard_normal(2)
    sf, spec = frame(spark, y), priors.BayesSpec(priors.Minnesota(lam=1.0), priors.StochasticVolatility(), chains=1, n_iter=40, burn=16)
    fit = volatility.fit_long(sf, Lags(1), spec, 50)
    levels = fit.levels.toPandas()
    memory = gibbs.run_chain(*backtest.design_arrays(y, Lags(1)), Lags(1), priors.BayesSpec(spec.prior, spec.cov, n_iter=600, burn=200), r)["h"].mean(axis=0).reshape(-1, 2)
    assert len(levels) == 229 * 2 and levels.t.min() == 2 and levels.t.max() == 230
    for j, name in enumerate(("y1", "y2")):
        got = levels[levels.series == name].sort_values("t").log_var.to_numpy()
        # a long chain in memory has the same posterior mean
        assert np.corrcoef(got, h[1:, j])[0, 1] > 0.7 and np.corrcoef(got, memory[:, j])[0, 1] > 0.75
    draws = fit.draws.toPandas()
    assert sorted(draws.param.unique()) == ["a", "a_sparse", "alpha", "alpha_sparse", "c", "c_sparse", "h0", "sigh"] and draws.iteration.max() == 24
    slope = draws[(draws.param == "alpha") & draws.idx.isin([1, 4])].value.mean()
    assert abs(slope - 0.6) < 0.15
    few = priors.BayesSpec(priors.Minnesota(lam=1.0), priors.StochasticVolatility(), chains=1, n_iter=3, burn=2)
    one, two = (volatility.fit_long(x, Lags(1), few, 50).draws.toPandas() for x in (sf, sf.with_df(sf.df.repartition(5))))
    assert np.allclose(one.value, two.value, rtol=1e-6, atol=1e-9)


def test_stretches_in_tasks_draw_what_memory_draws():
    """A walk eliminated and filled stretch by stretch is the draw of the whole precision with the same noise."""
    r = np.random.default_rng(5)
    w, v, h0, q = r.random((23, 2)) + 0.3, r.standard_normal((23, 2)), r.standard_normal(2), np.array([2.0, 5.0])
    parts = [slice(0, 10), slice(10, 11), slice(11, 23)]
    gone = [volatility.eliminated(w[None, s][:, :-1], v[None, s][:, :-1], q) for s in parts]
    left = [np.concatenate([g[i] for g in gone]) for i in range(1, 6)]

    class Quiet:
        def standard_normal(self, shape):
            return np.zeros(shape)

    ends = volatility.points(left, np.stack([w[s][-1] for s in parts]), np.stack([v[s][-1] for s in parts]), np.array([False, False, True]), h0, q, Quiet())
    before = np.vstack([h0, ends[:-1]])
    got = np.concatenate([np.concatenate([volatility.filled(g[0], before[i][None], ends[i][None], q, np.zeros((1, s.stop - s.start - 1, 2)))[0], ends[i][None]]) for i, (g, s) in enumerate(zip(gone, parts, strict=True))])
    for j in range(2):  # without noise it is the mean
        prec = np.diag(w[:, j] + 2 * q[j]) - q[j] * (np.eye(23, k=1) + np.eye(23, k=-1))
        prec[-1, -1] -= q[j]
        assert np.allclose(got[:, j], np.linalg.solve(prec, v[:, j] + np.r_[q[j] * h0[j], np.zeros(22)]))
