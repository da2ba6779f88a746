"""Models against NumPy on simulated series, and Spark's queries against their SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions.design import Lags, group_matrix, har_matrix, minnesota_dummies, with_design
from vectide.functions.special import beta_inc, gamma_from_mode, t_two_sided
from vectide.operators import backtest, criteria, forecast, gibbs, gram, mcmc, niw, ols, posterior, priors, rng, simulate, structure, tuning
from vectide.sources.series import SeriesFrame, blocked, interpolate, split_tail, time_index

A = np.array([[0.5, 0.1], [0.0, 0.4], [0.2, -0.3]])  # y_{t-1} and constant by response
S = np.array([[1.0, 0.3], [0.3, 0.5]])


def frame(spark, y):
    rows = [(i + 1, *map(float, r)) for i, r in enumerate(y)]
    names = tuple(f"y{j + 1}" for j in range(y.shape[1]))
    return SeriesFrame(spark.createDataFrame(rows, "t long, " + ", ".join(f"{c} double" for c in names)), names)


@pytest.fixture(scope="module")
def y():
    return simulate.sim_path(A, S, Lags(1), 400, rng=np.random.default_rng(3))


@pytest.fixture(scope="module")
def sf(spark, y):
    return frame(spark, y)


def dense(y, lags):
    x, r = backtest.design_arrays(y, lags)
    return x, r, np.linalg.lstsq(x, r, rcond=None)[0]


@pytest.mark.parametrize("lags", [Lags(1), Lags(3), Lags(2, None, False), Lags(har=(5, 22)), Lags(har=(3, 9), include_mean=False)])
def test_ols_matches_numpy_and_solvers_agree(sf, y, lags):
    x, r, b = dense(y, lags)
    fits = [ols.fit_ols(sf, lags, m) for m in ("nor", "chol", "qr")]
    for f in fits:
        assert np.allclose(f.coef, b, atol=1e-8)
    e = r - x @ b
    assert np.allclose(fits[0].sigma, e.T @ e / (len(r) - x.shape[1]))
    roots = structure.stable_roots(fits[0])
    assert len(roots) == 2 * lags.order and structure.is_stable(fits[0])


def test_recovers_the_truth(sf):
    f = ols.var_lm(sf, 1)
    assert np.abs(f.coef - A).max() < 0.15 and np.abs(f.sigma - S).max() < 0.2


def test_blocks_change_nothing(sf):
    for lags in (Lags(2), Lags(har=(5, 22))):
        cols = lags.terms(sf.names)
        a, b = (with_design(sf, lags, n).orderBy("t").select("t", *cols).toPandas().to_numpy() for n in (10**6, 37))
        assert np.allclose(a, b)
    rows, keys, own = blocked(sf, 2, 50)
    assert rows.filter(own).count() == 400 and "__block" in keys


def test_har_is_a_restricted_var(sf, y):
    h = har_matrix(2, 5, 22)
    x22, _ = backtest.design_arrays(y, Lags(22))
    xh, _ = backtest.design_arrays(y, Lags(har=(5, 22)))
    assert h.shape == (7, 45) and np.allclose(x22 @ h.T, xh)


def test_short_input_is_refused(spark):
    with pytest.raises(ValueError, match="few"):
        ols.var_lm(frame(spark, np.random.default_rng(0).standard_normal((3, 2))), 2)
    with pytest.raises(ValueError, match="numeric"):
        SeriesFrame(spark.createDataFrame([(1, "a")], "t long, y string"), ("y",))
    bad = SeriesFrame(spark.createDataFrame([(1, None), (2, 1.0)], "t long, y double"), ("y",))
    with pytest.raises(ValueError, match="null"):
        bad.check()
    with pytest.raises(ValueError, match="gaps"):
        SeriesFrame(spark.createDataFrame([(1, 1.0), (1, 1.0)], "t long, y double"), ("y",)).check()


def test_interpolation_and_index(spark):
    s = SeriesFrame(spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 3.0), (5, None)], "t long, y double"), ("y",))
    assert [r["y"] for r in interpolate(s).df.orderBy("t").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    df = spark.sql("SELECT DATE'2020-01-01' + CAST(id AS INT) * 200 AS d FROM range(9)")
    assert [r["t"] for r in time_index(df, "d").orderBy("d").collect()] == list(range(1, 10))
    a, b = split_tail(s, 2)
    assert a.count() == 3 and b.count() == 2


def test_groups_and_dummies():
    assert group_matrix(3, 2, "longrun").tolist() == [[2, 1], [1, 2], [4, 3], [3, 4], [6, 5], [5, 6]]
    assert group_matrix(3, 2, "short").tolist() == [[2, 1], [1, 2], [3, 3], [3, 3], [4, 4], [4, 4]]
    assert (group_matrix(3, 2, "no") == 1).all()
    yd, xd = minnesota_dummies(np.array([1.0, 2.0]), 2, 0.5, np.array([1.0, 0.0]))
    assert yd.shape == (7, 2) and xd.shape == (7, 5) and yd[0, 0] == 2.0 and xd[3, 3] == 8.0
    assert Lags(2).terms(("x", "y")) == ["x_1", "y_1", "x_2", "y_2", "const"]


def test_gram_by_python_matches_jvm(sf, monkeypatch):
    d = with_design(sf, Lags(2))
    xs, ys = Lags(2).terms(sf.names), list(sf.names)
    a = gram.gram(d, xs, ys)
    monkeypatch.setattr(gram, "JVM_COLUMNS", 0)
    b = gram.gram(d, xs, ys)
    assert np.allclose(a.xx, b.xx) and np.allclose(a.xy, b.xy) and np.allclose(a.yy, b.yy) and a.n == b.n


def test_special_functions():
    assert abs(beta_inc(2, 3, 0.4) - 0.5248) < 1e-10
    assert abs(t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    shape, rate = gamma_from_mode(0.2, 0.4)
    assert abs((shape - 1) / rate - 0.2) < 1e-12 and abs(np.sqrt(shape) / rate - 0.4) < 1e-12


def test_structure(sf, spark):
    f = ols.var_lm(sf, 2)
    w = structure.model_vma(f, 6)
    c = structure.companion(f.lag_coef, 2, 2)
    p = np.eye(4)
    for h in range(7):
        assert np.allclose(w[h], p[:2, :2].T)
        p = c @ p
    table = structure.fevd(w, f.sigma)
    assert np.allclose(table.sum(axis=2), 1)
    m = structure.spillover_margins(structure.spillover(f, spark, 5)).toPandas()
    assert abs(m["net"].sum()) < 1e-9 and (m["total"] > 0).all()
    mse = structure.forecast_mse(f, 3)
    assert np.allclose(mse[0], f.sigma) and np.allclose(mse[1], f.sigma + w[1].T @ f.sigma @ w[1])


def test_windows_match_refits(sf, y):
    for lags in (Lags(1), Lags(2, None, False), Lags(har=(3, 6))):
        r = backtest.forecast_roll(sf, lags, 60, 2, 400).toPandas()
        e = backtest.forecast_expand(sf, lags, 60, 2, 400).toPandas()
        assert len(r) == len(e) == 2 * (400 - 60 - 2 + 1)
        for i in (0, 17, 338):
            for df, lo in ((r, i), (e, 0)):
                x, t, b = dense(y[lo : i + 60], lags)
                f = forecast.path(lags.transform(2).T @ b, y[i + 60 - lags.order : i + 60], lags.order, 2)[-1]
                assert np.allclose(df[df.window == i].set_index("series").loc[["y1", "y2"], "forecast"], f)
    d = backtest.dynamic_spillover(sf, Lags(1), 100, 4).toPandas()
    assert d.t_end.nunique() == 301 and np.allclose(d.groupby(["t_end", "series"]).spillover.sum(), 100)


def test_windows_over_many_blocks(sf, monkeypatch):
    args = (sf, Lags(2), 30, 1, 400)
    roll, expand = (f(*args).orderBy("window", "series").toPandas() for f in (backtest.forecast_roll, backtest.forecast_expand))
    monkeypatch.setattr(backtest, "BLOCK_WINDOWS", 41)
    for f, whole in ((backtest.forecast_roll, roll), (backtest.forecast_expand, expand)):
        assert np.allclose(f(*args).orderBy("window", "series").toPandas()["forecast"], whole["forecast"])


def test_conjugate_models(sf, y):
    x, r, b = dense(y, Lags(1))
    flat = niw.var_flat(sf, 1, 1e-9)
    assert np.allclose(flat.coef, b, atol=1e-6)
    spec = priors.MinnesotaSpec((1.0, 1.0), 0.2, 1.0)
    p = niw.var_minnesota(sf, 1, spec)
    yd, xd = minnesota_dummies(np.ones(2), 1, 0.2, np.ones(2))
    both_x, both_y = np.vstack([xd, x]), np.vstack([yd, r])
    assert np.allclose(p.coef, np.linalg.lstsq(both_x, both_y, rcond=None)[0], atol=1e-8)
    e = both_y - both_x @ p.coef
    assert np.allclose(p.scale, e.T @ e) and p.shape == p.prior_shape + p.n
    a, s = niw.draw_mniw(p, 4000, np.random.default_rng(1))
    assert np.abs(a.mean(axis=0) - p.coef).max() < 0.02 and np.abs(s.mean(axis=0) - p.sigma).max() < 0.02
    direct = sum(0.5 * v * np.linalg.slogdet(m)[1] for v, m in ((2, p.prior_prec), (-2, p.prec), (p.prior_shape, p.prior_scale), (-p.shape, p.scale)))
    from vectide.functions.special import log_mv_gamma

    direct += -2 * p.n / 2 * np.log(np.pi) + log_mv_gamma(p.shape / 2, 2) - log_mv_gamma(p.prior_shape / 2, 2)
    assert abs(direct - criteria.log_ml(p)) < 1e-6
    spec2, _, ml = tuning.choose_bayes(sf, 1, spec=spec)
    assert ml >= criteria.log_ml(p) - 1e-6


def test_minimise_in_a_box():
    f = lambda z: (z[0] - 3) ** 2 + 10 * (z[1] + z[0]) ** 2
    assert np.allclose(tuning.minimise(f, np.zeros(2), np.full(2, -9.0), np.full(2, 9.0)), [3, -3], atol=1e-3)
    assert np.allclose(tuning.minimise(f, np.zeros(2), np.zeros(2), np.ones(2)), [3 / 11, 0], atol=1e-3)


def test_gig_moments():
    r = np.random.default_rng(1)
    for lam, psi, chi in ((0.5, 2.0, 3.0), (-0.7, 1.0, 0.5), (3.0, 0.1, 4.0), (0.2, 1e-3, 1e-3)):
        x = rng.gig(np.full(40_000, lam), psi, chi, r)
        t = np.linspace(-25, 25, 200_001)
        logd = lam * t - 0.5 * (psi * np.exp(t) + chi * np.exp(-t))
        w = np.exp(logd - logd.max())
        assert abs(np.log(x).mean() - (w * t).sum() / w.sum()) < 0.08


@pytest.mark.parametrize("prior", list(priors.PRIORS))
@pytest.mark.parametrize("cov", [priors.Ldlt(), priors.StochasticVolatility()])
def test_samplers_recover_coefficients(y, prior, cov):
    x, r = backtest.design_arrays(y, Lags(1))
    spec = priors.BayesSpec(priors.PRIORS[prior](), cov, n_iter=250, burn=100)
    out = gibbs.run_chain(x, r, Lags(1), spec, np.random.default_rng(5))
    alpha = out["alpha"].mean(axis=0).reshape(2, 2).T
    assert np.isfinite(out["alpha"]).all() and np.abs(alpha - A[:2]).max() < 0.25
    if "d" in out:
        low = np.linalg.cholesky(S)
        impact = -low[1, 0] / low[0, 0]
        assert abs(out["a"].mean() - impact) < 0.15
        assert np.allclose(out["d"].mean(axis=0), np.diag(low) ** 2, atol=0.2)
    again = gibbs.run_chain(x, r, Lags(1), spec, np.random.default_rng(5))
    assert np.array_equal(out["alpha"], again["alpha"])


def test_log_volatility_follows_the_state():
    r = np.random.default_rng(2)
    h = np.cumsum(0.15 * r.standard_normal((600, 1)), axis=0)
    v = np.exp(h / 2) * r.standard_normal((600, 1))
    now, kept = np.zeros((600, 1)), []
    for i in range(300):
        now = gibbs.draw_log_vol(v, now, np.zeros(1), np.array([0.0225]), r)
        if i >= 100:
            kept.append(now)
    assert np.corrcoef(np.mean(kept, axis=0)[:, 0], h[:, 0])[0, 1] > 0.7


def test_draws_do_not_depend_on_partitions(spark, sf):
    spec = priors.BayesSpec(priors.Horseshoe(), n_iter=8, burn=4)
    a = mcmc.var_bayes(sf, 1, spec).draws.orderBy("chain", "param", "iteration", "idx").toPandas()
    b = mcmc.var_bayes(sf.with_df(sf.df.repartition(7)), 1, spec).draws.orderBy("chain", "param", "iteration", "idx").toPandas()
    assert a.equals(b) and set(a.chain) == {1, 2}


def test_density_forecasts_and_spillovers(spark, sf):
    spec = priors.BayesSpec(priors.Minnesota(), n_iter=60, burn=20)
    fit = mcmc.var_bayes(sf, 1, spec)
    fit = fit.with_draws(fit.draws.persist())
    d = forecast.summarise(mcmc.predict(fit, sf, 3)).toPandas()
    assert len(d) == 6 and (d.lower < d.upper).all() and (d.lower_joint <= d.lower).all()
    s = mcmc.spillover_summary(mcmc.spillover_draws(fit, 4)).toPandas()
    assert np.allclose(s.groupby("series").spillover.sum(), 100)
    p = niw.var_minnesota(sf, 1)
    for along in ("mean", "draw"):
        q = forecast.summarise(forecast.predict_density(p, sf, 2, 800, along=along)).filter("h = 1").orderBy("series").toPandas()
        point = forecast.path(p.lag_coef, np.array(sf.last_rows(1)), 1, 1)[0]
        assert np.abs(q.forecast - point).max() < 0.15
    r = posterior.rhat(fit.draws.filter("param = 'alpha'")).toPandas()
    assert (r.rhat < 1.5).all()
    b = mcmc.backtest(sf, Lags(1), priors.BayesSpec(priors.Minnesota(), n_iter=20, burn=10), 397, 1, 400).toPandas()
    assert sorted(b.window.unique()) == [0, 1, 2] and sorted(b.t.unique()) == [398, 399, 400] and np.isfinite(b.lpl).all()


def test_panel_forecast(spark, y):
    rows = [(k, i + 1, *map(float, r)) for k in ("a", "b") for i, r in enumerate(y[:80] * (1 if k == "a" else 2))]
    p = SeriesFrame(spark.createDataFrame(rows, "k string, t long, y1 double, y2 double"), ("y1", "y2"), ("k",))
    out = forecast.predict_panel(p, Lags(1), 2).toPandas()
    _, _, b = dense(y[:80], Lags(1))
    f = forecast.path(b, y[79:80], 1, 2)
    assert np.allclose(out[out.k == "a"].sort_values(["h", "series"]).forecast, f.ravel())


def test_simulation(spark):
    d = simulate.sim_mnormal(spark, 25_000, np.array([1.0, -1.0]), S).toPandas()
    assert len(d) == 25_000 and np.abs(np.cov(d[["y1", "y2"]].T) - S).max() < 0.05
    v = simulate.sim_var(spark, A, S, Lags(1), 50, paths=3, df=5).toPandas()
    assert v.groupby("path").t.max().tolist() == [50, 50, 50]
    a = simulate.sim_matgaussian(np.zeros((4, 5)), 3 * np.eye(4), np.eye(5), 2, 7)
    assert np.allclose(a, simulate.sim_matgaussian(np.zeros((4, 5)), np.eye(4) / 3, np.eye(5), 2, 7, precision=True))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bayes_queries_use_all_weeks(spark, monkeypatch):
    from vectide.plans import catalog

    d = "/root/testdata/sf0.001"
    weeks = catalog.weekly_prices(spark, d).count()
    seen = []
    fit = mcmc.fit_bayes
    monkeypatch.setattr(mcmc, "fit_bayes", lambda sf, lags, spec=None: seen.append((sf.count(), spec.n_iter, spec.burn)) or fit(sf, lags, spec))
    for name in ("var_bayes_horseshoe_ldlt", "vhar_bayes_horseshoe_ldlt", "predict_density_bayes", "spillover_posterior"):
        catalog.queries()[name](spark, d)
    draws, windows = [], []
    monkeypatch.setattr(mcmc, "spillover_summary", lambda x: x)
    monkeypatch.setattr(mcmc, "spillover_draws", lambda fit, step, times: draws.append(times))
    monkeypatch.setattr(mcmc, "dynamic_spillover", lambda sf, lags, spec, window, n, step: windows.append((sf.count(), n, spec.n_iter)))
    catalog.dynamic_spillover_sv(spark, d)
    catalog.dynamic_spillover_mcmc(spark, d)
    assert draws == [list(range(weeks - 1))] and windows == [(weeks, weeks, 200)]
    assert seen == [(weeks, 1_000, 500)] * 5


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e8])
@pytest.mark.parametrize("columns", [24, 2])
def test_least_squares_beside_a_large_mean(spark, monkeypatch, mean, columns):
    from vectide.operators import gram

    monkeypatch.setattr(gram, "JVM_COLUMNS", columns)
    r = np.random.default_rng(3)
    y = np.zeros((400, 2))
    for t in range(1, 400):
        y[t] = 0.5 * y[t - 1] + r.standard_normal(2)
    x, z = np.column_stack([y[:-1], np.ones(399)]), y[1:]
    want = np.linalg.lstsq(x, z, rcond=None)[0]
    cov = (z - x @ want).T @ (z - x @ want) / (399 - 3)
    sf = SeriesFrame(spark.createDataFrame([(i + 1, *map(float, v + mean)) for i, v in enumerate(y)], "t long, a double, b double"), ("a", "b"))
    se = np.sqrt(np.outer(np.diag(np.linalg.inv(x.T @ x)), np.diag(cov)))
    for method in ("nor", "chol", "qr"):
        m = ols.fit_ols(sf, Lags(1), method)
        tol = 1e-6 if mean else 1e-10
        assert np.allclose(m.coef[:2], want[:2], rtol=tol, atol=tol) and np.allclose(m.sigma, cov, rtol=10 * tol)
    found = {(x["term"], x["response"]): x["std_error"] for x in ols.infer(m, spark).collect()}
    assert all(abs(found[f"{c}_1", v] / se[i, j] - 1) < 1e-5 for i, c in enumerate("ab") for j, v in enumerate("ab"))
    roll = backtest.forecast_roll(sf, Lags(1), 200, 1, 400).toPandas()
    expand = backtest.forecast_expand(sf, Lags(1), 200, 1, 400).toPandas()
    for got, start in ((roll, 100), (expand, 0)):
        b = np.linalg.lstsq(x[start : 299], z[start : 299], rcond=None)[0]
        f = got[(got.t == 301) & (got.series == "a")].forecast.item()
        assert abs(f - mean - (np.r_[y[299], 1] @ b)[0]) < (1e-6 if mean < 1e8 else 1e-5)


def test_conjugate_models_beside_a_large_mean(spark):
    from vectide.operators import niw
    from vectide.operators.gram import Gram

    r = np.random.default_rng(5)
    x, y = r.standard_normal((300, 2)), r.standard_normal((300, 2))
    one = np.ones((300, 1))
    prior = Gram.of(np.eye(3) * 0.5, np.ones((3, 2)))
    plain, scale = niw.fitted(Gram.of(np.hstack([x, one]), y), prior)
    got, other = niw.fitted(Gram.of(np.hstack([x, one]), y, True), prior)
    assert np.allclose(plain, got) and np.allclose(scale, other)
    weak = Gram(np.diag([1e-3, 1e-3, 0.0]), np.zeros((3, 2)), np.zeros((2, 2)), 0)
    near, scale = niw.fitted(Gram.of(np.hstack([x, one]), y, True), weak)
    far, other = niw.fitted(Gram.of(np.hstack([x + 1e8, one]), y + 1e8, True), weak)
    assert np.allclose(near[:2], far[:2], atol=1e-6) and np.allclose(scale, other, rtol=1e-5, atol=1e-4)


def test_interpolation_by_blocks(spark):
    from vectide.sources.series import interpolate

    r = np.random.default_rng(2)
    rows = [(k, t, None if r.random() < 0.6 or (k == 2 and t < 9) else float(r.integers(100)), None if t != 11 else 3.0) for k in (1, 2) for t in range(1, 24)]
    df = spark.createDataFrame(rows, "k int, t long, a double, b double")
    for size in (100_000, 4, 1):
        got = interpolate(SeriesFrame(df, ("a", "b"), ("k",)), size).df.orderBy("k", "t").toPandas()
        assert got.columns.tolist() == df.columns and (got.b == 3).all()
        for k, g in got.groupby("k"):
            have = [(t, a) for p, t, a, _ in rows if p == k and a is not None]
            assert np.allclose(g.a, np.interp(np.arange(1, 24), *zip(*have, strict=True)))


def test_blocks_of_windows_sample_alike(spark, sf, monkeypatch):
    spec = priors.BayesSpec(priors.Horseshoe(), chains=2, n_iter=12, burn=4)
    for expanding in (False, True):
        key = ["window", "chain", "series"]
        a = mcmc.backtest(sf, Lags(1), spec, 390, 2, 400, expanding).orderBy(*key).toPandas()
        with monkeypatch.context() as m:
            m.setattr(mcmc, "WINDOW_TASKS", 4)
            b = mcmc.backtest(sf, Lags(1), spec, 390, 2, 400, expanding).orderBy(*key).toPandas()
        assert len(a) == 9 * 2 * 2 and a.equals(b)
    fit = mcmc.var_bayes(split_tail(sf, 10)[0], 1, spec)
    c = mcmc.backtest(sf, Lags(1), spec, 390, 2, 400, False, fit=fit).orderBy(*key).toPandas()
    rolled = mcmc.backtest(sf, Lags(1), spec, 390, 2, 400).orderBy(*key).toPandas()
    assert c[c.window > 0].reset_index(drop=True).equals(rolled[rolled.window > 0].reset_index(drop=True)) and (c.window == 0).sum() == 4


def test_selected_and_stable_forecasts(spark, sf):
    fit = mcmc.var_bayes(sf, 1, priors.BayesSpec(priors.Minnesota(), chains=1, n_iter=60, burn=20))
    fit = fit.with_draws(fit.draws.persist())
    zero = mcmc._zeroed(fit, 0.95)
    assert not zero[0] and zero.dtype == bool and len(zero) == 4
    assert mcmc.predict(fit, sf, 3, sparse=0.95, stable=True).count() == 40 * 3 * 2
    wild = fit.with_draws(fit.draws.withColumn("value", F.when(F.col("param") == "alpha", 2.0).otherwise(F.col("value"))))
    with pytest.raises(ValueError, match="stable"):
        mcmc.predict(wild, sf, 3, stable=True)


def test_spillovers_of_conjugate_draws(spark, sf):
    post = niw.var_minnesota(sf, 1)
    draws = niw.spillover_draws(post, spark, 5, 300).persist()
    plug = structure.connectedness(post.lag_coef, post.sigma, 1, 5)
    mean = draws.groupBy("series", "shock").avg("spillover").toPandas().set_index(["series", "shock"])["avg(spillover)"]
    assert all(abs(mean[a, b] - plug[i, j]) < 2 for i, a in enumerate(sf.names) for j, b in enumerate(sf.names))
    margins, nets = (x.toPandas() for x in mcmc.spillover_margins(draws))
    got = margins.set_index(["series", "measure"]).value
    a, b = sf.names
    assert abs(got[a, "to"] - mean[b, a]) < 1e-9 and abs(got[a, "from"] - mean[a, b]) < 1e-9 and abs(got[a, "net"] + got[b, "net"]) < 1e-9
    assert abs(margins[margins.measure == "total"].value.item() - (mean[a, b] + mean[b, a]) / 2) < 1e-9
    assert abs(nets[(nets.series == a)].net.item() - (mean[b, a] - mean[a, b]) / 2) < 1e-9 and (margins.lower <= margins.upper).all()
    dyn = backtest.dynamic_spillover_conjugate(sf, Lags(1), niw.dummies_of(priors.MinnesotaSpec(), Lags(1), niw.sample_sd(sf)), 390, 5, 50).toPandas()
    assert sorted(set(dyn.t_end)) == list(range(390, 401)) and np.allclose(dyn.groupby(["t_end", "series"]).spillover.sum(), 100)


def test_priors_refuse_bad_values():
    for make in (lambda: priors.Ssvs(s1=(1.0,)), lambda: priors.Ssvs(grid=1), lambda: priors.NormalGamma(shape_sd=0.0), lambda: priors.DirichletLaplace(scale=-1.0), lambda: priors.Horseshoe(groups="odd"), lambda: priors.Gdp(group_rate=0), lambda: priors.MinnesotaSpec(sigma=(1.0, 2.0), delta=(1.0,))):
        with pytest.raises(ValueError):
            make()
    assert priors.Minnesota(delta=0.0).delta == 0


def test_draws_are_written_and_read_back(spark, sf, tmp_path):
    from vectide.sources.sinks import read_draws, write_draws

    draws = niw.sample_posterior(niw.var_minnesota(sf, 1), spark, 20).persist()
    back = read_draws(spark, write_draws(draws, str(tmp_path / "draws")))
    key = ["param", "iteration", "idx"]
    assert back.orderBy(*key).toPandas().equals(draws.orderBy(*key).toPandas())
