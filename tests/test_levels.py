"""Scans in levels, ranks by range blocks, the tree of triangles, and convergence against plain versions."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions.design import Lags, with_design
from vectide.operators import ols, posterior, simulate
from vectide.sources.series import SeriesFrame, interpolate, scan, time_index


@pytest.mark.parametrize("levels", [1, 2, 3, 5])
def test_scans_of_one_row_blocks(spark, levels):
    r = np.random.default_rng(levels)
    rows = [(k, b, int(r.integers(100)), None if r.random() < 0.4 else int(r.integers(100))) for k in ("a", "b") for b in range(37) if r.random() < 0.8]
    parts = spark.createDataFrame(rows, "k string, block long, s long, m long").withColumn("n", F.col("m"))
    got = scan(parts, ["k"], "block", {"s": (F.sum, False), "m": (F.max, False), "n": (F.min, True)}, levels, 2).collect()
    assert len(got) == len(rows)
    for x in got:
        before = [y for y in rows if y[0] == x["k"] and y[1] < x["block"]]
        after = [y[3] for y in rows if y[0] == x["k"] and y[1] > x["block"] and y[3] is not None]
        known = [y[3] for y in before if y[3] is not None]
        assert (x["s"] or 0) == sum(y[2] for y in before) and x["m"] == max(known, default=None) and x["n"] == min(after, default=None)


def test_numbers_and_lines_over_levels(spark):
    df = spark.sql("SELECT k, TIMESTAMP_SECONDS(id * id * 9000) AS ts FROM range(60) CROSS JOIN VALUES (1), (2) v(k) WHERE k = 1 OR id % 3 = 0")
    got = time_index(df, "ts", F.unix_timestamp("ts") / 100_000, ["k"], 3).toPandas().sort_values(["k", "ts"])
    assert got[got.k == 1].t.tolist() == list(range(1, 61)) and got[got.k == 2].t.tolist() == list(range(1, 21))
    r = np.random.default_rng(2)
    rows = [(t, None if r.random() < 0.6 else float(r.integers(100))) for t in range(1, 40)]
    sf = SeriesFrame(spark.createDataFrame(rows, "t long, a double"), ("a",))
    have = [x for x in rows if x[1] is not None]
    for levels in (1, 2, 3):
        got = interpolate(sf, 1, levels).df.orderBy("t").toPandas().a
        assert np.allclose(got, np.interp(np.arange(1, 40), *zip(*have, strict=True)))


def test_the_tree_leaves_one_triangle(spark, monkeypatch):
    y = simulate.sim_path(np.array([[0.5, 0.1], [0.0, 0.4], [0.2, -0.3]]), np.eye(2), Lags(1), 200, rng=np.random.default_rng(1))
    sf = SeriesFrame(spark.createDataFrame([(i + 1, *map(float, v)) for i, v in enumerate(y)], "t long, a double, b double"), ("a", "b"))
    lags = Lags(1)
    xs, ys = lags.terms(sf.names), list(sf.names)
    design = with_design(sf, lags, 10)
    want, rss = ols.solve_qr(design, xs, ys)
    x = np.column_stack([y[:-1], np.ones(199)])
    assert np.allclose(want, np.linalg.lstsq(x, y[1:], rcond=None)[0])
    seen = []
    real = np.linalg.qr
    monkeypatch.setattr(np.linalg, "qr", lambda a, mode: seen.append(len(a)) or real(a, mode=mode))
    got, other = ols.solve_qr(design, xs, ys, 2)
    assert np.allclose(got, want) and np.allclose(rss, other) and seen == [5]  # what the driver got


def brute_rhat(v):
    """Rank-normalised split R-hat of (chains, iterations)."""
    from statistics import NormalDist

    def of(x):
        flat = x.ravel()
        order = np.sort(flat)
        rank = np.array([(np.searchsorted(order, t) + 1 + np.searchsorted(order, t, "right")) / 2 for t in flat])
        z = np.array([NormalDist().inv_cdf((k - 0.375) / (len(flat) + 0.25)) for k in rank]).reshape(x.shape)
        half = x.shape[1] // 2
        parts = np.concatenate([z[:, :half], z[:, half:]])
        w, b = parts.var(axis=1, ddof=1).mean(), parts.mean(axis=1).var(ddof=1)
        return np.sqrt(((half - 1) / half * w + b) / w)

    return of(v), of(np.abs(v - np.median(v)))


@pytest.mark.parametrize("blocks", [5])
def test_rank_normalised_rhat(spark, blocks):
    r = np.random.default_rng(3)
    draws = r.standard_cauchy((3, 2, 40)).round(1)  # parameters, chains, iterations; with ties
    draws[1, 1] += 3
    draws[2, 1] *= 9
    draws[0, 0, :20] = 0.0
    rows = [("alpha", p + 1, c + 1, i + 1, float(draws[p, c, i])) for p in range(3) for c in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "param string, idx int, chain int, iteration int, value double")
    got = {x["idx"]: x for x in posterior.rank_rhat(df, blocks).collect()}
    for p in range(3):
        bulk, tail = brute_rhat(draws[p])
        assert got[p + 1]["bulk"] == pytest.approx(bulk, abs=1e-9) and got[p + 1]["tail"] == pytest.approx(tail, abs=1e-9) and got[p + 1]["rhat"] == max(got[p + 1]["bulk"], got[p + 1]["tail"])
    with pytest.warns(UserWarning, match="R-hat"):
        high = {f"alpha[{p + 1}]" for p in range(3) if max(brute_rhat(draws[p])) >= 1.1}
        assert high == set(posterior.warn_unless_converged(df, 1.1)) and "alpha[3]" in high
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert posterior.warn_unless_converged(df, 99.0) == []


def test_ranks_within_panels(spark):
    df = spark.createDataFrame([(k, "c", 1, 1, i, float(v)) for k in ("a", "b") for i, v in enumerate((3, 1, 2, 2) if k == "a" else (5, 5, 5, 0))], "k string, param string, idx int, chain int, iteration int, value double")
    assert posterior.keys_of(df) == ["k", "param", "idx"]
    got = sorted((x["k"], x["iteration"], x["rank"]) for x in posterior.ranks(df, posterior.keys_of(df), "value", 3).collect())
    assert got == [("a", 0, 4.0), ("a", 1, 1.0), ("a", 2, 2.5), ("a", 3, 2.5), ("b", 0, 3.0), ("b", 1, 3.0), ("b", 2, 3.0), ("b", 3, 1.0)]
    assert posterior.summarise(df).count() == 2 and posterior.inclusion(df, 2).filter("param = 'c' AND pip = 1").count() >= 4


def test_ranks_do_not_depend_on_the_order_of_rows(spark):
    def shaken(batches):  # another order each time that the rows are read, as blocks of a shuffle come in
        for batch in batches:
            yield batch.sample(frac=1, random_state=int(np.random.default_rng().integers(1 << 31)))

    df = spark.range(0, 120_000, 1, 6).select(F.lit(1).alias("idx"), F.xxhash64("id").cast("double").alias("value")).mapInPandas(shaken, "idx int, value double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = posterior.ranks(df, ["idx"], "value").groupBy("idx").agg(F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.max("total")).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [tuple(x)[1:] for x in got] == [(120_000, 1.0, 120_000.0, 120_000)]


def test_kinds(spark):
    from vectide.operators import backtest, forecast, kinds, mcmc, niw, priors, structure, tuning

    y = np.random.default_rng(1).standard_normal((60, 2))
    sf = SeriesFrame(spark.createDataFrame([(i + 1, *map(float, v)) for i, v in enumerate(y)], "t long, a double, b double"), ("a", "b"))
    var, har, mn, flat, fit = ols.var_lm(sf), ols.vhar_lm(sf, (3, 6)), niw.vhar_minnesota(sf, (3, 6)), niw.var_flat(sf), mcmc.var_bayes(sf)
    sv = priors.BayesSpec(cov=priors.StochasticVolatility())
    assert kinds.is_ols(var) and kinds.is_var(var) and not kinds.is_vhar(var) and kinds.is_vhar(har) and kinds.is_vhar(mn) and kinds.is_var(fit)
    assert kinds.is_minnesota(mn) and not kinds.is_flat(mn) and kinds.is_flat(flat) and kinds.is_conjugate(flat) and not kinds.is_conjugate(var)
    assert kinds.is_sampled(fit) and not kinds.is_volatile(fit) and kinds.is_volatile(sv) and kinds.is_volatile(sv.cov) and kinds.is_covariance(sv.cov)
    assert kinds.is_prior(sv.prior, priors.Horseshoe) and not kinds.is_prior(sv.prior, priors.Ssvs) and kinds.is_spec(sv) and kinds.is_intercept(sv.intercept) and kinds.is_bounds(tuning.Bounds())
    assert kinds.is_forecast(forecast.predict(var, sf, 2)) and kinds.is_impulse(structure.irf(var, spark)) and kinds.is_spillover(structure.spillover(var, spark))
    assert kinds.is_backtest(backtest.forecast_roll(sf, Lags(1), 40, 1, 60)) and not kinds.is_backtest(var)
