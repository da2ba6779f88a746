"""Random walks of log variances, drawn in parallel over time.

Given weights w_t and weighted values r_t the walk h_1, ..., h_n from h_0 has a tridiagonal precision. The last row of each
stretch is an interface point. Given these points the rows inside a stretch are independent of all others, so a stretch is
eliminated apart: what it leaves behind is a 2 x 2 term between its two neighbouring points. The points have a tridiagonal
precision again, far shorter; once they are drawn, each stretch draws its rows. The law is that of a draw over all rows.

In memory the stretches are eliminated side by side. :func:`fit_long` keeps them as rows of a table and eliminates each in a
task; of a long series the driver holds one row for each stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.design import CONST, Lags, with_design
from vectide.operators.moments import Weighted
from vectide.operators.priors import BayesSpec, StochasticVolatility
from vectide.sources.series import SeriesFrame
from vectide.sources.sinks import dropped, kept_table


@dataclass(frozen=True)
class Inside:
    """Stretches (s), each of rows inside (l, perhaps none) for every series (m): the factor of their precision (diagonal and
    below), ``z`` (the right side after the forward sweep) and ``e``, the same for the coupling to the point before."""

    diag: np.ndarray
    below: np.ndarray
    z: np.ndarray
    e: np.ndarray


def eliminated(w: np.ndarray, r: np.ndarray, q: np.ndarray) -> tuple[Inside, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows inside of stretches (s, l, m) eliminated; ``q``: precision of a step (m). Returns the factor and what is left: at the
    point before (precision, value), at the point after (precision, value), and the coupling of both."""
    s, l, m = w.shape
    if not l:
        nothing = np.zeros((s, m))
        return Inside(w, w, r, r), nothing, nothing, nothing, nothing, np.broadcast_to(-q, (s, m))
    diag, below, z, e = (np.empty((s, l, m)) for _ in range(4))
    diag[:, 0] = np.sqrt(w[:, 0] + 2 * q)
    z[:, 0], e[:, 0] = r[:, 0] / diag[:, 0], q / diag[:, 0]
    below[:, 0] = 0.0
    for t in range(1, l):
        below[:, t] = -q / diag[:, t - 1]
        diag[:, t] = np.sqrt(w[:, t] + 2 * q - below[:, t] ** 2)
        z[:, t] = (r[:, t] - below[:, t] * z[:, t - 1]) / diag[:, t]
        e[:, t] = -below[:, t] * e[:, t - 1] / diag[:, t]
    last = q / diag[:, -1]  # forward sweep of the coupling to the point after: zero but in the last row
    return Inside(diag, below, z, e), -(e**2).sum(axis=1), (e * z).sum(axis=1), -(last**2), last * z[:, -1], -e[:, -1] * last


def filled(inside: Inside, before: np.ndarray, after: np.ndarray, q: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Rows inside, given the points around them (s, m) and standard normals (s, l, m)."""
    s, l, m = inside.diag.shape
    out = np.empty((s, l, m))
    if l:
        z = inside.z + inside.e * before[:, None] + noise
        out[:, -1] = (z[:, -1] + q / inside.diag[:, -1] * after) / inside.diag[:, -1]
        for t in range(l - 2, -1, -1):
            out[:, t] = (z[:, t] - inside.below[:, t + 1] * out[:, t + 1]) / inside.diag[:, t]
    return out


def draw_points(diag: np.ndarray, off: np.ndarray, rhs: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Points (s, m) from the tridiagonal precision with ``diag`` and couplings ``off`` (s - 1, m)."""
    n = len(diag)
    d, e, z, out = np.empty_like(diag), np.zeros_like(diag), np.empty_like(diag), np.empty_like(diag)
    d[0] = np.sqrt(diag[0])
    z[0] = rhs[0] / d[0]
    for t in range(1, n):
        e[t] = off[t - 1] / d[t - 1]
        d[t] = np.sqrt(diag[t] - e[t] ** 2)
        z[t] = (rhs[t] - e[t] * z[t - 1]) / d[t]
    z = z + noise
    out[-1] = z[-1] / d[-1]
    for t in range(n - 2, -1, -1):
        out[t] = (z[t] - e[t + 1] * out[t + 1]) / d[t]
    return out


def points(left: list[np.ndarray], w: np.ndarray, r: np.ndarray, last: np.ndarray, h0: np.ndarray, q: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last rows of stretches (s, m), from what eliminating the rows inside has left (see :func:`eliminated`), their own
    weights and values, and whether a stretch is the ``last`` (its point has one step only)."""
    own, own_value, next_, next_value, link = left
    n = len(w)
    # a point has a step back and, but for the last, one ahead; steps to rows inside are in the elimination
    diag, rhs = w + 2 * q, r.copy()
    diag[-1] -= q
    diag += next_
    rhs += next_value
    diag[:-1] += own[1:]
    rhs[:-1] += own_value[1:]
    rhs[0] += -link[0] * h0
    assert last[-1] and not last[:-1].any()
    return draw_points(diag, link[1:], rhs, rng.standard_normal((n, w.shape[1])))


def draw_walk(w: np.ndarray, r: np.ndarray, h0: np.ndarray, var: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """h (n x m) in memory: stretches of about sqrt(n) rows, and a shorter one at the end."""
    n, m = w.shape
    q, size = 1 / var, max(1, int(np.sqrt(n)))
    whole = n // size
    groups = [(slice(0, whole * size), whole, size)] + ([(slice(whole * size, n), 1, n - whole * size)] if n % size else [])
    parts = []
    for rows, s, l in groups:
        cut = lambda x: x[rows].reshape(s, l, m)  # noqa: B023, E731
        ww, rr = cut(w), cut(r)
        parts.append((ww, rr, *eliminated(ww[:, :-1], rr[:, :-1], q)))
    left = [np.concatenate([p[i] for p in parts]) for i in range(3, 8)]
    ends_w, ends_r = (np.concatenate([p[i][:, -1] for p in parts]) for i in (0, 1))
    last = np.arange(len(ends_w)) == len(ends_w) - 1
    ends = points(left, ends_w, ends_r, last, h0, q, rng)
    before, out, at = np.vstack([h0, ends[:-1]]), [], 0
    for ww, _, inside, *_ in parts:
        s, l, _ = ww.shape
        rows = filled(inside, before[at : at + s], ends[at : at + s], q, rng.standard_normal((s, l - 1, m)))
        out.append(np.concatenate([rows, ends[at : at + s, None]], axis=1).reshape(s * l, m))
        at += s
    return np.concatenate(out)


#: Design rows of a stretch of :func:`fit_long`.
STRETCH = 50_000
_STATE = "stretch long, first long, z array<double>, h array<double>, total array<double>, sums array<double>, squares array<double>"
_LEFT = "stretch long, left array<double>"


@dataclass(frozen=True)
class LongFit:
    """``draws``: chain, iteration, param, idx, value of all but the log variances; ``levels``: chain, t, series, log_var (mean
    over kept draws)."""

    draws: DataFrame
    levels: DataFrame


def fit_long(sf: SeriesFrame, lags: Lags, spec: BayesSpec, stretch: int = STRETCH) -> LongFit:
    """A stochastic volatility model of a series of any length. Each stretch of design rows is a row of a table with its values
    and its log variances. A sweep draws coefficients on the driver from weighted sums over all stretches, eliminates the rows
    inside each stretch in a task, draws the points between stretches on the driver (some numbers for each stretch), and fills
    the stretches in tasks; the new table is written to the shared folder and the old one deleted. Random numbers depend on
    (seed, chain, sweep, stretch) only, so a task that runs again draws the same."""
    from vectide.operators.gibbs import Chain, Walk, mixture
    from vectide.operators.mcmc import series_moments
    from vectide.operators.niw import DRAWS, draws_frame

    if not isinstance(spec.cov, StochasticVolatility):
        raise ValueError("constant variances are sampled from moments: use mcmc.fit_bayes")
    g, spark, m = series_moments(sf, lags), sf.df.sparkSession, sf.dim
    p = len(g.mean)
    k, const = p - m, lags.include_mean
    cols = [*[c for c in lags.terms(sf.names) if c != CONST], *sf.names]
    row = F.struct("t", F.array(*cols).alias("z"))
    design = with_design(sf.doubles(), lags).select(F.floor((F.col("t") - lags.order - 1) / stretch).alias("stretch"), row.alias("r"))
    cut = design.groupBy("stretch").agg(F.array_sort(F.collect_list("r")).alias("r"))  # ``stretch`` rows at most
    packed, _ = kept_table(cut.select("stretch", F.col("r")[0]["t"].alias("first"), F.flatten(F.col("r")["z"]).alias("z")), "volatility-rows")

    def sums_of(z: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = Weighted.of_rows(z, g.mean, np.exp(-h), k, const)
        return np.concatenate([w.n, w.s.ravel(), w.ss.ravel()])

    def arrays(pdf: pd.DataFrame):
        for item in pdf.to_dict("records"):
            yield item, np.reshape(item["z"], (-1, p)), None if item.get("h") is None else np.reshape(item["h"], (-1, m))

    def values(z: np.ndarray, h: np.ndarray, coef: np.ndarray, low: np.ndarray, seed: list[int]):
        x = np.hstack([z[:, :k], np.ones((len(z), int(const)))])
        return mixture((z[:, k:] - x @ coef) @ low.T, h, np.random.default_rng(seed))

    def summed(state: DataFrame) -> Weighted:
        total = state.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        return Weighted(g.mean, total[:m], total[m : m + m * p].reshape(m, p), total[m + m * p :].reshape(m, p, p), k, const)

    all_draws, all_levels = [], []
    for number in range(1, spec.chains + 1):
        rng = np.random.default_rng([spec.seed, 2, number])
        chain = Chain(g, lags, spec, rng)
        walk, start = Walk(chain), np.log(chain.d)

        def begun(batches, start=start):
            for pdf in batches:
                rows = []
                for item, z, _ in arrays(pdf):
                    h = np.tile(start, (len(z), 1))
                    rows.append((item["stretch"], item["first"], item["z"], h.ravel(), np.zeros(h.size), sums_of(z, h), np.zeros(m)))
                yield pd.DataFrame(rows, columns=["stretch", "first", "z", "h", "total", "sums", "squares"])

        (state, path), recorded = kept_table(packed.mapInPandas(begun, _STATE), "volatility-state"), []
        for sweep in range(spec.n_iter):
            chain.coefficients(summed(state))
            coef, low, q, keep = chain.coef.copy(), chain.low.copy(), 1 / walk.var, sweep >= spec.burn and (sweep - spec.burn) % spec.thin == 0
            seed = [spec.seed, 3, number, sweep]

            def ends(batches, coef=coef, low=low, q=q, seed=seed):
                for pdf in batches:
                    rows = []
                    for item, z, h in arrays(pdf):
                        w, r = values(z, h, coef, low, [*seed, item["stretch"]])
                        _, *left = eliminated(w[None, :-1], r[None, :-1], q)
                        rows.append((item["stretch"], np.concatenate([*[x[0] for x in left], w[-1], r[-1]])))
                    yield pd.DataFrame(rows, columns=["stretch", "left"])

            found = state.select("stretch", "z", "h").mapInPandas(ends, _LEFT).orderBy("stretch").toPandas()  # 7 m numbers for each stretch
            left = np.stack(found["left"].to_numpy()).reshape(len(found), 7, m)
            last = np.arange(len(found)) == len(found) - 1
            at = points([left[:, i] for i in range(5)], left[:, 5], left[:, 6], last, walk.h0, q, rng)
            around = pd.DataFrame({"stretch": found["stretch"], "before": np.vstack([walk.h0, at[:-1]]).tolist(), "after": at.tolist()})

            def fill(batches, coef=coef, low=low, q=q, seed=seed, keep=keep):
                for pdf in batches:
                    rows = []
                    for item, z, h in arrays(pdf):
                        w, r = values(z, h, coef, low, [*seed, item["stretch"]])
                        inside, *_ = eliminated(w[None, :-1], r[None, :-1], q)
                        before, after = np.asarray(item["before"]), np.asarray(item["after"])
                        noise = np.random.default_rng([*seed, item["stretch"], 1]).standard_normal((1, len(z) - 1, m))
                        new = np.concatenate([filled(inside, before[None], after[None], q, noise)[0], after[None]])
                        squares = (np.diff(np.vstack([before, new]), axis=0) ** 2).sum(axis=0)
                        rows.append((item["stretch"], item["first"], item["z"], new.ravel(), np.asarray(item["total"]) + (new.ravel() if keep else 0.0), sums_of(z, new), squares))
                    yield pd.DataFrame(rows, columns=["stretch", "first", "z", "h", "total", "sums", "squares"])

            old = path
            state, path = kept_table(state.join(spark.createDataFrame(around, "stretch long, before array<double>, after array<double>"), "stretch").mapInPandas(fill, _STATE), "volatility-state")
            dropped(old)
            got = state.agg(*[F.sum(F.col("squares")[i]).alias(f"q{i}") for i in range(m)], *[F.max(F.when(F.col("stretch") == 0, F.col("h")[i])).alias(f"f{i}") for i in range(m)]).first()
            walk.hyper(np.array([got[f"f{i}"] for i in range(m)]), np.array([got[f"q{i}"] for i in range(m)]), chain.n, rng)
            if keep:
                recorded.append(chain.record({"h0": walk.h0.copy(), "sigh": walk.var.copy()}))
        frame = draws_frame(number, 1, {name: np.array([r[name] for r in recorded]) for name in recorded[0]})
        all_draws.append(spark.createDataFrame(frame, DRAWS))
        at, j = F.floor(F.col("i") / m), F.col("i") % m
        levels = state.select("first", F.posexplode("total").alias("i", "v"))
        all_levels.append(levels.select(F.lit(number).alias("chain"), (F.col("first") + at).cast("long").alias("t"), F.element_at(F.array(*map(F.lit, sf.names)), (j + 1).cast("int")).alias("series"), (F.col("v") / len(recorded)).alias("log_var")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return LongFit(union(all_draws), union(all_levels))
