"""SQL of panels, of conjugate models at their posterior means, and of rank-normalised convergence."""

from __future__ import annotations

from vectide.operators.posterior import CENTRE, FAR, TAIL
from vectide.plans import sql, sweeps
from vectide.plans.sql import DRAWS, FEVD, HALVES, LONG, TWO, WEEKS, _q

PANEL = """
pr AS (SELECT l_returnflag, l_linestatus, CAST(date_trunc('week', l_shipdate) AS DATE) AS w, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2, 3),
ps AS (SELECT l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY w) AS t, price FROM pr),
pd AS (SELECT * FROM (SELECT l_returnflag, l_linestatus, t, price AS y, lag(price) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY t) AS x FROM ps) q WHERE x IS NOT NULL),
pg AS (SELECT l_returnflag, l_linestatus, regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM pd GROUP BY 1, 2)"""

# Dummy rows of two series with scales 4,000 and 5,000, tightness 0.1 and own means of 1: sigma / lambda squared on the diagonals
# of X'X and X'Y, and it and sigma squared on that of Y'Y.
CONJUGATE = TWO[: TWO.index(",\ng AS")] + """,
o AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(a1 * a1) AS s11, sum(a1 * n1) AS s12, sum(n1 * n1) AS s22, sum(a1 * a) AS c11, sum(n1 * a) AS c21, sum(a1 * n) AS c12, sum(n1 * n) AS c22, sum(a * a) AS yaa, sum(a * n) AS yan, sum(n * n) AS ynn FROM d),
g AS (SELECT k, s11 + CAST(1600000000 AS DOUBLE) AS s11, s12, s22 + CAST(2500000000 AS DOUBLE) AS s22, c11 + CAST(1600000000 AS DOUBLE) AS c11, c21, c12, c22 + CAST(2500000000 AS DOUBLE) AS c22,
  yaa + CAST(1616000000 AS DOUBLE) AS yaa, yan, ynn + CAST(2525000000 AS DOUBLE) AS ynn FROM o),
b AS (SELECT *, (s22 * c11 - s12 * c21) / (s11 * s22 - s12 * s12) AS b11, (s11 * c21 - s12 * c11) / (s11 * s22 - s12 * s12) AS b21, (s22 * c12 - s12 * c22) / (s11 * s22 - s12 * s12) AS b12, (s11 * c22 - s12 * c12) / (s11 * s22 - s12 * s12) AS b22 FROM g),
sg AS (SELECT (yaa - b11 * c11 - b21 * c21) / (k + 1) AS s11, (yan - b11 * c12 - b21 * c22) / (k + 1) AS s12, (ynn - b12 * c12 - b22 * c22) / (k + 1) AS s22 FROM b)"""
# what follows the model in the decomposition's chain of tables; b keeps the columns that it reads
_AFTER = FEVD[FEVD.index(",\nw(h, w11") :]
DECOMPOSED = "WITH RECURSIVE " + CONJUGATE.replace("b AS (SELECT *,", "bb AS (SELECT *,").replace("FROM b)", "FROM bb)").lstrip() + ",\nb AS (SELECT b11, b12, b21, b22, k FROM bb)" + _AFTER


def _score(p: str) -> str:
    def ratio(parts, x):
        return " / ".join("(" + "".join(f"({c!r} + ({x}) * " for c in side[:-1]) + f"{side[-1]!r}" + ")" * (len(side) - 1) + ")" for side in parts)

    # p, q and r are columns of an inner table; numbers are doubles by their exponents
    number = lambda s: s
    return number(f"CASE WHEN abs({p}q) <= 0.425 THEN {p}q * {ratio(CENTRE, f'0.180625 - {p}q * {p}q')} ELSE sign({p}q) * CASE WHEN {p}r <= 5 THEN {ratio(TAIL, f'{p}r - 1.6')} ELSE {ratio(FAR, f'{p}r - 5')} END END")


def _ranked(source: str, name: str) -> str:
    """Tables that end in ``name``: rhat of the normal scores of ``source`` (param, idx, chain, iteration, value)."""
    return f"""
{name}1 AS (SELECT *, rank() OVER (PARTITION BY param, idx ORDER BY value) + (count(*) OVER (PARTITION BY param, idx, value) - 1) / CAST(2 AS DOUBLE) AS rk, count(*) OVER (PARTITION BY param, idx) AS total FROM {source}),
{name}2 AS (SELECT *, CAST((rk - 0.375) / (total + 0.25) AS DOUBLE) AS p FROM {name}1),
{name}3 AS (SELECT *, p - CAST(0.5 AS DOUBLE) AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM {name}2),
{name}4 AS (SELECT param, idx, chain, iteration, {_score('')} AS z FROM {name}3),
{name} AS (SELECT param, idx, sqrt(((n - 1) / n * w + b) / w) AS rhat FROM (SELECT param, idx, avg(v) AS w, var_samp(m) AS b, avg(n) AS n FROM (
  SELECT param, idx, chain, iteration * 2 > last AS half, avg(z) AS m, var_samp(z) AS v, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, max(iteration) OVER (PARTITION BY chain) AS last FROM {name}4) x GROUP BY param, idx, chain, iteration * 2 > last) y GROUP BY param, idx) x)"""


RANKED = DRAWS + ",\nme AS (SELECT param, idx, median(value) AS m FROM dr GROUP BY 1, 2),\nfo AS (SELECT param, idx, chain, iteration, abs(value - m) AS value FROM dr JOIN me USING (param, idx))," + _ranked("dr", "bu") + "," + _ranked("fo", "ta")



# Draws of two series and one lag, as the catalog reads them off the embeddings.
PSEUDO = """
e AS (SELECT CAST(vec_id % 2 AS INTEGER) AS chain, CAST(vec_id // 2 + 1 AS INTEGER) AS iteration, 2 * CAST(embedding[1] AS DOUBLE) AS b11, 2 * CAST(embedding[2] AS DOUBLE) AS b21, 2 * CAST(embedding[3] AS DOUBLE) AS b12, 2 * CAST(embedding[4] AS DOUBLE) AS b22,
  CAST(embedding[5] AS DOUBLE) AS a, exp(CAST(embedding[6] AS DOUBLE)) AS d1, exp(CAST(embedding[7] AS DOUBLE)) AS d2, embedding FROM embeddings)"""


def _shares(source: str) -> str:
    """Tables that end in sh: t12 and t21, what x gets from y and y from x, in two steps, of ``source`` (b, a, d1, d2, t)."""
    return f""",
co AS (SELECT *, d1 AS s11, -a * d1 AS s12, a * a * d1 + d2 AS s22 FROM {source}),
pp AS (SELECT *, s11 * s11 / s11 + (b11 * s11 + b21 * s12) * (b11 * s11 + b21 * s12) / s11 AS p11, s12 * s12 / s22 + (b11 * s12 + b21 * s22) * (b11 * s12 + b21 * s22) / s22 AS p12,
  s12 * s12 / s11 + (b12 * s11 + b22 * s12) * (b12 * s11 + b22 * s12) / s11 AS p21, s22 * s22 / s22 + (b12 * s12 + b22 * s22) * (b12 * s12 + b22 * s22) / s22 AS p22 FROM co),
sh AS (SELECT t, 100 * p12 / (p11 + p12) AS t12, 100 * p21 / (p21 + p22) AS t21 FROM pp)"""


_STATS = "round(avg(v), 4) AS {}, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.025), 4) AS lower, round(quantile_cont(v, 0.975), 4) AS upper"
_ONCE = PSEUDO + ",\nec AS (SELECT *, CAST(-1 AS BIGINT) AS t FROM e)" + _shares("ec")
_DATED = PSEUDO + ",\ned AS (SELECT chain, iteration, b11, b21, b12, b22, a, exp(4 * CAST(embedding[8 + 2 * t] AS DOUBLE)) AS d1, exp(4 * CAST(embedding[9 + 2 * t] AS DOUBLE)) AS d2, CAST(t AS BIGINT) AS t FROM e, range(0, 3) r(t))" + _shares("ed")


def _group_means(kind: str) -> str:
    own = "left(term, 3) = response"
    lag = "CAST(right(term, 1) AS INTEGER)"
    grp = {"longrun": f"2 * {lag} - 1 + CASE WHEN {own} THEN 1 ELSE 0 END", "short": f"CASE WHEN {lag} = 1 THEN 1 + CASE WHEN {own} THEN 1 ELSE 0 END ELSE {lag} + 1 END", "no": "1"}[kind]
    return f"SELECT CAST({grp} AS INTEGER) AS grp, count(*) AS n, round(avg(abs(estimate)), 5) AS size FROM ({sweeps.SQL['var2_chol_3d']}) q WHERE term <> 'const' GROUP BY 1"


def _dummies() -> str:
    cells = [(i, i, f"sd{i} / CAST(0.2 AS DOUBLE)") for i in (1, 2, 3)] + [(i, i + 3, f"sd{i} / CAST(0.2 AS DOUBLE)") for i in (1, 2, 3)] + [(i + 3, i, f"sd{i}") for i in (1, 2, 3)] + [(7, 7, "CAST(0.0001 AS DOUBLE)")]
    return _q(WEEKS + ",\nsd AS (SELECT stddev_samp(a) AS sd1, stddev_samp(n) AS sd2, stddev_samp(r) AS sd3 FROM s)", " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS r, CAST({c} AS INTEGER) AS c, round({e}, 4) AS value FROM sd" for r, c, e in cells))


_CV = ",\ncv AS (" + " UNION ALL ".join(f"SELECT 'y_{x.upper()}' AS series, stddev_samp({x}) / avg({x}) AS m FROM s" for x in "anr") + "),\nhy AS (SELECT series, m, 2 + m * m / (CAST(0.4 AS DOUBLE) * CAST(0.4 AS DOUBLE)) AS r FROM cv)"

SQL: dict[str, str] = {
    **{f"group_means_{k}": _group_means(k) for k in ("longrun", "short", "no")},
    "dummies_series": _dummies(),
    "gamma_hyper_series": _q(WEEKS + _CV, "SELECT series, round(m, 5) AS mode, round((r + sqrt(r * r - 4)) / 2, 5) AS shape, round(sqrt((r + sqrt(r * r - 4)) / 2) / CAST(0.4 AS DOUBLE), 5) AS rate FROM hy"),
    "vhar_lag_coef": f"SELECT CAST(l AS INTEGER) AS lag, round(CASE WHEN l = 1 THEN day ELSE 0 END + CASE WHEN l <= 5 THEN week / 5 ELSE 0 END + month / 22, 5) AS estimate FROM range(1, 23) x(l), (SELECT max(CASE WHEN term LIKE '%day' THEN estimate END) AS day, max(CASE WHEN term LIKE '%week' THEN estimate END) AS week, max(CASE WHEN term LIKE '%month' THEN estimate END) AS month FROM ({sql.SQL['har_ols_1d'].replace(', 6) AS', ', 12) AS')}) q) z",
    "online_ar1": _q(LONG, "SELECT series, round(regr_slope(v, x), 6) AS slope, round(regr_intercept(v, x), 3) AS intercept, count(*) AS n FROM (SELECT series, v, lag(v) OVER (PARTITION BY series ORDER BY t) AS x FROM lng) q WHERE x IS NOT NULL GROUP BY series"),
    "stable_draws": _q(PSEUDO, "SELECT chain, iteration, CASE WHEN disc < 0 THEN det < 1 ELSE greatest(abs(tr + sqrt(abs(disc))), abs(tr - sqrt(abs(disc)))) / 2 < 1 END AS stable FROM (SELECT chain, iteration, b11 + b22 AS tr, b11 * b22 - b12 * b21 AS det, (b11 + b22) * (b11 + b22) - 4 * (b11 * b22 - b12 * b21) AS disc FROM e) q"),
    "spillover_draw_margins": _q(_ONCE, "SELECT t, series, measure, " + _STATS.format("value") + " FROM (SELECT t, 'x' AS series, 'to' AS measure, t21 AS v FROM sh UNION ALL SELECT t, 'x', 'from', t12 FROM sh UNION ALL SELECT t, 'x', 'net', t21 - t12 FROM sh UNION ALL SELECT t, 'y', 'to', t12 FROM sh UNION ALL SELECT t, 'y', 'from', t21 FROM sh UNION ALL SELECT t, 'y', 'net', t12 - t21 FROM sh UNION ALL SELECT t, CAST(NULL AS VARCHAR), 'total', (t12 + t21) / 2 FROM sh) q GROUP BY 1, 2, 3"),
    "spillover_draw_pairs": _q(_ONCE, "SELECT t, series, shock, " + _STATS.format("net") + " FROM (SELECT t, 'x' AS series, 'y' AS shock, (t21 - t12) / 2 AS v FROM sh UNION ALL SELECT t, 'y', 'x', (t12 - t21) / 2 FROM sh) q GROUP BY 1, 2, 3"),
    "spillover_dates": _q(_DATED, "SELECT t, series, shock, " + _STATS.format("spillover") + " FROM (SELECT t, 'x' AS series, 'x' AS shock, 100 - t12 AS v FROM sh UNION ALL SELECT t, 'x', 'y', t12 FROM sh UNION ALL SELECT t, 'y', 'x', t21 FROM sh UNION ALL SELECT t, 'y', 'y', 100 - t21 FROM sh) q GROUP BY 1, 2, 3"),
    "lpl_given": _q(WEEKS + "," + PSEUDO + """,
la AS (SELECT max(t) AS t, max_by(a, t) / 10000 AS x, max_by(n, t) / 10000 AS y FROM s),
be AS (SELECT s.a / 10000 AS px, s.n / 10000 AS py, la.x, la.y, la.t FROM s, la WHERE s.t = la.t - 1),
er AS (SELECT chain, be.t, a, d1, d2, x - px * b11 - py * b21 AS e1, y - px * b12 - py * b22 AS e2 FROM e, be)""", "SELECT CAST(0 AS BIGINT) AS \"window\", chain, t, round(avg(-ln(2 * pi()) - (ln(d1) + ln(d2)) / 2 - (e1 * e1 / d1 + (a * e1 + e2) * (a * e1 + e2) / d2) / 2), 5) AS lpl FROM er GROUP BY chain, t"),
    "savs_means": _q(DRAWS, "SELECT idx, round(m * greatest(abs(m) * q - CASE WHEN idx > 60 THEN CAST(0 AS DOUBLE) ELSE 1 / (m * m) END, CAST(0 AS DOUBLE)) / (abs(m) * q), 6) AS value FROM (SELECT idx, 100 * avg(value) AS m, sum(value * value) AS q FROM dr GROUP BY idx) z"),
    "dynamic_spillover_minnesota_2d": sql.SQL["dynamic_spillover_2d"].replace("FROM r WHERE t >= 120)", "FROM rr WHERE t >= 120)").replace(",\nq AS (", ",\nrr AS (SELECT t, x11 + CAST(1600000000 AS DOUBLE) AS x11, x12, x22 + CAST(2500000000 AS DOUBLE) AS x22, c11 + CAST(1600000000 AS DOUBLE) AS c11, c21, c12, c22 + CAST(2500000000 AS DOUBLE) AS c22, yaa + CAST(1616000000 AS DOUBLE) AS yaa, yan, ynn + CAST(2525000000 AS DOUBLE) AS ynn FROM r),\nq AS (", 1),
    "alpl_naive": _q(WEEKS, "SELECT round(avg(v), 6) AS alpl, round(median(v), 6) AS median FROM (SELECT -ln(200000000 * pi()) / 2 - (a - p) * (a - p) / 200000000 AS v FROM (SELECT a, lag(a) OVER (ORDER BY t) AS p FROM s) q WHERE p IS NOT NULL) z"),
    "coef_parts": f"SELECT right(term, 1) AS part, left(term, length(term) - 2) AS predictor, response, estimate FROM ({sweeps.SQL['var2_chol_3d']}) q WHERE term <> 'const'",
    "sink_round_trip": sql.SQL["series_wide"],
    "panel_ar1": _q(PANEL, "SELECT l_returnflag, l_linestatus, 'price_1' AS term, 'price' AS response, round(b, 6) AS estimate FROM pg UNION ALL SELECT l_returnflag, l_linestatus, 'const', 'price', round(c, 2) FROM pg"),
    "panel_forecast": _q("WITH RECURSIVE " + PANEL.lstrip() + ",\nf(l_returnflag, l_linestatus, h, v) AS (SELECT l_returnflag, l_linestatus, 0, max_by(price, t) FROM ps GROUP BY 1, 2 UNION ALL SELECT l_returnflag, l_linestatus, h + 1, c + b * v FROM f JOIN pg USING (l_returnflag, l_linestatus) WHERE h < 3)", "SELECT l_returnflag, l_linestatus, CAST(h AS INTEGER) AS h, 'price' AS series, round(v, 2) AS forecast FROM f WHERE h > 0"),
    "panel_roll": _q(PANEL, """SELECT l_returnflag, l_linestatus, t - 100 AS "window", t + 2 AS t, 'price' AS series, round(c + b * (c + b * price), 2) AS forecast FROM (
SELECT l_returnflag, l_linestatus, e.t, e.price, regr_slope(x.y, x.x) AS b, regr_intercept(x.y, x.x) AS c FROM ps e JOIN (SELECT l_returnflag, l_linestatus, max(t) AS last FROM ps GROUP BY 1, 2) m USING (l_returnflag, l_linestatus)
JOIN (SELECT l_returnflag, l_linestatus, t AS xt, y, x FROM pd) x USING (l_returnflag, l_linestatus) WHERE xt <= e.t AND xt >= e.t - 98 AND e.t >= 100 AND e.t <= m.last - 2 GROUP BY 1, 2, 3, 4) e"""),
    "forecast_minnesota_1d": _q("WITH RECURSIVE " + TWO[: TWO.index(",\nd AS")].lstrip() + """,
d AS (SELECT * FROM (SELECT t, a AS y, lag(a) OVER (ORDER BY t) AS x FROM s) q WHERE x IS NOT NULL),
o AS (SELECT sum(x * x) + CAST(1600000000 AS DOUBLE) AS pr, sum(x * y) + CAST(1600000000 AS DOUBLE) AS xy, sum(y * y) + CAST(1616000000 AS DOUBLE) AS yy, CAST(count(*) AS DOUBLE) AS k FROM d),
z AS (SELECT xy / pr AS m, (yy - xy * xy / pr) / (k + 3 - 2) AS v FROM o),
f(h, y, v) AS (SELECT 1, m * (SELECT max_by(a, t) FROM s), v FROM z UNION ALL SELECT h + 1, m * f.y, z.v + m * m * f.v FROM f, z WHERE h < 5)""", "SELECT CAST(h AS INTEGER) AS h, round(y, 2) AS forecast, round(sqrt(v), 2) AS se FROM f"),
    "forecast_minnesota_2d": _q("WITH RECURSIVE " + CONJUGATE.lstrip() + ",\nf(h, x, y) AS (SELECT 0, max_by(a, t), max_by(n, t) FROM s UNION ALL SELECT h + 1, b11 * x + b21 * y, b12 * x + b22 * y FROM f, b WHERE h < 5)", "SELECT CAST(h AS INTEGER) AS h, 'y_A' AS series, round(x, 2) AS forecast FROM f WHERE h > 0 UNION ALL SELECT CAST(h AS INTEGER), 'y_N', round(y, 2) FROM f WHERE h > 0"),
    "spillover_minnesota_2d": _q(DECOMPOSED, "SELECT 'y_A' AS series, round(p21, 4) AS \"to\", round(p12, 4) AS \"from\", round(p21 - p12, 4) AS net, round((p12 + p21) / 2, 4) AS total FROM m UNION ALL SELECT 'y_N', round(p12, 4), round(p21, 4), round(p12 - p21, 4), round((p12 + p21) / 2, 4) FROM m"),
    "dic_plug_in": _q(CONJUGATE, """SELECT round(k * 2 * ln(2 * pi()) + k * ln(v11 * v22 - v12 * v12) + (v22 * r11 - 2 * v12 * r12 + v11 * r22) / (v11 * v22 - v12 * v12), 3) AS deviance FROM (
SELECT o.k, sg.s11 AS v11, sg.s12 AS v12, sg.s22 AS v22, o.yaa - 2 * (b11 * o.c11 + b21 * o.c21) + b11 * b11 * o.s11 + 2 * b11 * b21 * o.s12 + b21 * b21 * o.s22 AS r11,
  o.yan - b11 * o.c12 - b21 * o.c22 - b12 * o.c11 - b22 * o.c21 + b11 * b12 * o.s11 + (b11 * b22 + b21 * b12) * o.s12 + b21 * b22 * o.s22 AS r12,
  o.ynn - 2 * (b12 * o.c12 + b22 * o.c22) + b12 * b12 * o.s11 + 2 * b12 * b22 * o.s12 + b22 * b22 * o.s22 AS r22 FROM o, b, sg) q"""),
    "rank_rhat": _q(RANKED, "SELECT bu.param, bu.idx, round(bu.rhat, 6) AS bulk, round(ta.rhat, 6) AS tail, round(greatest(bu.rhat, ta.rhat), 6) AS rhat FROM bu JOIN ta USING (param, idx)"),
    "pip_constants": _q(DRAWS, "SELECT param, idx, round(avg(CASE WHEN value <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pip FROM dr GROUP BY param, idx UNION ALL SELECT 'c', CAST(i AS INTEGER), CAST(1 AS DOUBLE) FROM range(1, 3) x(i)"),
    "spectral": _q(HALVES, """SELECT round(sqrt(d), 6) AS spne, round(sqrt(d / t), 6) AS relspne FROM (SELECT (d11 + d22) / 2 + sqrt((d11 - d22) * (d11 - d22) / 4 + d12 * d12) AS d, (t11 + t22) / 2 + sqrt((t11 - t22) * (t11 - t22) / 4 + t12 * t12) AS t FROM (
SELECT sum((a.y - a.x) * (a.y - a.x)) AS d11, sum((a.y - a.x) * (b.y - b.x)) AS d12, sum((b.y - b.x) * (b.y - b.x)) AS d22, sum(a.x * a.x) AS t11, sum(a.x * b.x) AS t12, sum(b.x * b.x) AS t22 FROM hv a JOIN hv b ON b.idx = a.idx + 32 WHERE a.idx <= 32) q) q"""),
}
