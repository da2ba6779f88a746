"""SQL of the registered queries, from closed forms and independent of the Spark code."""

from __future__ import annotations

from statistics import NormalDist

WEEKS = """
raw AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS w, l_returnflag AS f, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
wide AS (SELECT w, max(CASE WHEN f = 'A' THEN v END) AS a, max(CASE WHEN f = 'N' THEN v END) AS n, max(CASE WHEN f = 'R' THEN v END) AS r FROM raw GROUP BY w),
s AS (SELECT row_number() OVER (ORDER BY w) AS t, w, a, n, r FROM wide)"""
LONG = WEEKS + """,
lng AS (SELECT t, 'y_A' AS series, a AS v FROM s UNION ALL SELECT t, 'y_N', n FROM s UNION ALL SELECT t, 'y_R', r FROM s)"""
ONE = WEEKS + """,
d AS (SELECT * FROM (SELECT t, a AS y, lag(a) OVER (ORDER BY t) AS x FROM s) q WHERE x IS NOT NULL),
g AS (SELECT CAST(count(*) AS DOUBLE) AS k, regr_slope(y, x) AS b, regr_intercept(y, x) AS c, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM d),
e AS (SELECT sum((y - c - b * x) * (y - c - b * x)) AS rss FROM d, g)"""
TWO = WEEKS + """,
d AS (SELECT * FROM (SELECT t, a, n, lag(a) OVER (ORDER BY t) AS a1, lag(n) OVER (ORDER BY t) AS n1 FROM s) q WHERE a1 IS NOT NULL),
g AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(a1 * a1) AS s11, sum(a1 * n1) AS s12, sum(n1 * n1) AS s22, sum(a1 * a) AS c11, sum(n1 * a) AS c21, sum(a1 * n) AS c12, sum(n1 * n) AS c22, sum(a * a) AS yaa, sum(a * n) AS yan, sum(n * n) AS ynn FROM d),
b AS (SELECT (s22 * c11 - s12 * c21) / (s11 * s22 - s12 * s12) AS b11, (s11 * c21 - s12 * c11) / (s11 * s22 - s12 * s12) AS b21, (s22 * c12 - s12 * c22) / (s11 * s22 - s12 * s12) AS b12, (s11 * c22 - s12 * c12) / (s11 * s22 - s12 * s12) AS b22, k FROM g),
res AS (SELECT t, b11 * a1 + b21 * n1 AS fa, b12 * a1 + b22 * n1 AS fn, a - b11 * a1 - b21 * n1 AS ea, n - b12 * a1 - b22 * n1 AS en FROM d, b),
sg AS (SELECT sum(ea * ea) / (max(k) - 2) AS s11, sum(ea * en) / (max(k) - 2) AS s12, sum(en * en) / (max(k) - 2) AS s22 FROM res, b)"""
VMA = "WITH RECURSIVE " + TWO.lstrip() + """,
w(h, w11, w12, w21, w22) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT h + 1, w11 * b11 + w12 * b21, w11 * b12 + w12 * b22, w21 * b11 + w22 * b21, w21 * b12 + w22 * b22 FROM w, b WHERE h < 5)"""
# generalised decomposition of two steps; a step's response-by-shock matrix is the transpose of w
FEVD = VMA + """,
u AS (SELECT h, w11 * s11 + w21 * s12 AS p11, w11 * s12 + w21 * s22 AS p12, w12 * s11 + w22 * s12 AS p21, w12 * s12 + w22 * s22 AS p22,
  w11 * w11 * s11 + 2 * w11 * w21 * s12 + w21 * w21 * s22 AS q1, w12 * w12 * s11 + 2 * w12 * w22 * s12 + w22 * w22 * s22 AS q2, s11, s22 FROM w, sg WHERE h < 2),
c AS (SELECT h, sum(p11 * p11 / s11) OVER o / sum(q1) OVER o AS f11, sum(p12 * p12 / s22) OVER o / sum(q1) OVER o AS f12, sum(p21 * p21 / s11) OVER o / sum(q2) OVER o AS f21, sum(p22 * p22 / s22) OVER o / sum(q2) OVER o AS f22 FROM u WINDOW o AS (ORDER BY h)),
f AS (SELECT h + 1 AS step, f11 / (f11 + f12) AS f11, f12 / (f11 + f12) AS f12, f21 / (f21 + f22) AS f21, f22 / (f21 + f22) AS f22 FROM c),
m AS (SELECT 100 * f12 AS p12, 100 * f21 AS p21 FROM f WHERE step = 2)"""
HELD = LONG + """,
cut AS (SELECT max(t) - 20 AS last FROM s),
tr AS (SELECT series, max_by(v, t) AS forecast, avg(v) AS benchmark FROM lng, cut WHERE t <= last GROUP BY series),
sc AS (SELECT series, avg(abs(v - p)) AS scale FROM (SELECT series, v, lag(v) OVER (PARTITION BY series ORDER BY t) AS p FROM lng, cut WHERE t <= last) q WHERE p IS NOT NULL GROUP BY series),
j AS (SELECT lng.series, lng.t, lng.v AS actual, forecast, benchmark, scale FROM lng JOIN tr ON lng.series = tr.series JOIN sc ON lng.series = sc.series, cut WHERE t > last)"""
DRAWS = """
ex AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings),
dr AS (SELECT CAST(vec_id % 2 AS INTEGER) AS chain, CAST(vec_id // 2 + 1 AS INTEGER) AS iteration, 'alpha' AS param, CAST(i AS INTEGER) AS idx,
  CASE WHEN abs(CAST(embedding[i] AS DOUBLE)) < CAST(0.05 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE CAST(embedding[i] AS DOUBLE) END AS value FROM ex)"""
HALVES = DRAWS + """,
hv AS (SELECT idx, avg(CASE WHEN chain = 0 THEN value END) AS x, avg(CASE WHEN chain = 1 THEN value END) AS y FROM dr GROUP BY idx),
cf AS (SELECT CAST(abs(x) > CAST(0.004 AS DOUBLE) AS INTEGER) AS truth, CAST(abs(y) > CAST(0.004 AS DOUBLE) AS INTEGER) AS estimate FROM hv)"""

Z = NormalDist().inv_cdf(0.975)
ZJ = NormalDist().inv_cdf(1 - 0.05 / 10)


def _q(ctes: str, select: str) -> str:
    return f"{ctes if ctes.startswith('WITH') else 'WITH ' + ctes.lstrip()}\n{select}"


def _cells(table: str, cells: dict[tuple, str], names: tuple[str, ...], digits: int) -> str:
    """One row for each cell: constants under ``names`` and a rounded expression over ``table``."""
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS INTEGER)"

    return " UNION ALL ".join(f"SELECT {', '.join(f'{lit(v)} AS {n}' for n, v in zip(names, key, strict=True))}, round({e}, {digits}) AS value FROM {table}" for key, e in cells.items())


def _interpolate() -> str:
    kinds = ("click", "error", "purchase", "signup", "view")
    cols = ", ".join(f"avg(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in kinds)
    parts = []
    for k in kinds:
        past, ahead = "(ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        parts.append(f"max(CASE WHEN {k} IS NOT NULL THEN t END) OVER {past} AS {k}_p, min(CASE WHEN {k} IS NOT NULL THEN t END) OVER {ahead} AS {k}_n")
    joins = " ".join(f"LEFT JOIN s {k}1 ON {k}1.t = e.{k}_p LEFT JOIN s {k}2 ON {k}2.t = e.{k}_n" for k in kinds)
    value = lambda k: f"round(CASE WHEN e.{k} IS NOT NULL THEN e.{k} WHEN e.{k}_p IS NULL THEN {k}2.{k} WHEN e.{k}_n IS NULL THEN {k}1.{k} ELSE {k}1.{k} + ({k}2.{k} - {k}1.{k}) * (e.t - e.{k}_p) / (e.{k}_n - e.{k}_p) END, 6) AS y_{k}"
    return f"""WITH raw AS (SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT) AS h, {cols} FROM events GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY h) AS t, * FROM raw),
e AS (SELECT *, {', '.join(parts)} FROM s)
SELECT e.t, e.h, {', '.join(value(k) for k in kinds)} FROM e {joins}"""


def _groups(kind: str) -> str:
    v = {"longrun": "2 * ((r - 1) // 2) + 1 + CASE WHEN (r - 1) % 2 = c - 1 THEN 1 ELSE 0 END", "short": "CASE WHEN r <= 2 THEN 1 + CASE WHEN r = c THEN 1 ELSE 0 END ELSE (r - 1) // 2 + 2 END", "no": "1"}[kind]
    return f"SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST({v} AS INTEGER) AS grp FROM range(1, 7) x(r), range(1, 3) y(c)"


def _roll(expanding: bool) -> str:
    lo = "x.t >= 2" if expanding else "x.t >= e.t - 98"
    return _q(ONE, f"""SELECT e.t - 100 AS "window", e.t + 2 AS t, round(c + b * (c + b * e.a), 2) AS forecast FROM (
SELECT e.t, e.a, regr_slope(x.y, x.x) AS b, regr_intercept(x.y, x.x) AS c FROM s e JOIN d x ON x.t <= e.t AND {lo} WHERE e.t >= 100 AND e.t <= (SELECT max(t) FROM s) - 2 GROUP BY e.t, e.a) e""")


def _loss(name: str) -> str:
    by = {
        "mse": "avg((actual - forecast) * (actual - forecast))", "mae": "avg(abs(actual - forecast))", "mape": "avg(abs(100 * (actual - forecast) / actual))", "mase": "avg(abs(100 * (actual - forecast) / scale))",
        "mrae": "avg(abs((actual - forecast) / (actual - benchmark)))", "relmae": "avg(abs(actual - forecast)) / avg(abs(actual - benchmark))",
    }
    if name in by:
        return _q(HELD, f"SELECT series, round({by[name]}, 4) AS {name} FROM j GROUP BY series")
    agg, loss = {"rmape": ("avg", "abs(100 * (actual - {}) / actual)"), "rmase": ("avg", "abs(100 * (actual - {}) / scale)"), "rmsfe": ("sum", "(actual - {}) * (actual - {})"), "rmafe": ("sum", "abs(actual - {})")}[name]
    f = lambda m: loss.replace("{}", m)
    return _q(HELD, f"SELECT round({agg}(x) / {agg}(y), 4) AS {name} FROM (SELECT series, avg({f('forecast')}) AS x, avg({f('benchmark')}) AS y FROM j GROUP BY series) q")


def _har_matrix() -> str:
    return """SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CASE
 WHEN r = 7 THEN CASE WHEN c = 45 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
 WHEN c = 45 OR (r - 1) % 2 <> (c - 1) % 2 THEN CAST(0 AS DOUBLE)
 WHEN r <= 2 THEN CASE WHEN c <= 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
 WHEN r <= 4 THEN CASE WHEN c <= 10 THEN CAST(1 AS DOUBLE) / 5 ELSE CAST(0 AS DOUBLE) END
 ELSE CAST(1 AS DOUBLE) / 22 END, 6) AS value FROM range(1, 8) x(r), range(1, 46) y(c)"""


def _dummies() -> str:
    # columns 1-2: Y; 3-8: the lags; 9: the constant. Rows 1-6: lags; 7-8: scales; 9: constant. Scales are 2 and 5.
    sd = "CASE WHEN (r - 1) % 2 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END"
    return f"""SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CASE
 WHEN c <= 2 AND r <= 2 AND r = c THEN {sd} * (CASE WHEN r = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) * 10
 WHEN c <= 2 AND r IN (7, 8) AND r - 6 = c THEN {sd}
 WHEN c BETWEEN 3 AND 8 AND r = c - 2 THEN ((r - 1) // 2 + 1) * {sd} * 10
 WHEN c = 9 AND r = 9 THEN CAST(0.0001 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS value FROM range(1, 10) x(r), range(1, 10) y(c)"""


def _har_ols() -> str:
    det = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13))"
    day = "(c1 * (s22 * s33 - s23 * s23) - s12 * (c2 * s33 - s23 * c3) + s13 * (c2 * s23 - s22 * c3))"
    week = "(s11 * (c2 * s33 - s23 * c3) - c1 * (s12 * s33 - s23 * s13) + s13 * (s12 * c3 - c2 * s13))"
    month = "(s11 * (s22 * c3 - c2 * s23) - s12 * (s12 * c3 - c2 * s13) + c1 * (s12 * s23 - s22 * s13))"
    ctes = WEEKS + """,
hd AS (SELECT t, a AS y, lag(a) OVER (ORDER BY t) AS x1, avg(a) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x2, avg(a) OVER (ORDER BY t ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS x3 FROM s),
hg AS (SELECT sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x1 * x3) AS s13, sum(x2 * x2) AS s22, sum(x2 * x3) AS s23, sum(x3 * x3) AS s33, sum(x1 * y) AS c1, sum(x2 * y) AS c2, sum(x3 * y) AS c3 FROM hd WHERE t > 22)"""
    return _q(ctes, " UNION ALL ".join(f"SELECT 'y_A_{n}' AS term, round({e} / {det}, 6) AS estimate FROM hg" for n, e in (("day", day), ("week", week), ("month", month))))


def _ic() -> str:
    ctes = WEEKS + """,
l AS (SELECT t, a AS y, lag(a, 1) OVER (ORDER BY t) AS x1, lag(a, 2) OVER (ORDER BY t) AS x2 FROM s),
o AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x1 * y) / sum(x1 * x1) AS b FROM l WHERE t > 1),
o1 AS (SELECT 1 AS lag, max(n) AS n, CAST(1 AS DOUBLE) AS k, sum((y - b * x1) * (y - b * x1)) AS rss FROM l, o WHERE t > 1),
p AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS c1, sum(x2 * y) AS c2 FROM l WHERE t > 2),
p1 AS (SELECT n, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM p),
p2 AS (SELECT 2 AS lag, max(n) AS n, CAST(2 AS DOUBLE) AS k, sum((y - b1 * x1 - b2 * x2) * (y - b1 * x1 - b2 * x2)) AS rss FROM l, p1 WHERE t > 2),
u AS (SELECT * FROM o1 UNION ALL SELECT * FROM p2)"""
    return _q(ctes, "SELECT CAST(lag AS INTEGER) AS lag, round(ln(rss / n) + 2 / n * k, 5) AS AIC, round(ln(rss / n) + ln(n) / n * k, 5) AS BIC, round(ln(rss / n) + 2 * ln(ln(n)) / n * k, 5) AS HQ, round((n + k) / n * rss / (n - k) / 1000000, 3) AS FPE FROM u")


def _dynamic() -> str:
    sums = ", ".join(f"sum({e}) OVER o AS {n}" for n, e in (("x11", "a1 * a1"), ("x12", "a1 * n1"), ("x22", "n1 * n1"), ("c11", "a1 * a"), ("c21", "n1 * a"), ("c12", "a1 * n"), ("c22", "n1 * n"), ("yaa", "a * a"), ("yan", "a * n"), ("ynn", "n * n")))
    ctes = TWO + f""",
r AS (SELECT t, {sums} FROM d WINDOW o AS (ORDER BY t ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, (x22 * c11 - x12 * c21) / (x11 * x22 - x12 * x12) AS p11, (x11 * c21 - x12 * c11) / (x11 * x22 - x12 * x12) AS p21, (x22 * c12 - x12 * c22) / (x11 * x22 - x12 * x12) AS p12, (x11 * c22 - x12 * c12) / (x11 * x22 - x12 * x12) AS p22 FROM r WHERE t >= 120),
v AS (SELECT t, yaa - p11 * c11 - p21 * c21 AS v11, yan - p11 * c12 - p21 * c22 AS v12, ynn - p12 * c12 - p22 * c22 AS v22 FROM q),
k AS (SELECT t, 100 * (v12 * v12 / (v11 * v22)) / (1 + v12 * v12 / (v11 * v22)) AS x FROM v)"""
    return _q(ctes, "SELECT t AS t_end, z.series, round(x, 3) AS \"to\", round(x, 3) AS \"from\", round(x - x, 3) AS net, round(x, 3) AS total FROM k, (SELECT 'y_A' AS series UNION ALL SELECT 'y_N') z")


SQL: dict[str, str] = {
    "series_wide": _q(WEEKS, "SELECT t, w, round(a, 4) AS y_A, round(n, 4) AS y_N, round(r, 4) AS y_R FROM s"),
    "series_long": _q(LONG, "SELECT t, series, round(v, 4) AS value FROM lng"),
    "interpolate_linear": _interpolate(),
    "split_tail": _q(WEEKS, "SELECT t, CASE WHEN t > (SELECT max(t) FROM s) - 20 THEN 'test' ELSE 'train' END AS part, round(a, 4) AS y_A FROM s"),
    "lag_design": _q(WEEKS, "SELECT * FROM (SELECT t, round(lag(a, 1) OVER o, 4) AS y_A_1, round(lag(n, 1) OVER o, 4) AS y_N_1, round(lag(a, 2) OVER o, 4) AS y_A_2, round(lag(n, 2) OVER o, 4) AS y_N_2, CAST(1 AS DOUBLE) AS const FROM s WINDOW o AS (ORDER BY t)) q WHERE t > 2"),
    "har_design": _q(WEEKS, "SELECT * FROM (SELECT t, round(lag(a, 1) OVER (ORDER BY t), 4) AS y_A_day, round(avg(a) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS y_A_week, round(avg(a) OVER (ORDER BY t ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING), 4) AS y_A_month, CAST(1 AS DOUBLE) AS const FROM s) q WHERE t > 22"),
    "har_matrix": _har_matrix(),
    "minnesota_dummies": _dummies(),
    **{f"group_matrix_{k}": _groups(k) for k in ("longrun", "short", "no")},
    "gram_lag1": _q(TWO, _cells("g", {("xx", 1, 1): "s11 / 1000000", ("xx", 1, 2): "s12 / 1000000", ("xx", 2, 1): "s12 / 1000000", ("xx", 2, 2): "s22 / 1000000", ("xy", 1, 1): "c11 / 1000000", ("xy", 1, 2): "c12 / 1000000", ("xy", 2, 1): "c21 / 1000000", ("xy", 2, 2): "c22 / 1000000", ("yy", 1, 1): "yaa / 1000000", ("yy", 1, 2): "yan / 1000000", ("yy", 2, 1): "yan / 1000000", ("yy", 2, 2): "ynn / 1000000"}, ("part", "r", "c"), 3)),
    "ar1_ols": _q(LONG, "SELECT series, round(regr_slope(v, x), 6) AS slope, round(regr_intercept(v, x), 3) AS intercept FROM (SELECT series, v, lag(v) OVER (PARTITION BY series ORDER BY t) AS x FROM lng) q WHERE x IS NOT NULL GROUP BY series"),
    "ar1_infer": _q(ONE, "SELECT 'y_A_1' AS term, 'y_A' AS response, round(b, 3) AS estimate, round(sqrt(rss / (k - 2) / sxx), 3) AS std_error, round(b / sqrt(rss / (k - 2) / sxx), 4) AS statistic FROM g, e UNION ALL SELECT 'const', 'y_A', round(c, 3), round(sqrt(rss / (k - 2) * (1 / k + mx * mx / sxx)), 3), round(c / sqrt(rss / (k - 2) * (1 / k + mx * mx / sxx)), 4) FROM g, e"),
    "var1_ols_2d": _q(TWO, "SELECT 'y_A_1' AS term, 'y_A' AS response, round(b11, 6) AS estimate FROM b UNION ALL SELECT 'y_N_1', 'y_A', round(b21, 6) FROM b UNION ALL SELECT 'y_A_1', 'y_N', round(b12, 6) FROM b UNION ALL SELECT 'y_N_1', 'y_N', round(b22, 6) FROM b"),
    "har_ols_1d": _har_ols(),
    "var1_fitted": _q(TWO, "SELECT t, round(fa, 3) AS fitted_y_A, round(ea, 3) AS residual_y_A, round(fn, 3) AS fitted_y_N, round(en, 3) AS residual_y_N FROM res"),
    "var1_resid_cov": _q(TWO, _cells("sg", {(1, 1): "s11", (1, 2): "s12", (2, 1): "s12", (2, 2): "s22"}, ("r", "c"), 1)),
    "ic_table_ar": _ic(),
    "loglik_ar1": _q(ONE, "SELECT round(ll, 4) AS log_lik, round(-2 * ll + 2 * 3, 4) AS aic, round(-2 * ll + ln(k) * 3, 4) AS bic, round(-2 * ll + 2 * ln(ln(k)) * 3, 4) AS hq FROM (SELECT k, -k / 2 * ln(2 * pi()) - k / 2 * ln(rss / k) - k / 2 AS ll FROM g, e) q"),
    "stableroot_2d": _q(TWO, "SELECT CAST(i AS INTEGER) AS i, round(CASE WHEN disc < 0 THEN sqrt(dt) ELSE CASE WHEN i = 1 THEN greatest(abs((tr + sqrt(abs(disc))) / 2), abs((tr - sqrt(abs(disc))) / 2)) ELSE least(abs((tr + sqrt(abs(disc))) / 2), abs((tr - sqrt(abs(disc))) / 2)) END END, 6) AS root FROM (SELECT b11 + b22 AS tr, b11 * b22 - b12 * b21 AS dt, (b11 + b22) * (b11 + b22) - 4 * (b11 * b22 - b12 * b21) AS disc FROM b) q, range(1, 3) z(i)"),
    "vma_2d": _q(VMA, " UNION ALL ".join(f"SELECT CAST(h AS INTEGER) AS period, CAST({i} AS INTEGER) AS shock, CAST({j} AS INTEGER) AS response, round(w{i}{j}, 6) AS value FROM w" for i in (1, 2) for j in (1, 2))),
    "irf_2d": _q(VMA, "SELECT 'y_A' AS impulse, CAST(h AS INTEGER) AS period, 'y_A' AS response, round(w11, 6) AS value FROM w UNION ALL SELECT 'y_A', CAST(h AS INTEGER), 'y_N', round(w12, 6) FROM w"),
    "irf_ortho_2d": _q(VMA, "SELECT 'y_A' AS impulse, CAST(h AS INTEGER) AS period, 'y_N' AS response, round(sqrt(s11) * w12 + s12 / sqrt(s11) * w22, 2) AS value FROM w, sg UNION ALL SELECT 'y_N', CAST(h AS INTEGER), 'y_N', round(sqrt(s22 - s12 * s12 / s11) * w22, 2) FROM w, sg"),
    "fevd_2d": _q(FEVD, " UNION ALL ".join(f"SELECT CAST(step AS INTEGER) AS step, CAST({i} AS INTEGER) AS response, CAST({j} AS INTEGER) AS shock, round(f{i}{j}, 6) AS value FROM f" for i in (1, 2) for j in (1, 2))),
    "spillover_2d": _q(FEVD, "SELECT 'y_A' AS series, round(p21, 4) AS \"to\", round(p12, 4) AS \"from\", round(p21 - p12, 4) AS net, round((p12 + p21) / 2, 4) AS total FROM m UNION ALL SELECT 'y_N', round(p12, 4), round(p21, 4), round(p12 - p21, 4), round((p12 + p21) / 2, 4) FROM m"),
    "spillover_pairs_2d": _q(FEVD, "SELECT 'y_A' AS series, 'y_N' AS shock, round((p21 - p12) / 2, 4) AS net FROM m UNION ALL SELECT 'y_N', 'y_A', round((p12 - p21) / 2, 4) FROM m UNION ALL SELECT 'y_A', 'y_A', CAST(0 AS DOUBLE) FROM m UNION ALL SELECT 'y_N', 'y_N', CAST(0 AS DOUBLE) FROM m"),
    "forecast_ar1": _q("WITH RECURSIVE " + ONE.lstrip() + ",\np(h, f, v) AS (SELECT 1, c + b * (SELECT max_by(a, t) FROM s), rss / (k - 2) FROM g, e UNION ALL SELECT h + 1, c + b * f, rss / (k - 2) + b * b * v FROM p, g, e WHERE h < 5)", "SELECT CAST(h AS INTEGER) AS h, round(f, 2) AS forecast, round(sqrt(v), 2) AS se FROM p"),
    "forecast_bands_ar1": _q("WITH RECURSIVE " + ONE.lstrip() + ",\np(h, f, v) AS (SELECT 1, c + b * (SELECT max_by(a, t) FROM s), rss / (k - 2) FROM g, e UNION ALL SELECT h + 1, c + b * f, rss / (k - 2) + b * b * v FROM p, g, e WHERE h < 5)", f"SELECT CAST(h AS INTEGER) AS h, round(f - CAST({Z!r} AS DOUBLE) * sqrt(v), 2) AS lower, round(f + CAST({Z!r} AS DOUBLE) * sqrt(v), 2) AS upper, round(f - CAST({ZJ!r} AS DOUBLE) * sqrt(v), 2) AS lower_joint, round(f + CAST({ZJ!r} AS DOUBLE) * sqrt(v), 2) AS upper_joint FROM p"),
    "roll_ar1": _roll(False),
    "expand_ar1": _roll(True),
    "dynamic_spillover_2d": _dynamic(),
    "minnesota_post_1d": _q(ONE, "SELECT round(m, 6) AS mean, round(pr / 1000000, 1) AS prec, round((yy - m * m * pr) / 1000000, 1) AS scale, 2 - 1 + 2 + k AS shape FROM (SELECT (sum(x * y) + CAST(1600000000 AS DOUBLE)) / (sum(x * x) + CAST(1600000000 AS DOUBLE)) AS m, sum(x * x) + CAST(1600000000 AS DOUBLE) AS pr, sum(y * y) + CAST(1600000000 AS DOUBLE) + CAST(16000000 AS DOUBLE) AS yy, CAST(count(*) AS DOUBLE) AS k FROM d) q"),
    "flat_post_1d": _q(ONE, "SELECT round(sxy / (sx + 1), 6) AS mean, round((sx + 1) / 1000000, 1) AS prec, round((syy - sxy * sxy / (sx + 1)) / 1000000, 1) AS scale, k - 2 AS shape FROM (SELECT sum(x * x) AS sx, sum(x * y) AS sxy, sum(y * y) AS syy, CAST(count(*) AS DOUBLE) AS k FROM d) q"),
    "gamma_hyper": "SELECT m AS mode, s AS sd, round((r + sqrt(r * r - 4)) / 2, 6) AS shape, round(sqrt((r + sqrt(r * r - 4)) / 2) / s, 6) AS rate FROM (SELECT m, s, 2 + m * m / (s * s) AS r FROM (SELECT CAST(0.2 AS DOUBLE) AS m UNION ALL SELECT CAST(1.0 AS DOUBLE)) x, (SELECT CAST(0.4 AS DOUBLE) AS s UNION ALL SELECT CAST(2.0 AS DOUBLE)) y) q",
    **{f"loss_{n}": _loss(n) for n in ("mse", "mae", "mape", "mase", "mrae", "relmae", "rmape", "rmase", "rmsfe", "rmafe")},
    "gather_loss": _q(HELD + ",\nu AS (SELECT 'naive' AS model, series, actual, forecast AS f FROM j UNION ALL SELECT 'mean', series, actual, benchmark FROM j),\nx AS (SELECT model, 'mae' AS loss, series, avg(abs(actual - f)) AS score FROM u GROUP BY model, series UNION ALL SELECT model, 'mape', series, avg(abs(100 * (actual - f) / actual)) FROM u GROUP BY model, series)", "SELECT model, loss, series, round(score, 3) AS score, round(avg(score) OVER (PARTITION BY model, loss), 3) AS mean_score FROM x"),
    "gather_predictions": _q(HELD, "SELECT t, 'y_A' AS series, round(a, 4) AS value, CAST(NULL AS VARCHAR) AS model FROM s, cut WHERE t <= last UNION ALL SELECT last + h, 'y_A', round(forecast, 4), 'naive' FROM tr, cut, range(1, 4) z(h) WHERE series = 'y_A' UNION ALL SELECT last + h, 'y_A', round(benchmark, 4), 'mean' FROM tr, cut, range(1, 4) z(h) WHERE series = 'y_A'"),
    "draw_summary": _q(DRAWS, "SELECT param, idx, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS lower, round(quantile_cont(value, 0.95), 6) AS upper FROM dr WHERE iteration > 10 AND (iteration - 11) % 2 = 0 GROUP BY param, idx"),
    "pip": _q(DRAWS, "SELECT param, idx, round(avg(CASE WHEN value <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pip FROM dr GROUP BY param, idx"),
    "ci_select": _q(DRAWS, "SELECT param, idx, round(CASE WHEN lo * hi >= 0 THEN m ELSE CAST(0 AS DOUBLE) END, 6) AS estimate, lo * hi >= 0 AS selected FROM (SELECT param, idx, avg(value) AS m, quantile_cont(value, 0.45) AS lo, quantile_cont(value, 0.55) AS hi FROM dr GROUP BY param, idx) q"),
    "pip_select": _q(DRAWS, "SELECT param, idx, round(CASE WHEN p > CAST(0.7 AS DOUBLE) THEN m ELSE CAST(0 AS DOUBLE) END, 6) AS estimate, p > CAST(0.7 AS DOUBLE) AS selected FROM (SELECT param, idx, avg(value) AS m, avg(CASE WHEN value <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p FROM dr GROUP BY param, idx) q"),
    "rhat": _q(DRAWS, "SELECT param, idx, round(sqrt(((n - 1) / n * w + b) / w), 6) AS rhat FROM (SELECT param, idx, avg(v) AS w, var_samp(m) AS b, avg(n) AS n FROM (SELECT param, idx, chain, iteration * 2 > last AS half, avg(value) AS m, var_samp(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, max(iteration) OVER (PARTITION BY chain) AS last FROM dr) z GROUP BY param, idx, chain, iteration * 2 > last) y GROUP BY param, idx) x"),
    "tail_quantile": _q(DRAWS, "SELECT param, idx, round(max(CASE WHEN r = greatest(CAST(ceil(n * CAST(0.05 AS DOUBLE)) AS BIGINT), 1) THEN value END), 6) AS lower, round(max(CASE WHEN r = CAST(ceil(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN value END), 6) AS upper FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY value) AS r, count(*) OVER (PARTITION BY idx) AS n FROM dr) q GROUP BY param, idx"),
    "confusion": _q(HALVES, "SELECT truth, estimate, count(*) AS n FROM cf GROUP BY truth, estimate"),
    "selection_scores": _q(HALVES, "SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS fscore, round(1 - tp / (tp + fp), 6) AS fdr, round(1 - tp / (tp + fn), 6) AS fnr FROM (SELECT CAST(sum(CASE WHEN truth = 0 AND estimate = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN truth = 1 AND estimate = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN truth = 0 AND estimate = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM cf) q"),
    "fromse": _q(HALVES, "SELECT round(100 * sqrt(sum((x - y) * (x - y))) / 64, 6) AS fromse FROM hv"),
}
