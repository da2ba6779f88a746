"""SQL of regressions in any number of variables: Gauss-Jordan steps over matrices held as lists of lists.

After k steps on the cross products of k regressors and m responses, the upper right block is the coefficients and the
lower right one the residual cross products; the logarithms of the pivots add up to the determinants.
"""

from __future__ import annotations

from vectide.plans.sql import WEEKS

NAMES = ("y_A", "y_N", "y_R")
SHORT = ("a", "n", "r")


def _days() -> str:
    """The daily series, with empty cells on the line between their neighbours."""
    near = ", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN t END) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}0, min(CASE WHEN {c} IS NOT NULL THEN t END) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}1" for c in SHORT)
    joins = " ".join(f"LEFT JOIN raw_s p{c} ON p{c}.t = e.{c}0 LEFT JOIN raw_s q{c} ON q{c}.t = e.{c}1" for c in SHORT)
    filled = ", ".join(f"coalesce(e.{c}, p{c}.{c} + (q{c}.{c} - p{c}.{c}) * (e.t - e.{c}0) / (e.{c}1 - e.{c}0), p{c}.{c}, q{c}.{c}) AS {c}" for c in SHORT)
    daily = WEEKS.replace("date_trunc('week', l_shipdate)", "l_shipdate").replace("s AS (SELECT row_number()", "raw_s AS (SELECT row_number()")
    return daily + f",\ne AS (SELECT *, {near} FROM raw_s),\ns AS (SELECT e.t, e.w, {filled} FROM e {joins})"


def _lag(p: int, dim: int, const: bool) -> str:
    """CTE d: t and z, the regressors and responses of each row from lag p on."""
    x = [f"lag({c}, {i}) OVER (ORDER BY t)" for i in range(1, p + 1) for c in SHORT[:dim]]
    return _design(x, dim, const, p)


def _har(dim: int, const: bool, week: int = 5, month: int = 22) -> str:
    x = [f"avg({c}) OVER (ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (1, week, month) for c in SHORT[:dim]]
    return _design(x, dim, const, month)


def _design(x: list[str], dim: int, const: bool, order: int) -> str:
    cols = [*x, *(["CAST(1 AS DOUBLE)"] if const else []), *SHORT[:dim]]
    return f",\nd AS (SELECT * FROM (SELECT t, {', '.join(f'{c} AS z{i + 1}' for i, c in enumerate(cols))} FROM s) q WHERE t > {order})"


def _matrix(size: int, cell) -> str:
    return "[" + ", ".join("[" + ", ".join(cell(min(i, j), max(i, j)) for j in range(1, size + 1)) + "]" for i in range(1, size + 1)) + "]"


def _sweep(size: int, steps: int, first: str) -> str:
    """CTEs: m0 (e, n, m) out of ``first``, and sw with the matrix and the log determinant after ``steps`` pivots."""
    return f""",
m0 AS ({first}),
sw(i, e, n, m, ld) AS (SELECT 1, e, n, m, CAST(0 AS DOUBLE) FROM m0
  UNION ALL SELECT i + 1, e, n, list_transform(m, lambda u, q: CASE WHEN q = i THEN list_transform(m[i], lambda v: v / m[i][i]) ELSE list_transform(u, lambda v, c: v - u[i] * m[i][c] / m[i][i]) END), ld + ln(m[i][i]) FROM sw WHERE i <= {steps})"""


def _whole(size: int, more=lambda i, j: "") -> str:
    return f"SELECT 0 AS e, CAST(count(*) AS DOUBLE) AS n, {_matrix(size, lambda i, j: f'sum(z{i} * z{j}){more(i, j)}')} AS m FROM d"


def _terms(parts: list, dim: int, const: bool) -> list[str]:
    return [f"{c}_{p}" for p in parts for c in NAMES[:dim]] + (["const"] if const else [])


def _coefs(terms: list[str], dim: int, k: int, digits: int, const_digits: int = 2) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS term, '{NAMES[j]}' AS response, round(m[{i + 1}][{k + j + 1}], {const_digits if t == 'const' else digits}) AS estimate FROM sw WHERE i = {k + 1}" for i, t in enumerate(terms) for j in range(dim))


def _rec(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.lstrip()}\n{select}"


def ols_coefs(p: int, dim: int = 3) -> str:
    k = p * dim + 1
    return _rec(WEEKS + _lag(p, dim, True) + _sweep(k + dim, k, _whole(k + dim)), _coefs(_terms(range(1, p + 1), dim, True), dim, k, 6))


def har_coefs(dim: int = 3) -> str:
    k = 3 * dim + 1
    return _rec(WEEKS + _har(dim, True) + _sweep(k + dim, k, _whole(k + dim)), _coefs(_terms(["day", "week", "month"], dim, True), dim, k, 6))


def heat_map(p: int, dim: int = 3) -> str:
    inner = ols_coefs(p, dim)
    head, _, tail = inner.rpartition("\nSELECT 'y_A_1'")
    return f"{head}\nSELECT regexp_extract(term, '[0-9]+$') AS part, regexp_extract(term, '^y_[A-Z]') AS predictor, response, estimate FROM (SELECT 'y_A_1'{tail}) c WHERE term <> 'const'"


def resid_corr(p: int = 2, dim: int = 3) -> str:
    k = p * dim + 1
    cells = " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS r, CAST({j + 1} AS INTEGER) AS c, round(m[{k + i + 1}][{k + j + 1}] / sqrt(m[{k + i + 1}][{k + i + 1}] * m[{k + j + 1}][{k + j + 1}]), 6) AS value FROM sw WHERE i = {k + 1}" for i in range(dim) for j in range(dim))
    return _rec(WEEKS + _lag(p, dim, True) + _sweep(k + dim, k, _whole(k + dim)), cells)


def summary(p: int = 2, dim: int = 3) -> str:
    """Coefficients with standard errors and two-sided p-values; Student's density is summed by Simpson's rule."""
    k = p * dim + 1
    size = k + dim + k  # an identity beside the matrix becomes the inverse
    cell = lambda i, j: f"sum(z{i} * z{j})" if j <= k + dim else "CAST(1 AS DOUBLE)" if j - k - dim == i else "CAST(0 AS DOUBLE)"
    rows = "[" + ", ".join("[" + ", ".join(cell(*((min(i, j), max(i, j)) if j <= k + dim else (i, j))) for j in range(1, size + 1)) + "]" for i in range(1, k + dim + 1)) + "]"
    first = f"SELECT 0 AS e, CAST(count(*) AS DOUBLE) AS n, {rows} AS m FROM d"
    cells = " UNION ALL ".join(f"SELECT '{t}' AS term, '{NAMES[j]}' AS response, m[{i + 1}][{k + j + 1}] AS b, sqrt(m[{i + 1}][{k + dim + i + 1}] * m[{k + j + 1}][{k + j + 1}] / (n - {k})) AS se, n - {k} AS df FROM sw WHERE i = {k + 1}" for i, t in enumerate(_terms(range(1, p + 1), dim, True)) for j in range(dim))
    ctes = WEEKS + _lag(p, dim, True) + _sweep(size, k, first) + f""",
c AS ({cells}),
q AS (SELECT term, response, b, se, df, least(abs(b / se), 60) AS x FROM c),
pd AS (SELECT term, response, sum(CASE WHEN g = 0 OR g = 4000 THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (x * g / 4000) * (x * g / 4000) / df, -(df + 1) / 2)) * x / 4000 / 3 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS inner_half FROM q, range(0, 4001) v(g) GROUP BY term, response, x, df)"""
    return _rec(ctes, "SELECT term, response, round(b, CASE WHEN term = 'const' THEN 2 ELSE 5 END) AS estimate, round(se, CASE WHEN term = 'const' THEN 2 ELSE 5 END) AS std_error, round(b / se, 4) AS statistic, round(abs(1 - 2 * inner_half), 4) AS p_value FROM c JOIN pd USING (term, response)")


def _sds(dim: int) -> str:
    return f",\nsd AS (SELECT {', '.join(f'stddev_samp({c}) AS sd{j + 1}' for j, c in enumerate(SHORT[:dim]))} FROM s)"


def _minnesota(parts: int, dim: int, means: tuple[float, ...], lam: float = 0.1, eps: float = 1e-4):
    """What the dummy observations add to a cell of the cross products; ``means`` by part."""
    k = parts * dim + 1

    def more(i: int, j: int) -> str:
        part, own = (i - 1) // dim + 1, (i - 1) % dim + 1
        sd = f"(SELECT sd{own} FROM sd)"
        if i == j and i < k:
            return f" + pow({part} * {sd} / CAST({lam} AS DOUBLE), 2)"
        if i == j == k:
            return f" + CAST({eps * eps!r} AS DOUBLE)"
        if i < k < j and own == j - k and means[part - 1]:
            return f" + {part} * CAST({means[part - 1]} AS DOUBLE) * pow({sd} / CAST({lam} AS DOUBLE), 2)"
        if i == j > k:
            sd = f"(SELECT sd{i - k} FROM sd)"
            return f" + pow({sd}, 2) * (1 + CAST({sum(x * x for x in means)!r} AS DOUBLE) / pow(CAST({lam} AS DOUBLE), 2))"
        return ""

    return more


def _posterior(design: str, parts: list, dim: int, means: tuple[float, ...], steps: int | None = None) -> str:
    k = len(parts) * dim + 1
    return WEEKS + design + _sds(dim) + _sweep(k + dim, steps or k, _whole(k + dim, _minnesota(len(parts), dim, means)))


def minnesota_coefs(p: int, dim: int = 3) -> str:
    parts = list(range(1, p + 1))
    return _rec(_posterior(_lag(p, dim, True), parts, dim, (1.0, *[0.0] * (p - 1))), _coefs(_terms(parts, dim, True), dim, p * dim + 1, 6))


def har_minnesota_coefs(means: tuple[float, float, float], dim: int = 3) -> str:
    parts = ["day", "week", "month"]
    return _rec(_posterior(_har(dim, True), parts, dim, means), _coefs(_terms(parts, dim, True), dim, 3 * dim + 1, 6))


def har_minnesota_scale(means: tuple[float, float, float], dim: int = 3) -> str:
    k = 3 * dim + 1
    cells = " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS r, CAST({j + 1} AS INTEGER) AS c, round(m[{k + i + 1}][{k + j + 1}] / 1000000, 3) AS value FROM sw WHERE i = {k + 1}" for i in range(dim) for j in range(dim))
    return _rec(_posterior(_har(dim, True), ["day", "week", "month"], dim, means), cells)


def flat_coefs(dim: int = 3) -> str:
    k = 3 * dim + 1
    more = lambda i, j: " + 1" if i == j <= k else ""
    return _rec(WEEKS + _har(dim, True) + _sweep(k + dim, k, _whole(k + dim, more)), _coefs(_terms(["day", "week", "month"], dim, True), dim, k, 6, 4))


def log_ml(design: str, parts: list, dim: int, means: tuple[float, ...], lam: float = 0.1, eps: float = 1e-4) -> str:
    """Marginal likelihood from the determinants of prior and posterior precision and scale."""
    k = len(parts) * dim + 1
    prior_shape = f"({len(parts) * dim + dim + 1} - {k} + 2)"
    prec0 = " + ".join([f"2 * {dim} * ln({i + 1} / CAST({lam} AS DOUBLE))" for i in range(len(parts))] + [f"2 * {len(parts)} * ln(sd{j + 1})" for j in range(dim)] + [f"ln(CAST({eps * eps!r} AS DOUBLE))"])
    scale0 = " + ".join(f"2 * ln(sd{j + 1})" for j in range(dim))
    gamma = lambda a: " + ".join(f"lgamma({a} - CAST({j} AS DOUBLE) / 2)" for j in range(dim))
    ctes = _posterior(design, parts, dim, means, k + dim) + f""",
v AS (SELECT a.n, a.ld AS prec, b.ld - a.ld AS scale, {prec0} AS prec0, {scale0} AS scale0, CAST({prior_shape} AS DOUBLE) AS s0 FROM sw a, sw b, sd WHERE a.i = {k + 1} AND b.i = {k + dim + 1})"""
    return _rec(ctes, f"SELECT round(-{dim} * n / 2 * ln(pi()) + ({gamma('(s0 + n) / 2')}) - ({gamma('s0 / 2')}) + CAST({dim} AS DOUBLE) / 2 * (prec0 - prec) + s0 / 2 * scale0 - (s0 + n) / 2 * scale, 3) AS log_ml FROM v")


def _windows(size: int, rows: int, more, first: str, expanding: bool = False) -> tuple[str, str]:
    """m0 by window end: running sums over ``rows`` design rows (all rows so far, if expanding)."""
    frame = "UNBOUNDED PRECEDING" if expanding else f"{rows - 1} PRECEDING"
    sums = ", ".join(f"sum(z{i} * z{j}) OVER o AS s{i}_{j}" for i in range(1, size + 1) for j in range(i, size + 1))
    ctes = f",\nrs AS (SELECT t, CAST(count(*) OVER o AS DOUBLE) AS n, {sums} FROM d WINDOW o AS (ORDER BY t ROWS BETWEEN {frame} AND CURRENT ROW))"
    return ctes, f"SELECT t AS e, n, {_matrix(size, lambda i, j: f's{i}_{j}{more(i, j)}')} AS m FROM rs WHERE t >= {first}"


def roll_ahead(series: str, design: str, parts: list, window: int, order: int, more, sds: bool, x, dim: int = 3, digits: int = 2, expanding: bool = False) -> str:
    """One-step forecasts of every window. ``x``: the regressors of the next row, as columns of nx by the window's end."""
    k = len(parts) * dim + 1
    ctes, first = _windows(k + dim, window - order, more, str(window), expanding)
    value = lambda j: " + ".join(f"m[{i + 1}][{k + j + 1}] * x{i + 1}" for i in range(k))
    body = series + design + (_sds(dim) if sds else "") + ctes + _sweep(k + dim, k, first) + f",\nnx AS (SELECT t, {', '.join(f'{c} AS x{i + 1}' for i, c in enumerate(x))} FROM s)"
    return _rec(body, " UNION ALL ".join(f"SELECT e - {window} AS \"window\", e + 1 AS t, '{NAMES[j]}' AS series, round({value(j)}, {digits}) AS forecast FROM sw JOIN nx ON e = nx.t WHERE i = {k + 1} AND e < (SELECT max(t) FROM s)" for j in range(dim)))


def lag_next(p: int, dim: int = 3) -> list[str]:
    return [f"lag({c}, {i}) OVER (ORDER BY t)" if i else c for i in range(p) for c in SHORT[:dim]] + ["CAST(1 AS DOUBLE)"]


def har_next(dim: int = 3) -> list[str]:
    return [f"avg({c}) OVER (ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (1, 5, 22) for c in SHORT[:dim]] + ["CAST(1 AS DOUBLE)"]


def flagship(hold_out: int = 20, dim: int = 3) -> str:
    """VAR(1) on all but the last weeks, forecast step after step, and the mean squared errors."""
    k = dim + 1
    step = ", ".join(" + ".join([*(f"m[{i + 1}][{k + j + 1}] * f{i + 1}" for i in range(dim)), f"m[{k}][{k + j + 1}]"]) + f" AS g{j + 1}" for j in range(dim))
    start = ", ".join(f"max_by({c}, t) AS f{j + 1}" for j, c in enumerate(SHORT[:dim]))
    train = f"(SELECT * FROM s WHERE t <= (SELECT max(t) - {hold_out} FROM s))"
    ctes = WEEKS + _lag(1, dim, True).replace("FROM s)", f"FROM {train} s)") + _sweep(k + dim, k, _whole(k + dim)) + f""",
b AS (SELECT m FROM sw WHERE i = {k + 1}),
f(h, {', '.join(f'f{j + 1}' for j in range(dim))}) AS (SELECT 0, {start} FROM {train} s UNION ALL SELECT h + 1, {step} FROM f, b WHERE h < {hold_out}),
e AS (SELECT s.*, f.* FROM f JOIN s ON s.t = (SELECT max(t) - {hold_out} FROM s) + f.h WHERE f.h > 0)"""
    return _rec(ctes, " UNION ALL ".join(f"SELECT '{NAMES[j]}' AS series, round(avg(({c} - f{j + 1}) * ({c} - f{j + 1})) / 1000000, 6) AS mse FROM e" for j, c in enumerate(SHORT[:dim])))


def har_vma(periods: int = 5) -> tuple[str, dict]:
    """CTEs up to w: the moving average form of a two-variable VHAR without constant, one column for each entry."""
    k, dim = 6, 2
    ctes = WEEKS + _har(dim, False) + _sweep(k + dim, k, _whole(k + dim)) + f",\nb AS (SELECT n, m FROM sw WHERE i = {k + 1})"
    # the coefficient of lag l: what rows of parts give it; entry (i, j): shock i, response j
    a = lambda l, i, j: "(" + " + ".join(f"m[{2 * q + i}][{k + j}] / {w}" for q, w in enumerate((1, 5, 22)) if l <= w) + ")"  # noqa: E731, E741
    cols = {(0, i, j): f"CAST({int(i == j)} AS DOUBLE)" for i in (1, 2) for j in (1, 2)}
    parts = [f"w0 AS (SELECT n, m, {', '.join(f'{v} AS w0_{i}{j}' for (_, i, j), v in cols.items())} FROM b)"]
    for h in range(1, periods + 1):
        new = ", ".join(" + ".join(f"w{h - l}_{i}{q} * {a(l, q, j)}" for l in range(1, h + 1) for q in (1, 2)) + f" AS w{h}_{i}{j}" for i in (1, 2) for j in (1, 2))  # noqa: E741
        parts.append(f"w{h} AS (SELECT *, {new} FROM w{h - 1})")
    return ctes + ",\n" + ",\n".join(parts), k


def har_vma_rows(periods: int = 5) -> str:
    ctes, _ = har_vma(periods)
    return _rec(ctes, " UNION ALL ".join(f"SELECT CAST({h} AS INTEGER) AS period, CAST({i} AS INTEGER) AS shock, CAST({j} AS INTEGER) AS response, round(w{h}_{i}{j}, 6) AS value FROM w{periods}" for h in range(periods + 1) for i in (1, 2) for j in (1, 2)))


def har_spillover(step: int = 2) -> str:
    """Generalised decomposition of a two-variable VHAR after ``step`` steps, as percentages: response by shock."""
    ctes, k = har_vma(step - 1)
    s = lambda i, j: f"(m[{k + i}][{k + j}] / (n - {k}))"
    # the response of i to a shock in j at h: (W_h' sigma)_ij
    num = lambda i, j: " + ".join(f"pow({' + '.join(f'w{h}_{q}{i} * {s(q, j)}' for q in (1, 2))}, 2) / {s(j, j)}" for h in range(step))
    ctes += f",\nnu AS (SELECT {', '.join(f'{num(i, j)} AS n{i}{j}' for i in (1, 2) for j in (1, 2))} FROM w{step - 1})"
    return _rec(ctes, " UNION ALL ".join(f"SELECT '{NAMES[i - 1]}' AS series, '{NAMES[j - 1]}' AS shock, round(100 * n{i}{j} / (n{i}1 + n{i}2), 4) AS spillover FROM nu" for i in (1, 2) for j in (1, 2)))


def har_forecast(steps: int = 5) -> str:
    """Point forecasts of a one-variable VHAR: a list of the last values grows by a step at a time."""
    k = 4
    ctes = WEEKS + _har(1, True) + _sweep(k + 1, k, _whole(k + 1)) + f""",
b AS (SELECT m FROM sw WHERE i = {k + 1}),
p(h, y) AS (SELECT 0, (SELECT list(a ORDER BY t DESC) FROM s) UNION ALL
  SELECT h + 1, list_prepend(m[1][5] * y[1] + m[2][5] * list_avg(y[1:5]) + m[3][5] * list_avg(y[1:22]) + m[4][5], y) FROM p, b WHERE h < {steps})"""
    return _rec(ctes, "SELECT CAST(h AS INTEGER) AS h, 'y_A' AS series, round(y[1], 2) AS forecast FROM p WHERE h > 0")


def best_lag() -> str:
    from vectide.plans.sql import SQL

    return f"SELECT criterion, CAST(arg_min(lag, v) AS INTEGER) AS lag FROM (SELECT lag, unnest(['AIC', 'BIC', 'HQ', 'FPE']) AS criterion, unnest([AIC, BIC, HQ, FPE]) AS v FROM ({SQL['ic_table_ar']}) x) y GROUP BY criterion"


def sample_sd(dim: int = 3) -> str:
    return "WITH " + (WEEKS + _sds(dim)).lstrip() + " " + " UNION ALL ".join(f"SELECT '{NAMES[j]}' AS series, round(sd{j + 1}, 4) AS sd FROM sd" for j in range(dim))


S_MEANS, L_MEANS = (1.0, 0.0, 0.0), (1.0, 0.5, 0.25)
PARTS = ["day", "week", "month"]

SQL: dict[str, str] = {
    "var2_chol_3d": ols_coefs(2),
    "var2_qr_3d": ols_coefs(2),
    "vhar_ols_3d": har_coefs(),
    "heat_map_3d": heat_map(2),
    "resid_corr_3d": resid_corr(),
    "summary_pvalue": summary(),
    "sample_sd": sample_sd(),
    "best_lag_ar": best_lag(),
    "vhar_vma_2d": har_vma_rows(),
    "vhar_spillover_2d": har_spillover(),
    "forecast_vhar_1d": har_forecast(),
    "minnesota_var2_3d": minnesota_coefs(2),
    "minnesota_vhar_s_3d": har_minnesota_coefs(S_MEANS),
    "minnesota_vhar_l_3d": har_minnesota_coefs(L_MEANS),
    "minnesota_vhar_l_scale": har_minnesota_scale(L_MEANS),
    "flat_vhar_3d": flat_coefs(),
    "log_ml": log_ml(_har(3, True), PARTS, 3, S_MEANS),
    "log_ml_var2": log_ml(_lag(2, 3, True), [1, 2], 3, (1.0, 0.0)),
    "roll_minnesota": roll_ahead(WEEKS, _lag(1, 3, True), [1], 150, 1, _minnesota(1, 3, (1.0,)), True, lag_next(1)),
    "expand_minnesota": roll_ahead(WEEKS, _lag(1, 3, True), [1], 150, 1, _minnesota(1, 3, (1.0,)), True, lag_next(1), expanding=True),
    "roll_flat": roll_ahead(WEEKS, _har(3, True), PARTS, 150, 22, lambda i, j: " + 1" if i == j <= 10 else "", False, har_next()),
    "flagship": flagship(),
    "flagship_daily": roll_ahead(_days(), _lag(5, 3, True), [1, 2, 3, 4, 5], 1000, 5, lambda i, j: "", False, lag_next(5)),
}
