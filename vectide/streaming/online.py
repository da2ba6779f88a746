"""Least squares autoregressions over a stream.

Each series keeps, as the state of its key, the moments of its design rows so far, its last ``order`` rows, and rows that came
before the ones they follow. A micro-batch merges its rows' moments into the state, so that its cost does not grow with the past
and large means do no harm. A row that was delivered before is known by its number and taken once; so after a restart from the
checkpoint the model is that of a batch fit of all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vectide.functions.design import Lags
from vectide.operators.backtest import design_rows
from vectide.operators.moments import Moments, least_squares

STATE = "last long, model binary"
FITS = "t long, n long, waiting long, coef array<double>, sigma array<double>"


def advanced(model: tuple[int, np.ndarray, np.ndarray, dict[int, np.ndarray]] | None, rows: dict[int, np.ndarray], lags: Lags, dim: int) -> tuple[int, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The state (last row's number, flat moments, last rows, waiting rows) after ``rows`` by number."""
    p = (len(lags.parts) + 1) * dim
    last, flat, tail, waiting = model or (0, Moments.none(p).flat(), np.empty((0, dim)), {})
    waiting = waiting | {t: y for t, y in rows.items() if t > last}
    stop = last
    while stop + 1 in waiting:
        stop += 1
    if stop > last:
        y = np.vstack([tail, *[waiting.pop(t)[None] for t in range(last + 1, stop + 1)]])
        if len(y) > lags.order:
            flat = Moments.from_flat(flat, p).merge(Moments.of(design_rows(y, lags))).flat()
        tail = y[-lags.order :]
    return stop, flat, tail, waiting


def online_least_squares(stream: DataFrame, keys: list[str], names: list[str], lags: Lags) -> DataFrame:
    """The keys, t (rows so far), n, waiting (rows whose predecessors have not come), coef (terms by responses, row by row) and
    sigma of each series of ``stream`` (keys, t from 1 without gaps, values ``names``) that a micro-batch has advanced; coef and
    sigma are null while rows are too few. Output mode: update."""
    m, const = len(names), lags.include_mean
    k, p = lags.k(m) - const, (len(lags.parts) + 1) * m
    own = keys or ["__all"]
    rows = stream.select(*keys, *([] if keys else [F.lit(0).alias("__all")]), F.col("t").cast("long").alias("t"), *[F.col(c).cast("double").alias(c) for c in names])
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in own)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = pickle.loads(state.get[1]) if state.exists else None
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            found |= dict(zip(pdf["t"].tolist(), pdf[names].to_numpy(dtype=float), strict=True))
        model = advanced(model, found, lags, m)
        state.update((model[0], pickle.dumps(model)))
        g = Moments.from_flat(model[1], p)
        coef = sigma = None
        if g.n > k + const:
            b, s = least_squares(g, k, const)
            coef, sigma = b.ravel().tolist(), s.ravel().tolist()
        yield pd.DataFrame({**{c: [v] for c, v in zip(own, key, strict=True)}, "t": [model[0]], "n": [int(g.n)], "waiting": [len(model[3])], "coef": [coef], "sigma": [sigma]})

    out = rows.groupBy(*own).applyInPandasWithState(advance, kinds + FITS, STATE, "update", GroupStateTimeout.NoTimeout)
    return out if keys else out.drop("__all")


def latest(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The last fit of each series, of fits that were written batch by batch."""
    cols = ("t", "n", "waiting", "coef", "sigma")
    found = fits.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("t", "n")).alias("f"))
    return found.select(*keys, *[F.col(f"f.{c}").alias(c) for c in cols])
