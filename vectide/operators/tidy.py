"""Tidy frames behind the usual plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.sources.series import SeriesFrame


def gather_predictions(forecasts: dict[str, DataFrame], history: SeriesFrame) -> DataFrame:
    """t, series, value, model: the history (model null), then each model's forecasts (h, series, forecast) after it."""
    past = history.long().select("t", "series", "value", F.lit(None).cast("string").alias("model"))
    last = F.broadcast(history.df.agg(F.max("t").alias("last")))  # one row
    parts = [df.crossJoin(last).select((F.col("last") + F.col("h")).cast("long").alias("t"), "series", F.col("forecast").alias("value"), F.lit(m).alias("model")) for m, df in forecasts.items()]
    return reduce(DataFrame.unionByName, parts, past)


def heat_map(coefficients: DataFrame) -> DataFrame:
    """part, predictor, response, estimate of coefficients that belong to a lag."""
    return coefficients.filter(F.col("part").isNotNull()).select("part", "predictor", "response", "estimate")


def by_part(coefficients: DataFrame) -> DataFrame:
    """part, and the map of (predictor, response) to estimate: the coefficient matrix of each lag."""
    pair = F.struct(F.struct("predictor", "response").alias("key"), F.col("estimate").alias("value"))
    return coefficients.filter(F.col("part").isNotNull()).groupBy("part").agg(F.map_from_entries(F.collect_list(pair)).alias("matrix"))
