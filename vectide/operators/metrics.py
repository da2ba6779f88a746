"""Forecast losses. ``joined`` has series, t, actual and forecast (and benchmark, where a metric compares two models)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.sources.series import SeriesFrame


def joined(forecast: DataFrame, actual: DataFrame, benchmark: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Forecasts (t, series, forecast) with actual values (t, series, value), and with another model's forecasts."""
    on = [*keys, "t", "series"]
    out = forecast.select(*on, "forecast").join(actual.select(*on, F.col("value").alias("actual")), on)
    if benchmark is not None:
        out = out.join(benchmark.select(*on, F.col("forecast").alias("benchmark")), on)
    return out


def _e(model: str = "forecast") -> Column:
    return F.col("actual") - F.col(model)


def _by_series(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy("series").agg(value.alias(name))


def mse(rows: DataFrame) -> DataFrame:
    return _by_series(rows, F.avg(_e() * _e()), "mse")


def mae(rows: DataFrame) -> DataFrame:
    return _by_series(rows, F.avg(F.abs(_e())), "mae")


def mape(rows: DataFrame) -> DataFrame:
    return _by_series(rows, F.avg(F.abs(100 * _e() / F.col("actual"))), "mape")


def naive_scale(train: SeriesFrame) -> DataFrame:
    """series, scale: mean absolute first difference of the training rows."""
    w = Window.partitionBy("series").orderBy("t")
    diff = train.long().withColumn("d", F.abs(F.col("value") - F.lag("value").over(w)))
    return diff.groupBy("series").agg(F.avg("d").alias("scale"))


def mase(rows: DataFrame, train: SeriesFrame) -> DataFrame:
    """Each series is scaled by its own naive error."""
    scaled = rows.join(naive_scale(train), "series")
    return _by_series(scaled, F.avg(F.abs(100 * _e() / F.col("scale"))), "mase")


def mrae(rows: DataFrame) -> DataFrame:
    return _by_series(rows, F.avg(F.abs(_e() / _e("benchmark"))), "mrae")


def relmae(rows: DataFrame) -> DataFrame:
    return _by_series(rows, F.avg(F.abs(_e())) / F.avg(F.abs(_e("benchmark"))), "relmae")


def _ratio(rows: DataFrame, top: Column, bottom: Column, name: str, mean: bool) -> DataFrame:
    """One number: the mean (or sum) over series of a loss, over that of the benchmark."""
    per = rows.groupBy("series").agg(top.alias("a"), bottom.alias("b"))
    agg = F.avg if mean else F.sum
    return per.agg((agg("a") / agg("b")).alias(name))


def rmape(rows: DataFrame) -> DataFrame:
    loss = lambda m: F.avg(F.abs(100 * _e(m) / F.col("actual")))
    return _ratio(rows, loss("forecast"), loss("benchmark"), "rmape", True)


def rmase(rows: DataFrame, train: SeriesFrame) -> DataFrame:
    loss = lambda m: F.avg(F.abs(100 * _e(m) / F.col("scale")))
    return _ratio(rows.join(naive_scale(train), "series"), loss("forecast"), loss("benchmark"), "rmase", True)


def rmsfe(rows: DataFrame) -> DataFrame:
    """Sum of mean squared errors over that of the benchmark, without a root."""
    return _ratio(rows, F.avg(_e() * _e()), F.avg(_e("benchmark") * _e("benchmark")), "rmsfe", False)


def rmafe(rows: DataFrame) -> DataFrame:
    return _ratio(rows, F.avg(F.abs(_e())), F.avg(F.abs(_e("benchmark"))), "rmafe", False)


def alpl(lpl: DataFrame, median: bool = False) -> DataFrame:
    """Mean or median of log predictive likelihoods (column lpl)."""
    return lpl.agg((F.median("lpl") if median else F.avg("lpl")).alias("alpl"))


def gather_loss(losses: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """model, loss, series, score and the model's mean score, from losses by model and name."""
    parts = [df.select(F.lit(m).alias("model"), F.lit(n).alias("loss"), "series", F.col(n).alias("score")) for m, by in losses.items() for n, df in by.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("mean_score", F.avg("score").over(Window.partitionBy("model", "loss")))
