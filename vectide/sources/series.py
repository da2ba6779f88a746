"""Ordered series tables: ``t BIGINT`` (1, 2, ... without gaps) and one DOUBLE column for each variable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block; each block of a long series is one task's window.
BLOCK_ROWS = 100_000


@dataclass(frozen=True)
class SeriesFrame:
    """A multivariate series, or a panel of them.

    ``df`` has ``t``, the columns ``names`` and, for panels, the key columns ``panel``; other columns are kept.
    """

    df: DataFrame
    names: tuple[str, ...]
    panel: tuple[str, ...] = field(default=())

    def __post_init__(self):
        kinds = dict(self.df.dtypes)
        for c in self.names:
            if c not in kinds:
                raise ValueError(f"no column {c}")
            if not isinstance(self.df.schema[c].dataType, T.NumericType):
                raise ValueError(f"column {c} is not numeric")
        if "t" not in kinds:
            raise ValueError("a series needs a column t")

    @property
    def dim(self) -> int:
        return len(self.names)

    def doubles(self) -> SeriesFrame:
        return SeriesFrame(self.df.withColumns({c: F.col(c).cast("double") for c in self.names}), self.names, self.panel)

    def with_df(self, df: DataFrame) -> SeriesFrame:
        return SeriesFrame(df, self.names, self.panel)

    def persist(self) -> SeriesFrame:
        """Keep the rows with the executors: for series that several jobs read. A lost block is computed again."""
        return self.with_df(self.df.persist())

    def count(self) -> int:
        return self.df.count()

    def check(self) -> SeriesFrame:
        """Raise unless every cell has a value and t runs from 1 without gaps or repeats in each panel."""
        bad = F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in self.names], F.lit(0)))
        rows = self.df.groupBy(*self.panel).agg(bad.alias("bad"), F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("lo"), F.max("t").alias("hi"))
        worst = rows.filter("bad > 0 OR d <> n OR lo <> 1 OR hi <> n").first()
        if worst is not None:
            raise ValueError("null cells: interpolate first" if worst["bad"] else "t has gaps or repeats")
        return self

    def single(self) -> SeriesFrame:
        """Raise for a panel: one model of several series of rows would mix them."""
        if self.panel:
            raise ValueError(f"a panel by {', '.join(self.panel)}: use the functions for panels, or one member of it")
        return self

    @property
    def panel_schema(self) -> str:
        """Of the panel keys, with a comma after each."""
        return "".join(f"`{c}` {self.df.schema[c].dataType.simpleString()}, " for c in self.panel)

    def long(self) -> DataFrame:
        return self.df.unpivot([*self.panel, "t"], list(self.names), "series", "value")

    def last_rows(self, n: int) -> list[list[float]]:
        """The last ``n`` rows of a single series, oldest first."""
        rows = self.single().df.select("t", *self.names).orderBy(F.desc("t")).limit(n).collect()
        return [[float(r[c]) for c in self.names] for r in reversed(rows)]


#: Neighbouring blocks that one task scans.
FAN = 1_024


def scan(parts: DataFrame, keys: list[str], block: str, of: dict[str, tuple[Callable[[Column | str], Column], bool]], levels: int = 2, fan: int = FAN) -> DataFrame:
    """``keys``, ``block`` and, for each column of ``of``, its aggregate (F.sum, F.max or F.min) over the blocks before it, or over
    those after it. ``parts`` has one row for each block. Blocks are scanned ``fan`` at a time; the sums of these are scanned
    in the same way, ``levels`` deep, so that with enough levels no task sees more than ``fan`` rows of a key."""

    def over(back: bool, *by: str):
        w = Window.partitionBy(*keys, *by).orderBy(block)
        return w.rowsBetween(1, Window.unboundedFollowing) if back else w.rowsBetween(Window.unboundedPreceding, -1)

    if levels <= 1:
        return parts.select(*keys, block, *[f(c).over(over(back)).alias(c) for c, (f, back) in of.items()])
    rows = parts.withColumn("__up", F.floor(F.col(block) / fan))
    above = rows.groupBy(*keys, "__up").agg(*[f(c).alias(c) for c, (f, _) in of.items()]).withColumnRenamed("__up", block)
    above = scan(above, keys, block, of, levels - 1, fan).withColumnsRenamed({block: "__up", **{c: f"__above_{c}" for c in of}})
    near = rows.select(*keys, block, "__up", *[f(c).over(over(back, "__up")).alias(c) for c, (f, back) in of.items()])

    def both(c: str, f) -> Column:
        far = F.col(f"__above_{c}")
        if f is F.sum:
            return F.coalesce(F.col(c) + far, c, far)
        return (F.greatest if f is F.max else F.least)(F.col(c), far)

    return near.join(above, [*keys, "__up"]).select(*keys, block, *[both(c, f).alias(c) for c, (f, _) in of.items()])


def time_index(df: DataFrame, ts: str, block: Column | None = None, keys: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """Adds ``t``: the row's number by ``ts``, from 1, within ``keys``. Blocks of the time axis (by default years, which one scan
    joins; finer ones by ``levels``, 2 by default) are numbered apart and shifted by the rows before them, so no task sorts the
    whole series."""
    keys = list(keys or [])
    rows = df.withColumn("__b", (block if block is not None else F.year(ts)).cast("long"))
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    starts = scan(counts, keys, "__b", {"__n": (F.sum, False)}, levels or (1 if block is None else 2))
    out = rows.withColumn("t", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(ts)))
    return out.join(starts, [*keys, "__b"]).withColumn("t", (F.col("t") + F.coalesce("__n", F.lit(0))).cast("long")).drop("__b", "__n")


def from_long(df: DataFrame, ts: str, series: str, value: str, labels: list[str], prefix: str = "y_") -> SeriesFrame:
    """Mean of ``value`` by ``ts`` and ``series`` as one column for each of ``labels``, in order of ``ts``."""
    wide = df.groupBy(ts).pivot(series, labels).agg(F.avg(value))
    wide = wide.select(ts, *[F.col(f"`{x}`").cast("double").alias(f"{prefix}{x}") for x in labels])
    return SeriesFrame(time_index(wide, ts), tuple(f"{prefix}{x}" for x in labels))


def blocked(sf: SeriesFrame, halo: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[str], Column]:
    """The rows with a block number, each block preceded by the last ``halo`` rows of the one before it; the keys of a
    window inside a block; and whether a row is the block's own."""
    own = F.floor((F.col("t") - 1) / block_rows)
    last = (F.col("t") - 1) % block_rows >= block_rows - halo
    both = F.when(last, F.array(own, own + 1)).otherwise(F.array(own)) if halo else F.array(own)
    rows = sf.df.withColumn("__own", own).withColumn("__block", F.explode(both))
    return rows, [*sf.panel, "__block"], F.col("__own") == F.col("__block")


def interpolate(sf: SeriesFrame, block_rows: int = BLOCK_ROWS, levels: int = 2) -> SeriesFrame:
    """Fill null cells on the straight line between the nearest values before and after; ends carry the nearest value.
    Blocks are filled apart: each gets the last value before it and the first one after it, from one row for each block."""
    keys = [*sf.panel, "__block"]
    at = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("t").alias("t"), F.col(c).cast("double").alias("v"))) for c in sf.names}
    rows = sf.df.withColumn("__block", F.floor((F.col("t") - 1) / block_rows))
    known = rows.groupBy(*keys).agg(*[f(at[c]).alias(f"__{n}{i}") for i, c in enumerate(sf.names) for n, f in (("last", F.max), ("first", F.min))])
    # structs order by t: the last one before a block is the largest, the first one after it the least
    ends = scan(known, list(sf.panel), "__block", {f"__{n}{i}": (f, back) for i in range(sf.dim) for n, f, back in (("last", F.max, False), ("first", F.min, True))}, levels)
    rows = rows.join(ends.withColumnsRenamed({f"__{a}{i}": f"__{b}{i}" for i in range(sf.dim) for a, b in (("last", "before"), ("first", "after"))}), keys)
    inside = Window.partitionBy(*keys).orderBy("t")
    past, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for i, c in enumerate(sf.names):
        a = F.coalesce(F.last(at[c], ignorenulls=True).over(past), f"__before{i}")
        b = F.coalesce(F.first(at[c], ignorenulls=True).over(ahead), f"__after{i}")
        on_line = a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
        out[c] = F.coalesce(F.col(c).cast("double"), F.when(a.isNotNull() & b.isNotNull(), on_line), a["v"], b["v"])
    return sf.with_df(rows.withColumns(out).select(*sf.df.columns))


def split_tail(sf: SeriesFrame, n_ahead: int) -> tuple[SeriesFrame, SeriesFrame]:
    """Training rows, and the last ``n_ahead`` rows of each panel."""
    if sf.panel:
        last = sf.df.groupBy(*sf.panel).agg(F.max("t").alias("__last"))
        rows = sf.df.join(last, list(sf.panel))
    else:
        rows = sf.df.crossJoin(F.broadcast(sf.df.agg(F.max("t").alias("__last"))))  # one row
    cut = F.col("t") > F.col("__last") - n_ahead
    return sf.with_df(rows.filter(~cut).drop("__last")), sf.with_df(rows.filter(cut).drop("__last"))


def read_series(spark: SparkSession, path: str, names: list[str], fmt: str = "parquet", ts: str | None = None, **options) -> SeriesFrame:
    """A series from any Spark source. Rows are numbered by ``ts`` unless the source has t."""
    df = spark.read.format(fmt).options(**options).load(path)
    df = df.withColumns({c: F.col(c).cast("double") for c in names})
    return SeriesFrame(df if ts is None else time_index(df, ts), tuple(names))


def weekly_prices(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """Mean extended price by week and return flag."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.trunc(F.to_date("l_shipdate"), "week").alias("w"), "l_returnflag", "l_extendedprice")
    return from_long(rows, "w", "l_returnflag", "l_extendedprice", ["A", "N", "R"])


def panel_prices(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """Mean extended price by week, a series for each return flag and line status; weeks without a row are left out of a series."""
    keys = ["l_returnflag", "l_linestatus"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys, F.trunc(F.to_date("l_shipdate"), "week").alias("w"), "l_extendedprice")
    means = rows.groupBy(*keys, "w").agg(F.avg("l_extendedprice").alias("price"))
    return SeriesFrame(time_index(means, "w", keys=keys), ("price",), tuple(keys))


def daily_prices(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("d"), "l_returnflag", "l_extendedprice")
    return from_long(rows, "d", "l_returnflag", "l_extendedprice", ["A", "N", "R"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def hourly_events(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """Mean event value by hour and type; hours without an event of a type are null cells."""
    ts = F.col("ts")
    hour = (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(hour.alias("h"), "event_type", "value")
    wide = rows.groupBy("h").pivot("event_type", EVENT_TYPES).agg(F.avg("value"))
    wide = wide.select("h", *[F.col(x).cast("double").alias(f"y_{x}") for x in EVENT_TYPES])
    return SeriesFrame(time_index(wide, "h", F.floor(F.col("h") / 1000)), tuple(f"y_{x}" for x in EVENT_TYPES))
