"""Summaries of draws tables (chain, iteration, param, idx, value)."""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["param", "idx"]


def keys_of(draws: DataFrame) -> list[str]:
    """What tells parameters apart: the keys of a panel, if there are any, then param and idx."""
    return [*[c for c in draws.columns if c not in (*KEY, "chain", "iteration", "value", "pip")], *KEY]


def thin(draws: DataFrame, burn: int = 0, every: int = 1) -> DataFrame:
    """Draws after the first ``burn`` iterations of each chain, each ``every``-th of them."""
    return draws.filter((F.col("iteration") > burn) & ((F.col("iteration") - burn - 1) % every == 0))


def summarise(draws: DataFrame, level: float = 0.05) -> DataFrame:
    """param, idx, mean, sd, median, lower, upper."""
    v = F.col("value")
    return draws.groupBy(*keys_of(draws)).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.percentile(v, level / 2).alias("lower"), F.percentile(v, 1 - level / 2).alias("upper"))


def inclusion(draws: DataFrame, constants: int = 0) -> DataFrame:
    """param, idx, pip: share of draws that are not zero. ``constants``: as many rows of c, which is never left out, are added."""
    if constants:
        keys = keys_of(draws)[:-2]
        one = draws.select(*keys).distinct().select(*keys, F.lit("c").alias("param"), F.explode(F.sequence(F.lit(1), F.lit(constants))).alias("idx"), F.lit(1.0).alias("pip")) if keys else draws.sparkSession.range(1, constants + 1).select(F.lit("c").alias("param"), F.col("id").cast("int").alias("idx"), F.lit(1.0).alias("pip"))
        return inclusion(draws).unionByName(one)
    return draws.groupBy(*keys_of(draws)).agg(F.avg((F.col("value") != 0).cast("double")).alias("pip"))


def select_by_interval(draws: DataFrame, level: float = 0.05) -> DataFrame:
    """param, idx, estimate: the mean where the credible interval leaves out zero, else 0. A bound at zero keeps it."""
    s = summarise(draws, level)
    keep = F.col("lower") * F.col("upper") >= 0
    return s.select(*keys_of(draws), F.when(keep, F.col("mean")).otherwise(0.0).alias("estimate"), keep.alias("selected"))


def select_by_inclusion(draws: DataFrame, pip: DataFrame, threshold: float = 0.5) -> DataFrame:
    """param, idx, estimate: the mean where the inclusion probability is over ``threshold``, else 0."""
    s = draws.groupBy(*keys_of(draws)).agg(F.avg("value").alias("mean")).join(pip, keys_of(draws))
    keep = F.col("pip") > threshold
    return s.select(*keys_of(draws), F.when(keep, F.col("mean")).otherwise(0.0).alias("estimate"), keep.alias("selected"))


def tail_quantile(draws: DataFrame, level: float) -> DataFrame:
    """param, idx, lower, upper: order statistics at the tails, without interpolation."""
    w = Window.partitionBy(*keys_of(draws)).orderBy("value")
    n = F.count("*").over(Window.partitionBy(*keys_of(draws)))
    rows = draws.withColumn("r", F.row_number().over(w)).withColumn("n", n)
    low, high = F.greatest(F.ceil(F.col("n") * (level / 2)), F.lit(1)), F.greatest(F.ceil(F.col("n") * (1 - level / 2)), F.lit(1))
    return rows.groupBy(*keys_of(draws)).agg(F.max(F.when(F.col("r") == low, F.col("value"))).alias("lower"), F.max(F.when(F.col("r") == high, F.col("value"))).alias("upper"))


def rhat(draws: DataFrame) -> DataFrame:
    """param, idx, rhat: split potential scale reduction, from moments of half chains."""
    chain = [*keys_of(draws)[:-2], "chain"]
    last = draws.groupBy(*chain).agg(F.max("iteration").alias("__last"))
    halves = draws.join(last, chain).withColumn("half", (F.col("iteration") * 2 > F.col("__last")).cast("int"))
    each = halves.groupBy(*keys_of(draws), "chain", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    both = each.groupBy(*keys_of(draws)).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return both.select(*keys_of(draws), F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("rhat"))


# The rational approximations of the normal quantile by Wichura (1988), algorithm AS 241, seven figures and more:
# coefficients of numerators and denominators, from the constant on, near the centre, in the tails and far out.
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
TAIL = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
       (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def normal_score(p: Column) -> Column:
    """The normal quantile of a column in (0, 1)."""

    def ratio(parts, x):
        up, down = (reduce(lambda acc, c: acc * x + c, reversed(side), F.lit(0.0)) for side in parts)
        return up / down

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    return F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * F.when(r <= 5, ratio(TAIL, r - 1.6)).otherwise(ratio(FAR, r - 5)))


#: Range blocks that the values of a parameter are cut into, at most; a task ranks one block.
RANK_BLOCKS = 64
#: Distinct values that a range block is cut by, on average, at most.
CUT_VALUES = 32


def range_cuts(counts: DataFrame, keys: list[str], value: str, blocks: int = RANK_BLOCKS) -> DataFrame:
    """``keys``, ``__cuts`` (fewer than ``blocks`` values, ascending) and ``total`` (sum of ``__n``) of distinct values. The cuts are
    quantiles of the values that a hash picks, so they are the same each time that they are computed, in any order of rows."""
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("__d"), F.sum("__n").alias("total"))
    every = F.ceil(F.col("__d") / (CUT_VALUES * blocks))
    some = F.when(F.pmod(F.xxhash64(*keys, value), every) == 0, F.col(value))
    taken = counts.join(sizes, keys).groupBy(*keys, "total").agg(F.sort_array(F.collect_list(some)).alias("__cuts"))
    part = lambda i: F.floor(i * blocks / F.size("__cuts"))
    return taken.withColumn("__cuts", F.filter("__cuts", lambda _, i: (i > 0) & (part(i) > part(i - 1))))


def ranks(values: DataFrame, keys: list[str], value: str, blocks: int = RANK_BLOCKS) -> DataFrame:
    """``values`` with ``rank`` (mean rank of equal values, from 1) and ``total`` within ``keys``. Equal values are counted first; the
    distinct ones are cut into range blocks at approximate quantiles, which are numbered apart and moved by the counts of the
    blocks before them. So ranks are exact, and no task sorts all values of a key."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = counts.join(range_cuts(counts, keys, value, blocks), keys).withColumn("__block", F.aggregate("__cuts", F.lit(0), lambda a, c: a + (c < F.col(value)).cast("int"))).drop("__cuts")
    sums = placed.groupBy(*keys, "__block").agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # RANK_BLOCKS rows
    starts = sums.select(*keys, "__block", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("__low", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, [*keys, "__block"])
    rank = F.col("__start") + F.col("__low") + (F.col("__n") + 1) / 2
    return values.join(found.select(*keys, value, rank.alias("rank"), "total", (F.col("__start") + F.col("__low")).alias("below"), F.col("__n").alias("equal")), [*keys, value])


def rank_rhat(draws: DataFrame, blocks: int = RANK_BLOCKS) -> DataFrame:
    """param, idx, bulk, tail, rhat: split potential scale reduction of rank-normalised draws (bulk) and of their rank-normalised
    distances from the median (tail); rhat is the larger one (Vehtari and others, 2021)."""
    keys = keys_of(draws)

    def scored(rows: DataFrame, value: str) -> DataFrame:
        return ranks(rows, keys, value, blocks).withColumn("score", normal_score((F.col("rank") - 0.375) / (F.col("total") + 0.25)))

    def of(rows: DataFrame, name: str) -> DataFrame:
        return rhat(rows.select(*keys, "chain", "iteration", F.col("score").alias("value"))).withColumnRenamed("rhat", name)

    bulk = scored(draws, "value")
    # the median from the ranks: the values that hold the middle positions
    holds = lambda at: F.max(F.when((F.col("below") < at) & (at <= F.col("below") + F.col("equal")), F.col("value")))
    middle = bulk.groupBy(*keys).agg(((holds(F.floor((F.col("total") + 1) / 2)) + holds(F.ceil((F.col("total") + 1) / 2))) / 2).alias("__median"))
    folded = draws.join(middle, keys).withColumn("__away", F.abs(F.col("value") - F.col("__median"))).drop("__median", "value")
    both = of(bulk, "bulk").join(of(scored(folded.select(*keys, "chain", "iteration", F.col("__away").alias("value")), "value"), "tail"), keys)
    return both.select(*keys, "bulk", "tail", F.greatest("bulk", "tail").alias("rhat"))


#: Parameters that a warning names at most, the worst ones.
MOST_NAMED = 100


def warn_unless_converged(draws: DataFrame, threshold: float = 1.1) -> list[str]:
    """Warn of parameters whose rank-normalised R-hat is at or above ``threshold``, and return their names."""
    worst = rank_rhat(draws).filter(F.col("rhat") >= threshold).orderBy(F.desc("rhat"), *keys_of(draws)).limit(MOST_NAMED + 1).collect()
    found = [f"{r['param']}[{r['idx']}]" for r in worst[:MOST_NAMED]]
    if found:
        more = " and others" if len(worst) > MOST_NAMED else ""
        warnings.warn(f"R-hat of {threshold} or more: {', '.join(found)}{more}", stacklevel=2)
    return found


def confusion(truth: DataFrame, estimate: DataFrame, threshold: float = 0.0) -> DataFrame:
    """truth, estimate, n: counts of coefficients that are (1) or are not (0) larger than ``threshold`` in size, of tables
    (param, idx, value)."""
    nonzero = lambda c: (F.abs(c) > threshold).cast("int")
    both = truth.select(*KEY, nonzero(F.col("value")).alias("truth")).join(estimate.select(*KEY, nonzero(F.col("value")).alias("estimate")), KEY)
    return both.groupBy("truth", "estimate").agg(F.count("*").alias("n"))


def selection_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, fscore, fdr and fnr. The positive class is a coefficient of zero, as is usual for sparse models'
    tables of this kind; so precision is the share of true zeros among estimated ones."""
    at = lambda t, e: F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("estimate") == e), F.col("n"))), F.lit(0))
    c = counts.agg(at(0, 0).alias("tp"), at(1, 0).alias("fp"), at(0, 1).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return c.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("fscore"), (1 - p).alias("fdr"), (1 - r).alias("fnr"))


def frobenius_error(truth: DataFrame, estimate: DataFrame, rows: int, dim: int) -> DataFrame:
    """fromse: 100 times the Frobenius norm of the difference, over the number of coefficients."""
    both = truth.select(*KEY, F.col("value").alias("a")).join(estimate.select(*KEY, F.col("value").alias("b")), KEY)
    return both.agg((100 * F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)) / (rows * dim)).alias("fromse"))


def spectral_norms(truth: DataFrame, estimate: DataFrame, rows: int, dim: int) -> DataFrame:
    """spne, relspne: the spectral norm of the difference of coefficient tables (param, idx, value; idx runs down the columns of
    ``rows`` by ``dim`` matrices), and relative to that of the truth. Sums of dim x dim products reach the driver."""
    both = truth.select(*KEY, F.col("value").alias("a")).join(estimate.select(*KEY, F.col("value").alias("b")), KEY)
    row, col = (F.col("idx") - 1) % rows, F.floor((F.col("idx") - 1) / rows)
    cell = lambda j, v: F.max(F.when(col == j, v))
    wide = both.groupBy("param", row.alias("row")).agg(*[cell(j, F.col("b") - F.col("a")).alias(f"d{j}") for j in range(dim)], *[cell(j, F.col("a")).alias(f"t{j}") for j in range(dim)])
    got = wide.agg(*[F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}_{j}") for x in "dt" for i in range(dim) for j in range(dim)]).first()
    norm = {x: float(np.sqrt(max(0.0, np.linalg.eigvalsh([[got[f"{x}{min(i, j)}_{max(i, j)}"] for j in range(dim)] for i in range(dim)])[-1]))) for x in "dt"}
    return truth.sparkSession.createDataFrame([(norm["d"], norm["d"] / norm["t"])], "spne double, relspne double")


def spectral_error(truth: np.ndarray, estimate: np.ndarray, relative: bool = False) -> float:
    """Spectral norm of the difference, or relative to that of the truth."""
    out = float(np.linalg.norm(estimate - truth, 2))
    return out / float(np.linalg.norm(truth, 2)) if relative else out
