"""Helpers that several operators share: scratch tables, skew-safe joins, blocks, components."""

from __future__ import annotations

import atexit
import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.sources.series import scan

#: A key with more than this share of all rows is hot; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 4096
#: Tables of at most so many rows are joined by one broadcast: a join that looks for hot keys costs the driver three.
SMALL_ROWS = 1 << 16
#: Rows that one block of a blocked prefix sum holds on average.
BLOCK_ROWS = 1_024

#: Name of a module, made on a Python worker, that holds what tasks of one operator share there.
WORKER_STATE = "_vectide_worker"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one below the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vectide_scratch"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/vectide/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_scratch)
    _made.append((spark, path))
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing already written."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As :func:`keep`, with the path, for :func:`delete`."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if (spark, path) in _made:
        _made.remove((spark, path))


def drop_scratch() -> None:
    """Delete every scratch table of this process. Results that read them must have been written before."""
    for spark, path in list(_made):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: nothing can be deleted any more
            pass
    _made.clear()


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` of ``df``, whatever else it holds: an exact name wins over one in other case, and the first of
    several wins."""
    low = [c.lower() for c in df.columns]
    at = [df.columns.index(n) if n in df.columns else low.index(n.lower()) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(low))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def inner(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns c0, c1, ..., so that no name of its own can clash, and which of them ``names`` are (as in
    :func:`picked`). ``toDF(*df.columns)`` brings the names back."""
    low = [c.lower() for c in df.columns]
    at = [df.columns.index(n) if n in df.columns else low.index(n.lower()) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(low))]), [f"c{i}" for i in at]


def slices(batches, rows: int = 256):
    """Record batches in slices of a few rows, so that Python holds a few texts at once. A reused worker that turns to this
    work lets go of what it kept for other work (see :data:`WORKER_STATE`)."""
    if sys.modules.pop(WORKER_STATE, None) is not None:
        pa.default_memory_pool().release_unused()
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket(n: int, *cols: str | Column) -> Column:
    """A deterministic pseudorandom number in [0, n), independent of the partitioning."""
    return F.pmod(F.xxhash64(*cols, F.lit(7)), F.lit(n)).cast("int")


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, how: str = "inner", small: int = 0) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and whose column ``n`` counts left rows by key.

    Keys with over HOT_SHARE of the ``total`` left rows, at most 4096 by that bound, are broadcast; so no task
    ever gathers a hot key. The others meet in a shuffled join. Up to ``small`` left rows, which have no more keys than
    that, meet all of ``right`` in one broadcast join.
    """
    if total <= small:
        return left.join(F.broadcast(right.drop(n)), on, how)
    limit = max(1, int(total * HOT_SHARE))
    hot = right.filter(F.col(n) > limit)
    cold = right.filter(F.col(n) <= limit)
    keys = F.broadcast(hot.select(*on).withColumn("__hot", F.lit(True)))
    marked = left.join(keys, on, "left")
    warm = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot.drop(n)), on, "inner")
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot").join(cold.drop(n), on, how)
    return warm.unionByName(rest, allowMissingColumns=True)


def ranked(df: DataFrame, by: list[str], order: list[Column], block: Column, weight: Column | None, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` (1 where None) over earlier rows of the same ``by`` key, in the order
    (block, order). ``block`` is a column that cuts each key into blocks of bounded size, so that no task sorts a
    whole key: one small sum by (key, block), scanned in two levels, gives each block its start. ``by`` columns hold no nulls.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    rows = df.withColumn("__block", block).withColumn("__w", w)
    sums = rows.groupBy(*by, "__block").agg(F.sum("__w").alias("__s"))
    starts = scan(sums, by, "__block", {"__s": (F.sum, False)}).select(*by, "__block", F.coalesce("__s", F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum("__w").over(inner), F.lit(0)))
    joined = rows.join(starts, [*by, "__block"])
    return joined.withColumn(out, F.col(out) + F.col("__start")).drop("__block", "__start", "__w")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of undirected ``edges`` (u long, v long): one row (node, root) for each node that has an
    edge, root being the component's smallest node.

    Alternating large-star and small-star steps; each round is written to the shared folder, and the driver sees
    two counters of a round only. Nodes that hold over HOT_SHARE of a round's links are joined by a broadcast.
    """
    spark = edges.sparkSession
    now, path = written(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), f"{tag}-cc")
    state, n = None, now.count()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = spread_join(both.filter("v > u"), low, ["u"], "n", 2 * n, small=SMALL_ROWS).selectExpr("v AS u", "m AS v").distinct()
        # every node now points to smaller ones only
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], "n", 2 * n, small=SMALL_ROWS).selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").filter("u <> v").distinct()
        before = path
        now, path = written(small, f"{tag}-cc")
        delete(spark, before)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            break
        state, n = tuple(got), got[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
