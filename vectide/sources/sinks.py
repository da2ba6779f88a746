"""Tables of draws, forecasts and indices, written for later readers."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> str:
    """Write ``df`` in any format that Spark has, in folders by ``partition_by``; returns ``path``."""
    df.write.format(fmt).options(**options).mode(mode).partitionBy(*partition_by).save(path)
    return path


def write_draws(draws: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Draws (chain, iteration, param, idx, value) by parameter, so that a reader of one reads no other."""
    return write_table(draws, path, ("param",), mode=mode)


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("chain", "iteration", "param", "idx", "value")


_tables: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one below the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vectide_scratch"
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there is deleted by :func:`dropped`, or at the end of the process."""
    if not _tables:
        atexit.register(drop_tables)
    path = f"{shared_folder(spark)}/vectide/{tag}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def kept_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path: lineage ends here, and a lost executor costs nothing that is
    already written. Deleted by :func:`dropped`, or at the end of the process."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(path: str) -> None:
    """Delete a table of :func:`kept_table` that nothing reads any more."""
    spark = _tables.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables() -> None:
    for path in list(_tables):
        try:
            dropped(path)
        except Exception:  # noqa: BLE001  the session is gone: nothing can be deleted any more
            pass
