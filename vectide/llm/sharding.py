"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Equal texts form a group; groups stay together unless one holds over half a shard in any dimension, when it is split
by a hash of the document id. A piece goes to the shard where the dot product of its (bytes, tokens, rows) with the
shard's residual capacity is highest, large pieces first. Pieces of over 1/4096 of any total, at most 12,288 by that
bound, are packed on the driver; the rest falls into cells of bounded size, each packed in a task of its own against
its share of what the large pieces left.

The law that holds is ``bytes``: sizes near equal. Defined cases: a null text has no bytes and counts with the empty
text; an empty table gives no rows; repeated rows are separate documents of one group; tiny tables leave shards empty; of
shards with equal dot products the first wins, and pieces of equal size go by the hash of their text; one very long
text is one piece, however large; a null doc_id is kept and comes first among its block's slots; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import blocks_for, bucket, keep, picked, ranked, read, spread_join
from vectide.llm.mixing import words_in

SHARDS = 16
LARGE_SHARE = 1 / 4096
CELL_ITEMS = 20_000
#: Bytes count more than tokens and rows, as the law is on them.
DIMENSION_WEIGHTS = (16.0, 1.0, 1.0)
GROUP = ["h", "text_crc32", "size"]


def pack(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each row of ``items`` (shares by dimension, in packing order); ``room`` is what each shard has left and is updated."""
    weight = np.asarray(DIMENSION_WEIGHTS)
    out = np.empty(len(items), dtype=np.int32)
    for i, v in enumerate(items):
        j = int((room @ (v * weight)).argmax())
        room[j] -= v
        out[i] = j
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes plus 1), text_crc32, tokens, law, shard, slot (its place in
    the shard, from 0) and grown_shard (null under this law)."""
    docs = picked(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), words_in(text).alias("tokens"), F.xxhash64(text).alias("h")), "shard-sizes")
    count, *sums = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    totals = [max(1, x or 0) for x in (*sums, count)]
    shares = [F.col(c) / F.lit(t) for c, t in zip(("bytes", "words", "n"), totals, strict=True)]
    sized = [(F.col("n") * F.col("size")).alias("bytes"), (F.col("n") * F.col("tokens")).alias("words")]

    groups = rows.groupBy(*GROUP, "tokens").agg(F.count("*").alias("n")).select("*", *sized).withColumn("pieces", F.ceil(F.greatest(*shares) * F.lit(2 * shards)).cast("int"))
    groups = keep(groups, "shard-groups")
    split = F.broadcast(groups.filter("pieces > 1").select(*GROUP, "pieces"))  # at most 3 * 2 * shards groups
    rows = rows.join(split, GROUP, "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("pieces")).cast("int"))).drop("pieces")
    whole = groups.filter("pieces <= 1").select(*GROUP, F.lit(0).alias("piece"), "n", "bytes", "words")
    parts = rows.join(split.drop("pieces"), GROUP, "left_semi").groupBy(*GROUP, "piece", "tokens").agg(F.count("*").alias("n")).select("*", *sized).drop("tokens")
    items = keep(whole.unionByName(parts).withColumn("large", F.greatest(*shares) > LARGE_SHARE), "shard-items")

    scale = np.array(totals, dtype=float)
    large = sorted((tuple(r) for r in items.filter("large").select("bytes", "words", "n", *GROUP, "piece").collect()), key=lambda r: (-max(r[0] / scale[0], r[1] / scale[1], r[2] / scale[2]), r))
    room = np.full((shards, 3), 1 / shards)
    put = pack(np.array([r[:3] for r in large], dtype=float).reshape(-1, 3) / scale, room)
    spark = docs.sparkSession
    first = spark.createDataFrame([(*r[3:], r[2], int(j)) for r, j in zip(large, put, strict=True)], "h long, text_crc32 long, size long, piece int, n long, shard int")

    small = items.filter("not large")
    n_small, *left = small.agg(F.count("*"), F.sum("bytes"), F.sum("words"), F.sum("n")).first()
    left = np.array([x or 0 for x in left], dtype=float) / scale
    cells = max(1, -(-n_small // CELL_ITEMS))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[["bytes", "words", "n"]].to_numpy(dtype=float) / scale
        pdf, v = pdf.assign(o=-v.max(axis=1)), v
        order = pdf.sort_values(["o", "h", "text_crc32", "size", "piece"]).index.to_numpy()
        own = room * (v.sum(axis=0) / np.where(left > 0, left, 1))
        turn = int(pdf["cell"].iat[0]) % len(own)
        got = pack(v[order], np.roll(own, turn, axis=0))
        pdf = pdf.loc[order, [*GROUP, "piece", "n"]]
        return pdf.assign(shard=((got - turn) % len(own)).astype(np.int32))

    rest = small.withColumn("cell", bucket(cells, "h", "text_crc32")).groupBy("cell").applyInPandas(fill, first.schema)
    put_all = keep(first.unionByName(rest), "shard-put")
    out = keep(spread_join(rows, put_all, [*GROUP, "piece"], "n", count), "shard-rows")
    out = ranked(out, ["shard"], [F.col("doc_id"), F.col("h")], bucket(blocks_for(count), "doc_id"), None, "slot")
    return out.select("doc_id", "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
