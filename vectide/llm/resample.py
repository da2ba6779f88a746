"""Target-distribution importance resampling over hashed n-grams of words.

Identical texts are collapsed by grouping on the full text. Each distinct text's words and runs of two and three words are
hashed into BUCKETS once and kept as a compact array beside the text's digest and multiplicity; bucket counts of the raw
corpus are sums of these arrays times the multiplicity, those of the target come from its own texts. A text's weight is the
sum of its buckets' gains and is joined back by digest; texts that very many documents share are joined by a broadcast. Then
each document draws its Gumbel noise from a hash of its id, and the documents with the highest scores are taken, as exact
sampling without replacement in proportion to exp(weight / 1000).

Ranks come from a range partitioning: a partition's documents are numbered apart and moved by the partitions before it.

Defined cases: a null text has no words, weight 0 and a score; a null doc_id hashes as the empty text and comes first among
ties; repeated rows are documents of their own, with equal scores and ranks next to each other; texts of under LEAST_WORDS
words are weighed and never drawn; an empty table gives no rows, an empty target no counts; very long texts are read whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import inner, keep, picked, read, slices, spread_join

BUCKETS = 10_000
LONGEST = 3
SEED = 42
SHARE = 5  # of the documents that may be drawn, in per cent
LEAST_WORDS = 20
#: Documents that one partition of the ranking sorts.
PART_ROWS = 1_000_000
#: Bytes of buckets that a task holds before it passes them on.
PIECE = 4_000_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").translate(_LOW))]


def buckets(found: list[bytes]) -> np.ndarray:
    """The bucket of every run of one to LONGEST words: a checksum goes on from that of the run it extends."""
    crc, tails, out, open_runs = zlib.crc32, {}, [], []
    for w in found:
        own = tails.get(w)
        if own is None:
            own = tails[w] = (crc(w), b" " + w)
        now = [own[0]]
        for run in open_runs:
            now.append(crc(own[1], run))
        out += now
        open_runs = now[: LONGEST - 1]
    return (np.array(out, dtype=np.uint32) % BUCKETS).astype(np.uint16)


def collapsed(docs: DataFrame, tag: str) -> DataFrame:
    """digest, copies, n_words and buckets (two bytes each) of the distinct texts of ``docs``, written to the shared folder."""
    names, kinds = ["digest", "copies", "n_words", "buckets"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        held, size = [], 0
        for batch in slices(batches):
            for digest, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(text)
                held.append((digest, copies, len(found), buckets(found).tobytes()))
                size += len(held[-1][-1])
                if len(held) >= 1_000 or size >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    distinct = _texts(docs, "text").groupBy("text").agg(F.count("*").alias("copies"))
    return keep(distinct.select(_digest().alias("digest"), "copies", "text").mapInArrow(run, "digest binary, copies long, n_words long, buckets binary"), tag)


def _texts(docs: DataFrame, *names: str) -> DataFrame:
    return picked(docs, *names).withColumn("text", F.coalesce("text", F.lit("")))


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences in each bucket over :func:`collapsed` texts, copies counted."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            raw = [np.frombuffer(b, dtype=np.uint16) for b in batch.column(1).to_pylist()]
            if raw:
                times = np.repeat(batch.column(0).to_numpy(), [len(b) for b in raw])
                total += np.bincount(np.concatenate(raw), weights=times, minlength=BUCKETS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = texts.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums.collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratios of smoothed frequencies, rounded down."""
    of_raw, of_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_raw / ((s + 1.0) * of_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, copies, n_words, n_features and weight of each distinct text."""

    def run(batches):
        for batch in batches:
            raw = [np.frombuffer(b, dtype=np.uint16) for b in batch.column(3).to_pylist()]
            more = [pa.array([len(b) for b in raw], pa.int64()), pa.array([int(gain[b].sum()) for b in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], names=["digest", "copies", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document, written to the shared folder."""
    texts = collapsed(docs, "resample-texts")
    gain = gains(bucket_counts(texts), bucket_counts(collapsed(target, "resample-target")))
    of_text = weighed(texts, gain)
    total = texts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = spread_join(_texts(docs, "doc_id", "text").select("doc_id", _digest().alias("digest")), of_text, ["digest"], "copies", total)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    return keep(rows.select("doc_id", "n_words", "n_features", "weight", score.alias("score")), "resample-scored")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) and n_words of each document: ``share`` per cent of those
    with ``least_words`` words are drawn."""
    rows = scored(docs, target, seed)
    spark, may = rows.sparkSession, F.col("n_words") >= least_words
    n = rows.filter(may).count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    ranked = keep(rows.filter(may).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "resample-ranked")
    part, own = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    drawn = ranked.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("start") + own + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    taken = F.when(F.col("rank") <= share * n // 100, F.col("rank"))
    return drawn.select(*columns, taken.alias("rank"), "n_words").union(rows.filter(~may).select(*columns, F.lit(None).cast("long"), "n_words"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; documents that share an id are drawn together."""
    ids = resampled(docs, target, **options).filter("rank IS NOT NULL").select("doc_id").distinct()
    own, (doc_id,) = inner(docs, "doc_id")
    return own.join(ids, own[doc_id].eqNullSafe(ids["doc_id"]), "left_semi").toDF(*docs.columns)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op13_resample": op13_resample}
