"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of fixed length. Each source owes the mix a whole number of
words; it pays in slots, one block each: pass after pass over its blocks, every pass in its own pseudorandom order,
and the last slot is cut to what is still owed. For each output shard, multinomial counts of the sources' slots are
drawn, given the sources' totals, so that every total is exact. The n-th slot of a source goes through the source's
permutation to a block index, and slots meet blocks in a join on (source, block index).

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents without
words, and all documents of an empty table, take nothing; repeated rows and repeated ids are separate documents, in the
order of id and of a hash of the text, equal ones in any order; a very long text spans many blocks; columns other than
doc_id, text and source are ignored by :func:`mix` and kept by :func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import blocks_for, bucket, delete, inner, keep, ranked, read, written

BLOCK_WORDS = 256
SLOTS_PER_SHARD = 4096
SEED = 20
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Slots that NumPy's hypergeometric law takes at most.
NUMPY_SLOTS = 1_000_000_000
#: Source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000
SPACE = "\\x20\\x09-\\x0D"


def words_in(text):
    """Number of words of a text column."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> dict[str | None, float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its source's size; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out[s] for s in order if s in out)
        share = sum(weight[s] for s in order if s in free)
        over = {s for s in free if left * weight[s] / share > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / share for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


def _rounds(v: np.ndarray, half: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    """Four Feistel rounds over twice ``half`` bits, or the same backwards."""
    mask = (np.uint64(1) << half) - np.uint64(1)
    a, b = v >> half, v & mask
    with np.errstate(over="ignore"):
        for i in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            z = (a if back else b) + key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1) * np.uint64(0xD1B54A32D192ED03)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            f = (z ^ (z >> np.uint64(31))) & mask
            a, b = (b ^ f, a) if back else (b, a ^ f)
    return (a << half) | b


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of [0, n) for each key, or its inverse: Feistel rounds on the least even number of bits
    that hold n, walked on while outside [0, n)."""
    n = np.broadcast_to(n, x.shape).astype(np.uint64)
    key = np.array(np.broadcast_to(key, x.shape)).astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    out, todo = x.astype(np.uint64).copy(), np.arange(len(x))
    while len(todo):
        out[todo] = _rounds(out[todo], half[todo], key[todo], back)
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` slots out of good + bad are good. NumPy draws up to a thousand million slots; beyond, the law is summed
    up around its mode, where weights fall below what a double can tell (16 standard deviations away)."""
    if good + bad < NUMPY_SLOTS:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(good, take)
    mode = min(high, max(low, (take + 1) * (good + 1) // (good + bad + 2)))
    p = good / (good + bad)
    reach = int(16 * math.sqrt(take * p * (1 - p) * (good + bad - take) / (good + bad - 1))) + 64
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log((good - k) * ((take - k) / ((k + 1) * (bad - take + k + 1))))  # from k to k + 1
    weight = np.concatenate([[0.0], np.cumsum(step)])
    total = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def drawn(have: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of ``take`` slots given that the sources have ``have`` in all: the multivariate hypergeometric
    law, source after source."""
    out, left, rest = np.zeros(len(have), dtype=np.int64), int(take), int(have.sum())
    for i, n in enumerate(have.tolist()):
        rest -= n
        if not left:
            break
        got = hypergeometric(n, rest, left, rng) if n else 0
        out[i] = min(n, left, max(0, left - rest, got))
        left -= out[i]
    return out


def counts_of(shard: int, shards: int, per_shard: int, have: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The source counts drawn for a shard, and those of all shards before it. Halves of the shards draw from what their
    whole has, down to the shard, so any task finds any shard's counts by itself; a draw is seeded by its bounds."""
    a, b, before, have = 0, shards, np.zeros(len(have), dtype=np.int64), have.copy()
    while b - a > 1:
        m = (a + b) // 2
        left = drawn(have, (m - a) * per_shard, np.random.default_rng([seed, a, b]))
        if shard < m:
            b, have = m, left
        else:
            a, before, have = m, before + left, have - left
    return have, before


@dataclass(frozen=True)
class Source:
    name: str | None
    key: str
    size: int
    target: float
    owed: int
    blocks: int
    slots: int
    last: int  # words of the last slot


def plan(sizes: dict[str | None, int], block: int, seed: int) -> list[Source]:
    """What each source owes, in words and in slots."""
    out = []
    for i, (name, target) in enumerate(sorted(targets(sizes).items(), key=lambda x: (x[0] is None, x[0] or ""))):
        size = sizes[name]
        owed, n = min(round(target), MOST_PASSES * size), -(-size // block)
        passes, rest = divmod(owed, size) if size else (0, 0)
        slots, last = passes * n, 0
        if rest:
            short = size - (n - 1) * block
            order_key = np.uint64((seed << 40) + (i << 8) + passes)
            at = int(permuted(np.array([n - 1]), np.array(n), order_key, back=True)[0])
            m = -(-rest // block)
            before = (m - 1) * block
            if m > at:  # the short block comes among them
                m = max(at + 1, -(-(rest - short) // block) + 1)
                before = (m - 1) * block if m - 1 <= at else (m - 2) * block + short
            slots, last = slots + m, rest - before
        out.append(Source(name, "n" if name is None else "s" + name, size, target, owed, n, slots, last))
    return out


def placed(docs: DataFrame, carry: bool) -> DataFrame:
    """Each document with its size and with the number of words before it in its source's stream; ``carry`` keeps all its
    columns, as c0, c1, ..."""
    own, (doc_id, text, source) = inner(docs, "doc_id", "text", "source")
    rows = own.select(F.col(doc_id).alias("doc_id"), F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("skey"), words_in(F.col(text)).alias("size"), F.xxhash64(text).alias("__tie"), *(own.columns if carry else []))
    rows, path = written(rows, "mix-sizes")
    n = rows.count()
    out = keep(ranked(rows, ["skey"], [F.col("doc_id"), F.col("__tie")], bucket(blocks_for(n), F.col("doc_id")), F.col("size"), "start").drop("__tie"), "mix-placed")
    delete(docs.sparkSession, path)
    return out


def slots(spark: SparkSession, sources: list[Source], block: int, per_shard: int, seed: int) -> DataFrame:
    """One row for each block of the mix: shard, slot, skey, pass, idx (the block's index), words."""
    total = sum(s.slots for s in sources)
    shards = -(-total // per_shard)
    schema = "shard long, slot long, skey string, pass int, idx long, words long"

    def deal(batches):
        keys = np.array([s.key for s in sources], dtype=object)
        n_blocks, sizes, owed_slots, last = (np.array([getattr(s, f) for s in sources], dtype=np.int64) for f in ("blocks", "size", "slots", "last"))
        for pdf in batches:
            for shard in pdf["id"].tolist():
                counts, before = counts_of(shard, shards, per_shard, owed_slots, seed)
                m = int(counts.sum())
                s = np.repeat(np.arange(len(sources)), counts)
                j, n = np.arange(m) - np.repeat(np.cumsum(counts) - counts, counts) + before[s], n_blocks[s]
                passes = j // n
                idx = permuted(j % n, n, np.uint64(seed << 40) + (s.astype(np.uint64) << np.uint64(8)) + passes.astype(np.uint64))
                words = np.where(idx == n - 1, sizes[s] - (n - 1) * block, block)
                words = np.where((j == owed_slots[s] - 1) & (last[s] > 0), last[s], words)
                slot = np.random.default_rng([seed, shard]).permutation(m)  # the sources of a shard are mixed
                yield pd.DataFrame({"shard": shard, "slot": slot, "skey": keys[s], "pass": passes.astype(np.int32), "idx": idx, "words": words})

    return spark.range(shards).mapInPandas(deal, schema)


@dataclass(frozen=True)
class Mix:
    sources: list[Source]
    documents: DataFrame  # doc_id, skey, size, start and what is carried
    slots: DataFrame
    block: int

    def segments(self) -> DataFrame:
        """The part of each document in each slot: the document's key, pass, a, b (words of the document, end exclusive)."""
        b = self.block
        parts = self.documents.filter("size > 0").select("skey", "start", "size", "doc_id", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("idx"))
        near = parts.withColumn("lo", F.greatest(F.col("start"), F.col("idx") * b)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("idx") + 1) * b))
        # both sides grow with the corpus; Spark takes the slots for few, as they come from one row for each shard
        got = near.join(self.slots.hint("merge"), ["skey", "idx"]).withColumn("hi", F.least(F.col("hi"), F.col("idx") * b + F.col("words"))).filter("hi > lo")
        return got.select("skey", "start", "doc_id", "size", "shard", "slot", "pass", (F.col("lo") - F.col("start")).alias("a"), (F.col("hi") - F.col("start")).alias("b"))

    def source_table(self) -> DataFrame:
        spark = self.documents.sparkSession
        rows = spark.createDataFrame([(s.key, s.size, s.target) for s in self.sources], "skey string, source_size long, target double")
        return F.broadcast(rows) if len(self.sources) <= BROADCAST_SOURCES else rows

    def by_document(self) -> DataFrame:
        """doc_id, size, source_size, target and taken: the words the mix takes from the document, repeats counted."""
        some = self.segments().groupBy("skey", "start", "doc_id", "size").agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
        all_ = self.documents.select("skey", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        sums = some.unionByName(all_).groupBy("skey", "start", "doc_id", "size").agg(F.sum("taken").alias("taken"), F.sum(F.when(F.col("taken") == 0, 1).otherwise(0)).alias("copies"))
        # documents without words share a start: one row for each of them
        rows = sums.withColumn("copies", F.explode(F.expr("sequence(1, CASE WHEN size = 0 THEN copies ELSE 1 END)")))
        return rows.join(self.source_table(), "skey").select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK_WORDS, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED, carry: bool = False) -> Mix:
    """Plan and deal the mix of ``docs`` (doc_id, text, source). The driver holds one row for each source."""
    rows = placed(docs, carry)
    got = {r["skey"]: int(r["s"]) for r in rows.groupBy("skey").agg(F.sum("size").alias("s")).toLocalIterator()}
    sources = plan({None if k == "n" else k[1:]: v for k, v in got.items()}, block, seed)
    return Mix(sources, rows, slots(docs.sparkSession, sources, block, per_shard, seed), block)


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row, with the columns of ``docs``, for each pass that takes words of a document. A text
    that a pass takes whole stays as it is; otherwise it is the words taken, in their order, joined by spaces."""
    m = mix(docs, block=block, seed=seed, carry=True)
    own, (text, *_) = inner(docs, "text")
    ranges = m.segments().groupBy("skey", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"), F.sum(F.col("b") - F.col("a")).alias("taken"))
    rows = m.documents.filter("size > 0").join(ranges.hint("merge"), ["skey", "start"])
    words = f"filter(split({text}, '[{SPACE}]+'), w -> w <> '')".replace("\\", "\\\\")
    part = F.expr(f"array_join(flatten(transform(ranges, r -> slice({words}, int(r.a) + 1, int(r.b - r.a)))), ' ')")
    out = rows.withColumn("part", F.when(F.col("taken") == F.col("size"), F.col(text)).otherwise(part))
    new = {text: F.col("part")}
    if "n_chars" in docs.columns:
        n_chars = f"c{docs.columns.index('n_chars')}"
        new[n_chars] = F.length("part").cast(own.schema[n_chars].dataType)
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in own.columns]).toDF(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).by_document()


QUERIES = {"op5_mixing": op5_mixing}
