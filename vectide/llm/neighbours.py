"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Hadamard transform) and
hashed to their nearest signed axis. A hash joins the axes of several rotations, the last of them cut to its first
coordinates, so that a table has about as many buckets as there are distinct vectors: the share of rows that a query
meets falls as the table grows. Each of TABLES tables has rotations of its own; a query probes the buckets nearest to it
in each, at least PROBES (see :func:`probes_for`).

Only ids are hashed, shuffled and met. Each query's candidates then go to the blocks of rows that hold their vectors,
and every block reranks by exact distance. Equal vectors are one row of the index; their ids come back at the end. A
bucket that holds a third of all rows is cut into blocks of rows and of probes, each in a task that streams. A query
that met fewer rows than it asks for is measured against all of them.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without id, take no part, as
rows or queries; vectors meet only those of their own length; equal distances go to the smaller id; of rows with one id
each distinct vector is a candidate once, and rows with a query's id are none of its candidates; of several query rows
with one id the least vector asks; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import keep, read

TABLES = 32
PROBES = 40
PROBES_AT = 50_000
BUCKET_ROWS = 3
NEIGHBOURS = 10
QUERY_EVERY = 100
#: Rows of the index that one task holds, and candidate pairs that it makes or measures at once.
BLOCK_ROWS = 20_000
BLOCK_PROBES = 1 << 18
BLOCK_PAIRS = 1 << 20
SEED = 3
#: Rows that are turned at once.
CHUNK = 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column, scaled to keep lengths; the number of rows is a power of two."""
    n, h = len(x), 1
    while h < n:
        y = x.reshape(n // (2 * h), 2, h, -1)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(n, -1)
        h *= 2
    return x / np.sqrt(n, dtype=x.dtype)


def padded(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def rotated(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """Columns of ``x``, whose rows are filled up to a power of two, after the pseudo-rotation of that number."""
    n = padded(len(x))
    y = np.zeros((n, x.shape[1]), dtype=np.float32)
    y[: len(x)] = x
    rng = np.random.default_rng([seed, number, n])
    for _ in range(3):
        y = hadamard(y * rng.choice(np.array([-1, 1], dtype=np.float32), (n, 1)))
    return y


def depths(n: int, size: int) -> list[int]:
    """Coordinates of each rotation of a hash, for ``n`` vectors of ``size``: signed axes multiply to about ``n`` buckets."""
    full, want, out = padded(size), float(n), []
    while not out or want >= 4:
        d = min(full, 1 << int(math.log2(max(1.0, want / 2)) + 0.25))
        out.append(d)
        want /= 2 * d
    return out


def probes_for(n: int, dims: list[int], probes: int = PROBES) -> int:
    """More probes where buckets hold fewer rows than BUCKET_ROWS, and by the square root of ``n`` beyond PROBES_AT."""
    return math.ceil(probes * max(1.0, n / PROBES_AT) ** 0.5 * max(1.0, BUCKET_ROWS * math.prod(2 * d for d in dims) / n))


def codes(x: np.ndarray, dims: list[int], table: int) -> np.ndarray:
    """The bucket of each column of ``x``."""
    out = np.zeros(x.shape[1], dtype=np.int64)
    for k, d in enumerate(dims):
        y = rotated(x, table * len(dims) + k)[:d]
        at = np.abs(y).argmax(axis=0)
        out = out * (2 * d) + at + d * (y[at, np.arange(x.shape[1])] < 0)
    return out


def nearest_codes(x: np.ndarray, dims: list[int], table: int, probes: int) -> np.ndarray:
    """The ``probes`` buckets nearest to each column of ``x`` (all buckets, if fewer): the less the axes of a bucket fall
    short of the nearest ones, in squares, the nearer."""
    n = x.shape[1]
    short, code = np.zeros((n, 1), dtype=np.float32), np.zeros((n, 1), dtype=np.int64)
    for k, d in enumerate(dims):
        y = rotated(x, table * len(dims) + k)[:d].T
        s = np.concatenate([y, -y], axis=1)
        gap = (s.max(axis=1, keepdims=True) - s) ** 2
        short = (short[:, :, None] + gap[:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * (2 * d) + np.arange(2 * d)).reshape(n, -1)
        if short.shape[1] > probes:
            best = np.argpartition(short, probes - 1, axis=1)[:, :probes]
            short, code = np.take_along_axis(short, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.filter(ok & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def hashed(rows: DataFrame, plan: dict[int, tuple[list[int], int]], tables: int, probing: bool) -> DataFrame:
    """size, tab, code and id of each row (id, v): its own bucket in each table, or those that it probes. ``plan`` has the
    rotations and the number of probes by vector length; rows of other lengths are left out."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.asarray(lists.value_lengths())
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for size in set(np.unique(sizes).tolist()) & plan.keys():
                dims, probes = plan[size]
                step = max(1, min(CHUNK, (1 << 22) // (probes * 2 * max(dims)))) if probing else CHUNK
                at = np.flatnonzero(sizes == size)
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    x = flat[(ends[some] - size)[None, :] + np.arange(size)[:, None]]
                    x = x / np.abs(x).max(axis=0)
                    x = (x / np.sqrt((x * x).sum(axis=0))).astype(np.float32)
                    for t in range(tables):
                        c = nearest_codes(x, dims, t, probes) if probing else codes(x, dims, t)[:, None]
                        n = c.size
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, dtype=np.int32)) for v in (size, t)] + [pa.array(c.ravel()), pa.array(np.repeat(ids[some], c.shape[1]))], names=["size", "tab", "code", "id"])

    return rows.select("id", "v").mapInArrow(run, "size int, tab int, code long, id long")


def streamed(keys: int, held, asked):
    """A function of batches sorted by ``keys`` leading columns and then by kind: gathers the rows of kind 0 of each key
    (``held`` makes them into what ``asked`` takes), and gives each run of rows of kind 1 to ``asked``, which yields."""

    def run(batches):
        key, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys + 1)])
            cuts = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(heads[:keys, a].tolist())) != key:
                    key, parts, index = now, [], None
                rows = batch.slice(a, b - a)
                if heads[keys, a] == 0:
                    parts.append(rows)
                elif parts:
                    index = held(parts) if index is None else index
                    yield from asked(index, rows, now)

    return run


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((z ^ z >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def meetings(index: DataFrame, probes: DataFrame, parts: int, blocks: int) -> DataFrame:
    """Candidates: query, size, block, and ids (longs as bytes) of rows of that block in one bucket with a probe."""
    keys = ["size", "tab", "part"]
    part = F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")
    index, probes = keep(index.withColumn("part", part), "ann-index"), keep(probes.withColumn("part", part), "ann-probes")
    sizes = lambda df, n, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    # one row for each table and part
    cut = keep(sizes(index, BLOCK_ROWS, "n_rows").join(sizes(probes, BLOCK_PROBES, "n_probes"), keys), "ann-parts")
    rows = index.join(cut, keys).withColumn("r", F.pmod(F.xxhash64("id"), F.col("n_rows")).cast("int")).withColumn("p", F.explode(F.expr("sequence(0, n_probes - 1)")))
    asked = probes.join(cut, keys).withColumn("p", F.pmod(F.xxhash64("id"), F.col("n_probes")).cast("int")).withColumn("r", F.explode(F.expr("sequence(0, n_rows - 1)")))
    cols = [*keys, "r", "p", "kind", "code", "id"]
    both = rows.withColumn("kind", F.lit(0)).select(*cols).union(asked.withColumn("kind", F.lit(1)).select(*cols))

    def held(found):
        code, ids = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i in (6, 7))
        order = np.argsort(code, kind="stable")
        return code[order], ids[order]

    def meet(known, batch, key):
        code, ids = known
        want, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
        lo, hi = np.searchsorted(code, want), np.searchsorted(code, want, side="right")
        hit = np.flatnonzero(hi > lo)
        hit = hit[np.argsort(query[hit], kind="stable")]
        lo, n, query = lo[hit], (hi - lo)[hit], query[hit]
        step = np.cumsum(n) // BLOCK_PAIRS
        for some in np.split(np.arange(len(hit)), np.flatnonzero(step[1:] != step[:-1]) + 1):
            if not len(some):
                continue
            m = n[some]
            got = ids[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[some], m)]
            q, block = np.repeat(query[some], m), block_of(got, blocks)
            order = np.lexsort((got, block, q))
            q, block, got = q[order], block[order], got[order]
            new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (block[1:] != block[:-1])])
            lists = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.r_[new, len(got)] * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(got))])
            yield pa.RecordBatch.from_arrays([pa.array(q[new]), pa.array(np.full(len(new), key[0], dtype=np.int32)), pa.array(block[new]), lists], names=["query", "size", "block", "ids"])

    order = [*keys, "r", "p"]
    return both.repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(streamed(5, held, meet), "query long, size int, block long, ids binary")


def measured(vectors: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """query, id, first and score of the ``most`` nearest candidates in each block. ``vectors``: size, block, id, first, v;
    the smaller first wins a tie. ``asked``: size, block, query, v, ids (lists of longs as bytes; null: all rows of the block)."""
    n_asked = asked.groupBy("size", "block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("turns"))
    cols = ["size", "block", "turn", "kind", "id", "v", "ids", "first"]
    turns = keep(n_asked, "ann-turns")  # one row for each block
    rows = vectors.join(turns, ["size", "block"]).withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))).withColumn("kind", F.lit(0)).withColumn("ids", F.lit(None).cast("array<binary>"))
    some = asked.join(turns, ["size", "block"]).withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).withColumn("kind", F.lit(1)).withColumn("first", F.lit(0).cast("long")).withColumnRenamed("query", "id")
    both = rows.select(*cols).union(some.select(*cols))

    def matrix(column, size):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def held(found):
        size = found[0].column(0)[0].as_py()
        ids, first = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i in (4, 7))
        x = np.concatenate([matrix(b.column(5), size) for b in found])
        order = np.argsort(ids, kind="stable")
        return ids[order], first[order], x[order]

    def measure(known, batch, key):
        ids, first, x = known
        queries, q = batch.column(4).to_numpy(zero_copy_only=False), matrix(batch.column(5), key[0])
        out = []
        for i, lists in enumerate(batch.column(6).to_pylist()):
            at = np.arange(len(ids)) if lists is None else np.searchsorted(ids, np.unique(np.frombuffer(b"".join(lists), dtype=np.int64)))
            score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            if len(at) > most:  # ties with the last stay
                near = np.flatnonzero(score <= np.partition(score, most - 1)[most - 1])
                at, score = at[near], score[near]
            best = np.lexsort((first[at], score))[:most]
            out.append((np.full(len(best), queries[i]), ids[at[best]], first[at[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "first", "score"])

    order = ["size", "block", "turn"]
    return both.repartition(*order).sortWithinPartitions(*order, "kind", "id").mapInArrow(streamed(3, held, measure), "query long, id long, first long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    rows = usable(vectors, id_column, vector_column)
    # equal vectors: one row of the index, with the least of their ids; the number that stands for them is written down
    index = rows.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    index = keep(index.withColumn("size", F.size("v")).withColumn("id", F.monotonically_increasing_id()), "ann-vectors")
    counts = {r["size"]: r["n"] for r in index.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row for each vector length
    total = sum(counts.values())
    plan = {size: (dims := depths(n, size), probes_for(n, dims, probes)) for size, n in counts.items()}
    blocks = max(1, -(-total // BLOCK_ROWS))
    asking = keep(usable(queries, id_column, vector_column).groupBy("id").agg(F.min("v").alias("v")), "ann-asking")
    asked = keep(asking.groupBy("v").agg(F.min("id").alias("id")).withColumn("size", F.size("v")), "ann-queries")

    found = keep(meetings(hashed(index, plan, tables, False), hashed(asked, plan, tables, True), blocks, blocks), "ann-met")
    lists = found.repartition("query").groupBy("query", "size", "block").agg(F.collect_list("ids").alias("ids"))  # bounded by the block
    wanted = lists.join(asked.select(F.col("id").alias("query"), "v"), "query")
    placed = with_block(index, blocks)
    first = keep(measured(placed, wanted, k + 1), "ann-first")
    enough = first.join(index.select("id", "n"), "id").groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") > k)
    short = keep(asked.withColumnRenamed("id", "query").join(enough, "query", "left_anti"), "ann-short")
    if not short.isEmpty():
        everywhere = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long")).withColumn("ids", F.lit(None).cast("array<binary>"))
        first = first.union(measured(placed, everywhere, k + 1))

    top = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order)) <= k + 1
    each = first.groupBy("query", "id", "first").agg(F.min("score").alias("score"))
    near = each.withColumn("keep", top("query", "score", "first", "id")).filter("keep").drop("keep")
    copies = rows.join(index.filter("n > 1").select("v", F.col("id").alias("rep")), "v").select("rep", "id").distinct()
    copies = copies.withColumn("keep", top("rep", "id")).filter("keep").select("rep", F.col("id").alias("copy"))
    spread = near.join(copies, near["id"] == copies["rep"], "left").select("query", F.coalesce("copy", "first").alias("vec_id"), "score")
    best = spread.withColumn("keep", top("query", "score", "vec_id")).filter("keep").drop("keep")
    who = asking.join(asked.select("v", F.col("id").alias("query")), "v").select("query", F.col("id").alias("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = who.join(best, "query").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def with_block(index: DataFrame, blocks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_of(batch.column(1).to_numpy(zero_copy_only=False), blocks))], names=["size", "id", "v", "first", "block"])

    return index.select("size", "id", "v", "first").mapInArrow(run, "size int, id long, v array<double>, first long, block long")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op3_neighbours": op3_neighbours}
