"""SimHash near-duplicates, found by Golay-code fuzzy keys.

Each distinct fingerprint is indexed under its fuzzy keys (see golay.py). Rows of one key meet in a sorted run, where a
breadth-first walk verifies distances and gives a spanning forest of the run's links instead of all its pairs; a key
of over RUN_ROWS fingerprints is cut into chunks, and each pair of chunks is a run of its own, so no link is lost and
no task holds more. Components come from star steps over the forests' links.

Defined cases: a null text counts as empty; texts without words have fingerprint zero; fewer words than a shingle make
one shingle; a null doc_id counts as the smallest long; repeated rows share their component; very long texts are hashed
whole; an empty table gives no rows; other columns are ignored by :func:`near_duplicates` and kept by
:func:`one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import SMALL_ROWS, components, inner, keep, picked, read, slices, spread_join
from vectide.llm.golay import golay

SHINGLE_WORDS = 4
MOST_BITS = 4
XXH_SEED = 42
RUN_ROWS = 20_000
#: Runs of up to so many rows give all their links, longer ones a spanning forest.
SHORT_RUN = 4


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), XXH_SEED)
    joined = b" ".join(parts)
    stops = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    ends = (stops[words - 1 :] - 1).tolist()
    starts = [0, *stops[: len(parts) - words].tolist()]
    hash_, seed = xxhash.xxh64_intdigest, XXH_SEED
    values = np.array([hash_(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(values), 1 << 15):
        counts += np.unpackbits(values[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.arange(64, dtype=np.uint64))[2 * counts > len(values)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""

    def run(batches):
        for batch in slices(batches):
            got = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

    rows = picked(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def forest(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Position of a value and positions of values first reached from it: a spanning forest of the links at ``bits``."""
    left = np.arange(len(values))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(values[left] ^ values[x]) <= bits
            if hit.any():
                got, left = left[hit], left[~hit]
                yield x, got
                todo.extend(got)


def run_links(keys: np.ndarray, values: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of ids) inside the runs of equal, sorted keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    us, vs = [], []
    for d in range(1, SHORT_RUN):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & (size_of[d:] <= SHORT_RUN)) if len(keys) > d else np.empty(0, dtype=int)
        i = i[np.bitwise_count(values[i] ^ values[i + d]) <= bits]
        us.append(ids[i])
        vs.append(ids[i + d])
    for a, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        for x, got in forest(values[a : a + n], bits):
            us.append(np.full(len(got), ids[a + x]))
            vs.append(ids[a + got])
    return np.concatenate(us), np.concatenate(vs)


def _links(rows: DataFrame, bits: int) -> DataFrame:
    """Links of rows (key, value, id) within each key."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(parts):
            u, v = run_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), bits)
            return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

        for batch in batches:
            k, x, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # where the last, maybe unfinished run begins
            if last or (held and held[-1][0][-1] != k[0]):
                if last:
                    held.append((k[:last], x[:last].view(np.uint64), i[:last]))
                    k, x, i = k[last:], x[last:], i[last:]
                yield flush(held)
                held = []
            held.append((k, x.view(np.uint64), i))
        if held:
            yield flush(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def links(values: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Links (u, v) at ``bits`` or fewer differing bits between rows (value long, id long) with distinct values: enough to
    connect every component."""

    def spread(batches):
        g = golay()
        for batch in batches:
            v, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for a in range(0, len(v), 4096):
                rows, keys = g.keys(v[a : a + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v[a : a + 4096][rows]), pa.array(i[a : a + 4096][rows])], names=["key", "value", "id"])

    assert bits <= MOST_BITS
    keyed = values.select("value", "id").mapInArrow(spread, "key long, value long, id long")
    crowded = keep(keyed.groupBy("key").count().filter(F.col("count") > RUN_ROWS), "simhash-crowded")
    if crowded.isEmpty():
        return _links(keyed, bits)
    chunks = F.ceil(F.col("count") / RUN_ROWS).cast("int")
    many = keyed.join(crowded, "key").withColumn("n", chunks).withColumn("c", F.pmod(F.xxhash64("value"), F.col("n")).cast("int"))
    pairs = many.withColumn("o", F.explode(F.expr("sequence(0, n - 1)"))).select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "value", "id")
    return _links(keyed.join(crowded, "key", "left_anti"), bits).union(_links(pairs, bits))


def grouped(rows: DataFrame) -> DataFrame:
    """fp, id (its smallest doc_id), n (its rows), component_id and first (the component's smallest doc_id, and the smallest
    fingerprint that has it) of each fingerprint of ``rows`` (doc_id, fp). Fingerprints are the nodes, so an id that
    several texts share joins none of them."""
    distinct = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-distinct")
    linked = components(links(distinct.select(F.col("fp").alias("value"), F.col("fp").alias("id"))), "simhash")
    roots = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root"))
    best = roots.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("s"), F.count("*").alias("size"))
    best = best.select("root", F.col("s.id").alias("component_id"), F.col("s.fp").alias("first"), "size")
    return spread_join(roots, best, ["root"], "size", distinct.count(), small=SMALL_ROWS).drop("root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that
    links reach, its own included)."""
    rows = keep(fingerprints(docs), "simhash-rows")
    total = rows.count()
    out = spread_join(rows, grouped(rows).select("fp", "n", "component_id"), ["fp"], "n", total, small=SMALL_ROWS)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id. Of rows that share this id, one with
    the smallest fingerprint stays, of these the text with the smallest hash, and of equal rows one. Rows are told apart by
    id and text, so the fingerprints are made once and no text is written."""
    own, (doc_id, text) = inner(docs, "doc_id", "text")
    own = own.withColumn("id", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64(text))

    def run(batches):
        for batch in slices(batches):
            got = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], names=["id", "h", "fp"])

    rows = keep(own.select("id", "h", text).mapInArrow(run, "id long, h long, fp long"), "simhash-rows")
    first = grouped(rows.select(F.col("id").alias("doc_id"), "fp")).filter("fp = first").select("id", "fp")
    kept = rows.join(first, ["id", "fp"]).groupBy("id", "fp").agg(F.min("h").alias("h")).select("id", "h")
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64(*docs_columns(own))))
    one = own.join(kept, ["id", "h"], "left_semi").withColumn("n", nth).filter("n = 1")
    return one.select(*docs_columns(own)).toDF(*docs.columns)


def docs_columns(own: DataFrame) -> list[str]:
    return [c for c in own.columns if c not in ("id", "h")]


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
