"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over GRAM bytes makes triggers: strings whose hash is 0 modulo TRIGGER_MOD, and, where SPAN bytes hold
none, the one with the least hash. Each window of SPAN bytes belongs to the first trigger in it, so a text is parsed into
phrases, the windows of one trigger each, and equal windows have equal triggers at equal places. The dictionary holds the
distinct phrases under their triggers; the parse is their occurrences in corpus order.

A trigger that occurs once has nothing to say. Of an equal phrase all occurrences but the first repeat it whole. What is
left is the dictionary under triggers that different phrases share. There a window is a suffix of the dictionary, the
bytes of a phrase up to its trigger, followed by a suffix of the parse, what comes after the trigger. Both are sorted
under each trigger, with the common lengths of neighbours: phrases from the trigger backwards, so that suffixes of one
length which agree are runs of that order, and the parse's suffixes forwards, cut where no window reaches. A pair of runs
is all equal windows; in corpus order the first of them stays and the others repeat it. All of this compares bytes; only
triggers and whole phrases are told apart by 64-bit hashes. Triggers that over CROWD distinct phrases share are compared
window by window, by a hash, in a shuffle instead, so that no task gathers them.

Order is by doc_id, then, for repeated ids, by a hash of the text. Defined cases: a null text counts as empty; texts under
SPAN bytes keep all; a null doc_id comes first; of equal rows with one id any is the first; very long texts are parsed in
overlapping parts; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import blocks_for, bucket, keep, picked, ranked, read

SPAN = 100
#: Bytes that the rolling hash takes; 36 at most.
GRAM = 32
GRAMS = SPAN - GRAM + 1
#: One of so many strings is a trigger; a power of two.
TRIGGER_MOD = 64
#: Bytes that are parsed at once; longer texts are cut into overlapping parts.
BUFFER = 1 << 19
LEAST_LONG = -(1 << 63)
#: Phrases of one trigger that one task compares at most.
CROWD = 2_048


class Parser:
    """Phrases and window hashes of buffers of texts."""

    def __init__(self):
        with np.errstate(over="ignore"):
            n = 2 * BUFFER + 4 * SPAN
            base = np.uint64(0x9E3779B97F4A7C15)
            back = np.uint64(pow(int(base), -1, 1 << 64))
            self.letters = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, back)])

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """The rolling hash of each GRAM-byte string of ``data``: a difference of running sums, moved to one place and mixed."""
        s = self.sums(self.letters[data])
        z = (s[GRAM:] - s[:-GRAM]) * self.inverse[: len(data) - GRAM + 1]
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xFF51AFD7ED558CCD)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xC4CEB9FE1A85EC53)
        return z ^ z >> np.uint64(29)

    def sums(self, h: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.add.accumulate(h * self.power[: len(h)])]

    def span_hash(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the grams from start to stop, the same wherever they stand."""
        z = (sums[stop] - sums[start]) * self.inverse[start]
        return z ^ z >> np.uint64(31)

    def phrases(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """segment, first window, number of windows, hash of the trigger and of the phrase, for the segments of a buffer."""
        h = self.hashes(data)
        # the first trigger of a window wins, and where it has none its least hash
        key = np.where(h % np.uint64(TRIGGER_MOD) == 0, np.uint64(0), h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        low = key
        for d in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-d], low[d:])
        low = np.minimum(low[: len(low) - (GRAMS - 64)], low[GRAMS - 64 :])
        seg = np.repeat(np.arange(len(starts)), np.maximum(sizes - SPAN + 1, 0))
        n = np.maximum(sizes - SPAN + 1, 0)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        t = (low[p] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (seg[1:] != seg[:-1])]) if len(t) else np.empty(0, dtype=np.int64)
        count = np.diff(np.r_[new, len(t)])
        first = p[new]
        whole = self.span_hash(self.sums(h), first, first + count - 1 + GRAMS) + count.astype(np.uint64)
        return seg[new], first - starts[seg[new]], count, h[t[new]], whole


def _segments(texts: list[bytes]):
    """Buffers of (text number, offset, bytes), each buffer about BUFFER bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - SPAN + 1), BUFFER):
            part = t[a : a + BUFFER + SPAN - 1]
            if len(part) < SPAN:
                continue
            if size + len(part) > BUFFER + SPAN and held:
                yield held
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield held


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, k (the number of a text among those of its id, by text) and text."""
    rows = picked(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.withColumn("k", F.lit(0).cast("long")).select("doc_id", "k", "text")
    rows = keep(rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("row", F.monotonically_increasing_id()), "phrases-rows")
    order = [F.col("h"), F.col("row")]
    return keep(ranked(rows, ["doc_id"], order, bucket(blocks_for(rows.count()), "h", "row"), None, "k").select("doc_id", "k", "text"), "phrases-numbered")


def parse(rows: DataFrame) -> DataFrame:
    """Every phrase: g (hash of its trigger), c (of the phrase), doc_id, k, first (window), n (windows), again.

    A phrase that an equal one precedes in the same batch repeats it whatever the corpus holds: it is marked ``again`` and
    gets a number of its own as g, so that a line in very many places is one row for each batch under its trigger."""

    def run(batches):
        parser = Parser()
        for batch in batches:
            ids, ks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            found = []
            for a in range(0, batch.num_rows, 256):
                texts = [_bytes(t) for t in batch.column(2).slice(a, 256).to_pylist()]
                for held in _segments(texts):
                    sizes = np.array([len(x[2]) for x in held])
                    with np.errstate(over="ignore"):
                        seg, first, n, g, c = parser.phrases(np.frombuffer(b"".join(x[2] for x in held), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
                    of = np.array([x[0] for x in held])[seg] + a
                    at = first + np.array([x[1] for x in held])[seg]
                    found.append((g.view(np.int64), c.view(np.int64), ids[of], ks[of], at, n.astype(np.int32)))
            if not found:
                continue
            g, c, d, k, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, k, d, c, g))
            gs, cs = g[order], c[order]
            again = np.zeros(len(g), dtype=bool)
            again[order[1:]] = (gs[1:] == gs[:-1]) & (cs[1:] == cs[:-1])
            with np.errstate(over="ignore"):
                own = (d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.view(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
            g = np.where(again, (own ^ own >> np.uint64(32)).view(np.int64), g)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, c, d, k, at, n, again)], names=["g", "c", "doc_id", "k", "first", "n", "again"])

    return rows.mapInArrow(run, "g long, c long, doc_id long, k long, first long, n int, again boolean")


def spelled(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """The windows of ``phrases`` (doc_id, k, ranges of g, first and n) out of the texts of ``rows``: g, w (their hash), doc_id, k, p."""

    def run(batches):
        parser = Parser()
        for batch in batches:
            for d, k, t, ranges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = np.frombuffer(_bytes(t), dtype=np.uint8)
                g, first, n = (np.array([r[f] for r in ranges]) for f in ("g", "first", "n"))
                out = []
                for a in range(0, max(1, len(data) - SPAN + 1), BUFFER):
                    near = (first < a + BUFFER) & (first + n > a)
                    p = np.concatenate([np.arange(x, x + m) for x, m in zip(first[near].tolist(), n[near].tolist(), strict=True)] or [np.empty(0, np.int64)])
                    of, here = np.repeat(g[near], n[near]), (p >= a) & (p < a + BUFFER)
                    of, p = of[here], p[here]
                    if len(p):
                        with np.errstate(over="ignore"):
                            s = parser.sums(parser.hashes(data[a : a + BUFFER + SPAN - 1]))
                            out.append((of, p, parser.span_hash(s, p - a, p - a + GRAMS)))
                of, p, w = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(w.view(np.int64)), pa.array(np.full(len(p), d)), pa.array(np.full(len(p), k)), pa.array(p)], names=["g", "w", "doc_id", "k", "p"])

    return rows.join(phrases, ["doc_id", "k"]).select("doc_id", "k", "text", "ranges").mapInArrow(run, "g long, w long, doc_id long, k long, p long")


def contents(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """The bytes that the windows of ``phrases`` (doc_id, k, ranges of g, first and n) cover: g, doc_id, k, first, n, content."""

    def run(batches):
        for batch in batches:
            for d, k, t, ranges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = _bytes(t)
                g, first, n = ([r[f] for r in ranges] for f in ("g", "first", "n"))
                parts = [data[x : x + m - 1 + SPAN] for x, m in zip(first, n, strict=True)]
                columns = (pa.array(g, pa.int64()), pa.array(np.full(len(g), d)), pa.array(np.full(len(g), k)), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), names=["g", "doc_id", "k", "first", "n", "content"])

    return rows.join(phrases, ["doc_id", "k"]).select("doc_id", "k", "text", "ranges").mapInArrow(run, "g long, doc_id long, k long, first long, n int, content binary")


def runs(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of ``strings`` (bytes) in the order of (group, string), and for each place and length the number
    of the run of rows that agree so far: places of one run have equal beginnings of that length."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : strings.shape[1]] = strings
    words = wide.view(">u8")
    order = np.lexsort([*words.T[::-1], group])
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))
    new = common[:, None] < np.arange(strings.shape[1] + 1)
    return at, np.concatenate([np.zeros((1, new.shape[1]), dtype=np.int64), np.cumsum(new, axis=0)])


def repeated_windows(parser: Parser, g: np.ndarray, n: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of phrases (in corpus order under each trigger ``g``; ``n`` windows each, which cover ``parts``):
    the phrase, the window's number in it, and whether an earlier phrase or window of the trigger has an equal one."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    at = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    with np.errstate(over="ignore"):
        h = parser.hashes(data)
    near = at[:, None] + np.arange(GRAMS)
    trigger = (h[near] == g.view(np.uint64)[:, None]).argmax(axis=1)  # the first of the phrase's first window
    # the dictionary: what stands before the trigger, backwards; the parse: what follows it
    reach = np.arange(GRAMS - 1)
    padded = np.r_[data, np.zeros(SPAN, dtype=np.uint8)]
    before = np.where(reach < trigger[:, None], data[np.maximum(at + trigger, 1)[:, None] - 1 - np.minimum(reach, np.maximum(trigger - 1, 0)[:, None])], 0)
    left = sizes - trigger - GRAM
    after = np.where(reach < left[:, None], padded[(at + trigger + GRAM)[:, None] + reach], 0)
    _, group = np.unique(g, return_inverse=True)
    place, suffixes = runs(group, before.astype(np.uint8))
    rank, following = runs(group, after.astype(np.uint8))
    row = np.repeat(np.arange(len(n)), n)
    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = trigger[row] - p
    same = (suffixes[place[row], length] * GRAMS + length) * (len(n) + 1) + following[rank[row], GRAMS - 1 - length]
    by = np.argsort(same, kind="stable")  # so equal windows stay in corpus order
    again = np.zeros(len(row), dtype=bool)
    again[by[1:][same[by[1:]] == same[by[:-1]]]] = True
    return row, p, again


def compared(phrases: DataFrame) -> DataFrame:
    """Runs of windows of ``phrases`` that an earlier phrase of the same trigger holds: doc_id, k, first, n."""
    order = ["g", "doc_id", "k", "first"]

    def compare(parser, rows):
        g, d, k, first, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        parts = rows.column(5).to_pylist()
        n = n.astype(np.int64)
        row, p, again = repeated_windows(parser, g, n, parts)
        start = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & np.r_[False, row[1:] == row[:-1]]))
        stop = np.flatnonzero(again & ~(np.r_[again[1:], False] & np.r_[row[1:] == row[:-1], False]))
        r = row[start]
        return pa.RecordBatch.from_arrays([pa.array(d[r]), pa.array(k[r]), pa.array(first[r] + p[start]), pa.array((stop - start + 1).astype(np.int32))], names=["doc_id", "k", "first", "n"])

    def run(batches):
        parser, held = Parser(), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            size = np.cumsum(held.column(4).to_numpy() + SPAN)
            while len(size) and size[-1] > BUFFER:
                # as many whole triggers as a buffer takes; what follows the last one may not be complete
                g = held.column(0).to_numpy()
                ends = np.flatnonzero(g[1:] != g[:-1]) + 1
                ends = ends[: max(1, int(np.searchsorted(size[ends - 1], BUFFER)))]
                if not len(ends):
                    break
                yield compare(parser, held.slice(0, ends[-1]).combine_chunks())
                held = held.slice(ends[-1])
                size = np.cumsum(held.column(4).to_numpy() + SPAN)
        if held is not None and held.num_rows:
            g = held.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            size, a = np.cumsum(held.column(4).to_numpy() + SPAN), 0
            while a < len(g):
                room = [c for c in cut if c > a and size[c - 1] - (size[a - 1] if a else 0) <= BUFFER] or [next(c for c in cut if c > a)]
                yield compare(parser, held.slice(a, room[-1] - a).combine_chunks())
                a = room[-1]

    return phrases.repartition("g").sortWithinPartitions(*order).mapInArrow(run, "doc_id long, k long, first long, n int")


def repeats(rows: DataFrame) -> DataFrame:
    """Runs of repeated windows: doc_id, k, first, n. A window repeats if an equal one starts earlier."""
    by_trigger = Window.partitionBy("g", "again")
    found = parse(rows).select("*", F.min("c").over(by_trigger).alias("c0"), F.max("c").over(by_trigger).alias("c1"), F.count("*").over(by_trigger).alias("m")).filter("m > 1 OR again")
    nth = F.row_number().over(Window.partitionBy("g", "again", "c").orderBy("doc_id", "k", "first"))
    found = found.withColumn("nth", F.when(F.col("again"), 2).otherwise(nth)).filter("nth > 1 OR c0 <> c1").withColumn("heads", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_trigger))
    found = keep(found.select("g", "doc_id", "k", "first", "n", "nth", "heads"), "phrases-found")
    whole = found.filter("nth > 1").select("doc_id", "k", "first", "n")
    gather = lambda df, *c: df.groupBy("doc_id", "k").agg(F.collect_list(F.struct(*c)).alias("ranges"))  # noqa: E731  bounded by the text
    heads = found.filter("nth = 1")
    few = compared(contents(rows, gather(heads.filter(F.col("heads") <= CROWD), "g", "first", "n")))
    out = whole.unionByName(few)
    crowded = heads.filter(F.col("heads") > CROWD)
    if crowded.isEmpty():
        return out
    windows = keep(spelled(rows, gather(crowded, "g", "first", "n")), "phrases-windows")
    order = F.struct("doc_id", "k", "p")
    # a passage with a border in many documents makes hot windows: they are summed before the shuffle, and the join of
    # one row for each window can be split
    firsts = windows.groupBy("g", "w").agg(F.count("*").alias("m"), F.min(order).alias("o")).filter("m > 1").drop("m")
    again = windows.join(firsts, ["g", "w"]).filter(order != F.col("o")).select("doc_id", "k", F.col("p").alias("first"), F.lit(1).alias("n"))
    return out.unionByName(again)


def removed(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (of
    removed bytes, end exclusive)."""
    rows = numbered(docs)
    ranges = repeats(rows).groupBy("doc_id", "k").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, out = batch.slice(a, 512), []
                for d, t, found in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = _bytes(t)
                    spans = union(found or [])
                    digest, at = hashlib.sha256(), 0
                    for x, y in spans:
                        digest.update(data[at:x])
                        at = y
                    digest.update(data[at:])
                    out.append((d, len(data), sum(y - x for x, y in spans), len(spans), digest.hexdigest(), [{"start": x, "stop": y} for x, y in spans]))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = rows.join(ranges, ["doc_id", "k"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def union(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal byte runs that runs of windows cover."""
    out: list[list[int]] = []
    for x, n in sorted((r["first"], r["n"]) for r in ranges):
        y = x + n - 1 + SPAN
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents"))


QUERIES = {"op7_phrases": op7_phrases}
