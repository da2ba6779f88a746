"""Benchmark decontamination by pigeonhole edit matching.

Symbols are words (runs of letters, digits and underscores, in lower case). A test item of m words may differ from a
passage by a budget of k = floor(rate * m) inserted, deleted or replaced words. Cut into k + 1 pieces, one piece of any
passage within budget is untouched; so an automaton finds exact piece hits in the document, and Myers' bit-parallel
distance verifies the window around them against the whole item.

Test items go to the tasks in blocks of bounded bytes, as an automaton takes many times its text. Each block is one scan
of the documents, whose result is written before the next begins; the driver holds two blocks at most.

Defined cases: null and empty documents and items without a word match nothing; repeated documents and items each
give their own rows; of equally near places the first counts, and of its beginnings the last; very long texts are read
whole; an empty table on either side gives no rows; columns other than doc_id, text, item_id are ignored by
:func:`contamination` and kept by :func:`without_contaminated`, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import empty_like, inner, keep, picked, read, slices

#: Words that may differ, as a share of the item's words.
ERROR_RATE = 0.2
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, distance int, item_words int, start_word int, end_word int"

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces of n words, sizes one apart at most."""
    cuts = [i * n // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def best_match(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and the end of the first such part (Myers 1999)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def match_start(pattern: list, text: list, end: int) -> int:
    """Start of the part of ``text`` that ends at ``end`` and lies nearest to ``pattern``: the shortest one, from the end backwards."""
    m = len(pattern)
    row, best, start = list(range(m + 1)), m, end
    for n, w in enumerate(reversed(text[max(0, end - 2 * m) : end]), 1):
        new = [n]
        for i, p in enumerate(reversed(pattern)):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[m] < best:
            best, start = row[m], end - n
    return start


class Matcher:
    """Finds a block of test items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, w, int(rate * len(w))) for i, t in items if (w := words_of(t))]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for at, (_, w, k) in enumerate(self.items):
            for a, b in pieces(len(w), k):
                where.setdefault(f" {' '.join(w[a:b])} ", []).append((at, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """item_id, distance, number of item words, start and end word of the best match of each item within budget."""
        if not self.items or not text:
            return
        joined = f" {' '.join(words_of(text))} "
        windows: dict[int, list[tuple[int, int]]] = {}
        stops: list[int] = []
        words: list[str] = []
        for last, (length, places) in self.automaton.iter(joined):
            if not stops:
                words = joined.split()
                stops = list(accumulate(len(w) + 1 for w in words))
            q = bisect_right(stops, last - length + 1)
            for at, a, _ in places:
                _, w, k = self.items[at]
                windows.setdefault(at, []).append((max(0, q - a - k), q - a + len(w) + k))
        for at, spans in windows.items():
            item, w, k = self.items[at]
            best = None
            for lo, hi in merged(spans):
                d, end = best_match(w, words[lo:hi])
                if d <= k and (best is None or d < best[0]):
                    best = (d, lo, end, hi)
            if best:
                d, lo, end, hi = best
                yield item, d, len(w), lo + match_start(w, words[lo:hi], end), lo + end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of about ``block_bytes``."""
    block, size = [], 0
    for r in picked(items, "item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and test item of which it holds a passage within budget: doc_id, item_id, distance,
    item_words, start_word, end_word (of the best such passage, in words of the document)."""

    docs = picked(docs, "doc_id", "text")

    def scan(block):
        def run(batches):
            matcher = Matcher(block, rate)
            for batch in slices(batches):
                got = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in matcher.find(t)]
                columns = list(zip(*got, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(columns)], names=["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])

        return docs.mapInArrow(run, SCHEMA)

    found = [scan(b) if last else keep(scan(b), "contamination") for b, last in marked(blocks(items))]
    return reduce(DataFrame.union, found) if found else empty_like(docs.sparkSession, SCHEMA)


def marked(things: Iterator) -> Iterator[tuple[object, bool]]:
    """Each thing, and whether it is the last."""
    for now in things:
        for later in things:
            yield now, False
            now = later
        yield now, True


def without_contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents that hold a test item. Each row goes or stays by its own text, whatever its id."""

    own, (text,) = inner(docs, "text")

    def clean(block):
        def run(batches):
            matcher = Matcher(block, rate)
            for batch in slices(batches):
                yield batch.filter(pa.array([next(matcher.find(t), None) is None for t in batch.column(text).to_pylist()], pa.bool_()))

        return run

    out = own
    for block, last in marked(blocks(items)):
        out = out.mapInArrow(clean(block), own.schema)  # one block's automaton in a task
        out = out if last else keep(out, "decontaminated")
    return out.toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
