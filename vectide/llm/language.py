"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Letters (lower case) have codes of 12 bits, everything between them is one break, and five codes make a key of 60 bits:
its low bits are the shorter n-grams, its high bits the context. Five-grams of all labelled documents are counted by Spark;
lower orders count the distinct characters before an n-gram. A model is, for each order, a sorted array of keys with the
discounted share of each n-gram and one of contexts with the weight that goes to the order below. A text has the language
whose model needs the fewest bits a symbol. How far the second best is behind, in bits, gives the score: the share of
labelled documents of that distance that were right, made monotone; below REJECT the prediction is rejected.

The model goes to the tasks whole if it has MODEL_ROWS keys at most, else in parts by the two codes before the last,
one pass over the texts for each; bits add up, so results are the same.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if no row has a label; a
null doc_id hashes as the empty text; null labels teach nothing; repeated rows count and are predicted alike; very long
texts are read whole; ties go to the language that sorts first; an empty table gives no rows; other columns are ignored,
whatever their names. Code points that are 4,094 apart share a code. The score is calibrated on documents that the models
have seen, which flatters it where there are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import keep, picked, read, slices

FOLDS, HELD_OUT = 4, 2
ORDER, BITS = 5, 12
BREAK, START = 0, 1
CODES = 1 << BITS
UNKNOWN = "und"
REJECT = 0.5
#: Keys that one pass sends to the tasks (12 bytes each), besides those of orders 1 and 2, which all passes have.
MODEL_ROWS = 4_000_000
#: Characters that are looked at at a time.
PIECE = 500_000
#: Distinct keys that a task holds before it passes its counts on, and whose bits it remembers.
HELD = 1_000_000
#: Margins of one score: so many steps for each doubling of the bits between the best language and the next.
STEPS = 4

_START = "\ud800" * (ORDER - 1)  # no text holds lone surrogates


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class Coder:
    """Five-gram keys of texts, in pieces of PIECE characters or little more."""

    def __init__(self):
        self.codes = np.full(0x110000, 0xFFFF, dtype=np.uint16)
        self.codes[0xD800] = START

    def _coded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = self.codes[points]
        if (code == 0xFFFF).any():
            for c in np.unique(points[code == 0xFFFF]).tolist():
                self.codes[c] = 2 + c % (CODES - 2) if chr(c).isalpha() else BREAK
            code = self.codes[points]
        return code

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys, and the text that each belongs to."""
        held, first, size = [], 0, 0
        for i, t in enumerate(texts):
            held.append((t or "").lower())
            size += len(held[-1])
            if size >= PIECE or i + 1 == len(texts):
                yield from self._keys(held, first)
                held, first, size = [], i + 1, 0

    def _keys(self, texts: list[str], first: int):
        of_all = np.repeat(np.arange(first, first + len(texts)), [len(t) + ORDER - 1 for t in texts])
        joined, before = "".join(f"{_START}{t}" for t in texts), np.full(1, START, dtype=np.uint16)
        for a in range(0, len(joined), 2 * PIECE):
            code, of = self._coded(joined[a : a + 2 * PIECE]), of_all[a : a + 2 * PIECE]
            use = (code != BREAK) | (np.concatenate([before[-1:], code[:-1]]) > START)  # one break after a letter
            code = np.concatenate([before, code[use]])
            n, before = len(code) - ORDER + 1, code[-ORDER + 1 :]
            if n <= 0:
                continue
            wide = code.astype(np.int64)
            key = reduce(lambda k, j: (k << BITS) | wide[j : j + n], range(1, ORDER), wide[:n])  # noqa: B023
            own = code[ORDER - 1 :] != START
            yield key[own], of[use][-n:][own]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, found = pd.factorize(np.concatenate(keys))
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """lang, key and n: the five-grams of all ``docs`` (text, lang) that have a lang."""

    def run(batches):
        coder, sums = Coder(), {}

        def out():
            for lang, (keys, counts) in sums.items():
                for a in range(0, len(keys), 100_000):
                    k = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(counts[a : a + 100_000], pa.int64())], names=["lang", "key", "n"])
            sums.clear()

        for batch in slices(batches):
            text, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                for key, _ in coder([t for t, x in zip(text, langs, strict=True) if x == lang]):
                    old = sums.get(lang, (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
                    sums[lang] = _summed([old[0], key], [old[1], np.ones(len(key), dtype=np.int64)])
            if sum(len(k) for k, _ in sums.values()) > HELD:
                yield from out()
        yield from out()

    rows = docs.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, key long, n long")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


MODEL = "lang string, size int, context boolean, key long, value double"


def model_rows(counts: DataFrame) -> DataFrame:
    """MODEL rows from five-gram counts: of each order (size) the n-grams with their discounted shares and the contexts with
    the weight of the order below."""
    parts, now = [], counts.select("lang", "key", F.col("n").alias("c"))
    for size in range(ORDER, 0, -1):
        # n1 / (n1 + 2 n2), as is usual
        once, twice = F.sum((F.col("c") == 1).cast("double")), F.sum((F.col("c") == 2).cast("double"))
        discount = now.groupBy("lang").agg(F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5)).alias("d")).withColumn("d", F.greatest(F.lit(0.05), F.least(F.lit(0.95), "d")))
        rows = now.withColumn("of", F.shiftrightunsigned("key", BITS))
        contexts = rows.groupBy("lang", "of").agg(F.sum("c").alias("total"), F.count("*").alias("types")).join(discount, "lang")
        contexts = keep(contexts, f"language-contexts-{size}")
        share = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        parts.append(rows.join(contexts, ["lang", "of"]).select("lang", F.lit(size).alias("size"), F.lit(False).alias("context"), "key", share.alias("value")))
        parts.append(contexts.select("lang", F.lit(size), F.lit(True), F.col("of").alias("key"), (F.col("d") * F.col("types") / F.col("total")).alias("value")))
        if size > 1:
            low = F.col("key").bitwiseAND((1 << BITS * (size - 1)) - 1)
            now = keep(now.groupBy("lang", low.alias("key")).agg(F.count("*").alias("c")), f"language-grams-{size - 1}")
    return reduce(DataFrame.union, parts)


def part_of(pair, parts: int):
    """The part that the two codes before the last belong to, in NumPy and in Spark."""
    return pair * 2_654_435_761 % 4_294_967_296 % parts


@dataclass(frozen=True)
class Model:
    """Sorted keys with their values: ``tables[lang][size]`` = (n-grams, shares, contexts, weights)."""

    langs: list[str]
    tables: list[list[tuple[np.ndarray, ...]]]

    @staticmethod
    def of(langs: list[str], rows: pa.Table) -> Model:
        tables = []
        lang = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
        names = lang.dictionary.to_pylist() if lang is not None else []
        code = lang.indices.to_numpy() if lang is not None else np.empty(0, dtype=int)
        size, context, key, value = (rows[c].to_numpy() for c in ("size", "context", "key", "value"))
        for x in langs:
            mine = code == (names.index(x) if x in names else -1)
            orders = []
            for s in range(1, ORDER + 1):
                pair = []
                for kind in (False, True):
                    at = np.flatnonzero(mine & (size == s) & (context == kind))
                    at = at[np.argsort(key[at])]
                    pair += [key[at], value[at].astype(np.float32)]
                orders.append(tuple(pair))
            tables.append(orders)
        return Model(langs, tables)

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, want: np.ndarray, other: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(want), other)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at].astype(float), other)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Of each five-gram in each language."""
        out = np.empty((len(keys), len(self.langs)))
        for j, orders in enumerate(self.tables):
            p = np.full(len(keys), 1 / CODES)
            for size, (grams, shares, contexts, weights) in enumerate(orders, 1):
                low = keys & ((1 << BITS * size) - 1)
                p = self._found(grams, shares, low, 0.0) + self._found(contexts, weights, low >> BITS, 1.0) * p
            out[:, j] = -np.log2(p)
        return out


class Memory:
    """Bits of the keys met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.keys, self.rows = np.empty(0, dtype=np.int64), np.empty((0, len(self.model.langs)))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at, found = pd.factorize(keys)
        where = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        new = np.sort(found[self.keys[where] != found]) if len(self.keys) else np.sort(found)
        if len(new):
            if len(self.keys) + len(new) > HELD:
                self.clear()
                new = np.sort(found)
            put = np.searchsorted(self.keys, new)
            self.rows = np.insert(self.rows, put, self.model.bits(new), axis=0)
            self.keys = np.insert(self.keys, put, new)
        return self.rows[np.searchsorted(self.keys, found)][at]


def with_bits(docs: DataFrame, langs: list[str], model: Model, part: int, parts: int, more: bool) -> DataFrame:
    """``docs`` (doc_id, lang, text) with the bits of each language (added to those it has, if it has them), the number of
    symbols, and whether there is a letter. Without ``more`` to come the text goes."""
    sent = docs.sparkSession.sparkContext.broadcast(model.tables)  # arrays: workers need no copy of this package
    first = "bits" not in docs.columns
    names = ["doc_id", "lang", *(["text"] if more else []), "bits", "n", "letter"]

    def run(batches):
        coder, memory, n_langs = Coder(), Memory(Model(langs, sent.value)), len(langs)
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            n, letters, bits = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), n_langs))
            for keys, of in coder(texts):
                n += np.bincount(of, minlength=len(texts))
                letters += np.bincount(of[keys & (CODES - 1) > START], minlength=len(texts))
                if parts > 1:
                    mine = part_of(keys >> BITS & (CODES * CODES - 1), parts) == part
                    keys, of = keys[mine], of[mine]
                rows = memory(keys)
                for j in range(n_langs):
                    bits[:, j] += np.bincount(of, weights=rows[:, j], minlength=len(texts))
            if not first:
                bits = bits + np.array(batch.column(3).to_pylist()).reshape(bits.shape)
            cols = [pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(letters > 0, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 3 if more else 2], *cols], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, lang string, {'text string, ' if more else ''}bits array<double>, n long, letter boolean")


def monotone(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares (right + 1) / (n + 2), neighbours that fall joined until none does."""
    blocks: list[list[float]] = []
    for r, k in zip(right + 1.0, n + 2.0, strict=True):
        blocks.append([r, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(m), r / k) for r, k, m in blocks]) if blocks else np.empty(0)


def languages(docs: DataFrame, model_keys: int = MODEL_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and bits_per_symbol of each document, learned from the labelled documents
    that are not held out."""
    docs = picked(docs, "doc_id", "lang", "text").withColumn("lang", F.when(~held_out(F.col("doc_id")), F.col("lang").cast("string")))
    counts = keep(counted(docs), "language-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("bits_per_symbol"))
    model = keep(model_rows(counts), "language-model")
    parts = max(1, -(-model.filter("size > 2").count() // model_keys))
    rows = docs
    for part in range(parts):
        pair = F.when(F.col("context"), F.col("key")).otherwise(F.shiftrightunsigned("key", BITS)).bitwiseAND(CODES * CODES - 1)
        own = model if parts == 1 else model.filter((F.col("size") <= 2) | (part_of(pair, parts) == part))
        rows = with_bits(rows, langs, Model.of(langs, own.toArrow()), part, parts, part + 1 < parts)
        rows = keep(rows, "language-bits")
    order = F.array_sort(F.transform("bits", lambda b, i: F.struct(b.alias("bits"), i.alias("at"))))
    rows = rows.withColumn("order", order).withColumn("best", F.element_at(F.array(*map(F.lit, langs)), F.col("order")[0]["at"] + 1))
    gap = F.when(F.size("order") > 1, F.get("order", 1)["bits"] - F.col("order")[0]["bits"]).otherwise(0.0)
    rows = rows.withColumn("step", F.floor(STEPS * F.log2(1 + gap)).cast("int"))
    seen = rows.filter("lang IS NOT NULL AND letter").groupBy("step").agg(F.sum((F.col("lang") == F.col("best")).cast("long")).alias("right"), F.count("*").alias("n"))
    # a few steps for each doubling: some hundreds at most
    known = {r["step"]: (r["right"], r["n"]) for r in seen.collect()}
    at = sorted(known)
    share = monotone(np.array([known[s][0] for s in at], dtype=float), np.array([known[s][1] for s in at], dtype=float))
    score = F.coalesce(*[F.when(F.col("step") >= s, float(v)) for s, v in sorted(zip(at, share, strict=True), reverse=True)], F.lit(float(share[0]) if len(share) else REJECT))
    score = F.when(F.col("letter"), score).otherwise(0.0)
    pred = F.when(F.col("letter"), F.col("best")).otherwise(UNKNOWN)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), pred.alias("lang_pred"), score.alias("score"), (score < REJECT).alias("rejected"), F.when(F.col("n") > 0, F.col("order")[0]["bits"] / F.col("n")).alias("bits_per_symbol"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


QUERIES = {"op12_language": op12_language}
