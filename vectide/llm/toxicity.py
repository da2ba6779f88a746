"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence's probability is a logistic function of the distinct words in it and of their beginnings; a document's is that at least one of its
sentences is toxic. Only document labels train it: a negative document presses on all its sentences, a positive one on
those that already look worst. Training sees at most MOST_POSITIVE and MOST_NEGATIVE labelled documents (those with the
smallest hashes of their ids); everything is scored.

Defined cases: a null or empty text has one empty sentence, whose score is the bias; a null doc_id hashes as the empty
text; repeated labels of one document count as their largest; without labels nothing is predicted toxic; a score of
exactly 0.5 is toxic; repeated rows are scored alike; very long texts are scored whole; an empty table gives no rows;
other columns are ignored by :func:`toxicity` and kept by :func:`without_toxic`, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import inner, keep, picked, read, slices

FOLDS = 5
MOST_POSITIVE = 2_000
MOST_NEGATIVE = 4_000
#: Lengths of word beginnings that are features beside the words, so that endings matter less.
BEGINNINGS = range(3, 9)
#: A word has a weight if the likelihood ratio statistic of its documents' labels is so large, and points to toxic.
LEAST_G2 = 20.0
ROUNDS = 200
L2 = 1e-5
THRESHOLD = 0.5
MEMORY = 100_000

_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves no remainder by FOLDS."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS) == 0


def sentences(text: str | None) -> list[str]:
    return [s for s in _END.split((text or "").lower()) if s.strip()] or [""]


def features_of(word: str) -> list[int]:
    raw = [f"{word} ", *[word[:n] for n in BEGINNINGS if n <= len(word)]]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in raw]


@dataclass(frozen=True)
class Model:
    bias: float
    features: np.ndarray  # sorted crc32 of words
    weights: np.ndarray

    def memo(self) -> dict[str, float]:
        known = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))

        class Memo(dict):
            def __missing__(self, word):
                if len(self) > MEMORY:
                    self.clear()
                w = self[word] = sum(known.get(f, 0.0) for f in features_of(word))
                return w

        return Memo()


def telling_features(labelled: DataFrame) -> np.ndarray:
    """Features whose documents are toxic more often than others, and by more than chance (LEAST_G2)."""

    def count(batches):
        seen: dict[int, list[int]] = {}
        n = [0, 0]
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y] += 1
                for f in {f for w in set(_WORD.findall((t or "").lower())) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
        rows = [(-1, *n), *((f, *c) for f, c in seen.items())]
        for a in range(0, len(rows), 100_000):
            f, neg, pos = zip(*rows[a : a + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (f, neg, pos)], names=["feature", "neg", "pos"])

    sums = labelled.select("toxic", "text").mapInArrow(count, "feature long, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sums = keep(sums, "toxicity-features")
    of = sums.filter("feature = -1").first()
    if of is None or not of["neg"] or not of["pos"]:
        return np.empty(0, dtype=np.int64)
    base = of["pos"] / (of["pos"] + of["neg"])
    n, rate = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    g2 = 2 * (F.col("pos") * F.log(rate / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    # every such feature needs several documents of the sample, so their number is bounded with it
    got = sums.filter((F.col("feature") >= 0) & (n > 1) & (F.col("pos") > 0) & (rate > base) & (g2 > LEAST_G2)).select("feature").toPandas()
    return np.sort(got["feature"].to_numpy(dtype=np.int64))


def _examples(labelled: DataFrame, use: np.ndarray) -> DataFrame:
    """Per document: toxic, features (of ``use``) of all sentences one after another, and their number by sentence."""

    def run(batches):
        known = set(use.tolist())
        for batch in batches:
            feats, counts = [], []
            for t in batch.column(1).to_pylist():
                sets = [{f for w in set(_WORD.findall(s)) for f in features_of(w)} & known for s in sentences(t)]
                feats.append([f for s in sets for f in sorted(s)])
                counts.append([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feats, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["toxic", "features", "counts"])

    return labelled.select("toxic", "text").mapInArrow(run, "toxic int, features array<long>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the labelled documents that are not held out."""
    docs = picked(docs, "doc_id", "text")
    known = picked(labels, "doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(MOST_POSITIVE).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(MOST_NEGATIVE))
    chosen = keep(chosen, "toxicity-chosen")
    sample = keep(docs.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # broadcast: 6,000 rows at most
    use = telling_features(sample)
    rows = _examples(sample, use).toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    feats = rows["features"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    counts = rows["counts"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    return train(y, feats.flatten().to_numpy(), np.diff(counts.offsets.to_numpy()), counts.flatten().to_numpy(), use)


def loss_and_gradient(theta: np.ndarray, y: np.ndarray, ids: np.ndarray, sent_of: np.ndarray, bag_of: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood of noisy-or, with the penalty, and its gradient. ``theta``: weights, then the bias;
    ``ids`` and ``sent_of``: feature and sentence of each occurrence; ``bag_of``: the document of each sentence."""
    k = len(theta) - 1
    z = theta[-1] + np.bincount(sent_of, weights=theta[ids], minlength=len(bag_of))
    s = np.bincount(bag_of, weights=np.logaddexp(0, z), minlength=len(y))  # minus the log probability that no sentence is toxic
    loss = np.where(y > 0, -np.log(np.maximum(-np.expm1(-s), 1e-300)), s).mean() + L2 / 2 * (theta[:-1] ** 2).sum()
    pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-9), 1.0) / len(y)
    g = pull[bag_of] / (1 + np.exp(-z))
    return float(loss), np.r_[np.bincount(ids, weights=g[sent_of], minlength=k) + L2 * theta[:-1], g.sum()]


def train(y: np.ndarray, feats: np.ndarray, bags: np.ndarray, counts: np.ndarray, names: np.ndarray) -> Model:
    """``feats``: features of all sentences, out of the sorted ``names``; ``counts``: features by sentence; ``bags``:
    sentences by document."""
    if not len(y) or y.max() == y.min():
        return Model(-8.0, np.empty(0, dtype=np.int64), np.empty(0))
    bag_of = np.repeat(np.arange(len(y)), bags)
    sent_of = np.repeat(np.arange(len(counts)), counts)
    ids = np.searchsorted(names, feats)
    theta = np.r_[np.zeros(len(names)), -6.0]
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, ROUNDS + 1):
        _, grad = loss_and_gradient(theta, y, ids, sent_of, bag_of)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(float(theta[-1]), names, theta[:-1])


def _sentence_scores(text: str | None, memo: dict[str, float], bias: float) -> list[float]:
    return [bias + sum(map(memo.__getitem__, set(_WORD.findall(s)))) for s in sentences(text)]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the number of offending sentences of each document."""

    docs = picked(docs, "doc_id", "text")

    def run(batches):
        memo = model.memo()
        for batch in slices(batches):
            score, bad = [], []
            for t in batch.column(1).to_pylist():
                z = np.array(_sentence_scores(t, memo, model.bias))
                score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                bad.append(int((z >= 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(bad, pa.int32())], names=["doc_id", "score", "n_offending"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_offending int")


def offending_sentences(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, position, sentence and score of each sentence that is more likely toxic than not."""

    def run(batches):
        memo = model.memo()
        for batch in slices(batches):
            got = [(d, i, s, 1 / (1 + float(np.exp(-z)))) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (s, z) in enumerate(zip(sentences(t), _sentence_scores(t, memo, model.bias), strict=True)) if z >= 0]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in got], pa.int64()), "position": pa.array([x[1] for x in got], pa.int32()), "sentence": pa.array([x[2] for x in got], pa.string()), "score": pa.array([x[3] for x in got], pa.float64())})

    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, position int, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_offending of each document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic. Each row goes or stays by its own text, whatever its id."""
    model = fit(docs, labels)
    own, (text,) = inner(docs, "text")

    def run(batches):
        memo = model.memo()
        for batch in slices(batches):
            z = (np.array(_sentence_scores(t, memo, model.bias)) for t in batch.column(text).to_pylist())
            yield batch.filter(pa.array([bool(-np.expm1(-np.logaddexp(0, x).sum()) < THRESHOLD) for x in z], pa.bool_()))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
