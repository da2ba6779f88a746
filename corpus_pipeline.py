"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's documents.
All stages but the last return the columns of ``documents``, whatever these are called.

Defined cases, for every stage: rows are told apart by themselves and not by doc_id, so null and repeated ids lose no
row and save none; an empty table gives an empty result; null and empty texts count as texts without words; very long
texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm.common import keep, read
from vectide.llm.decontaminate import without_contaminated
from vectide.llm.mixing import mixed_documents
from vectide.llm.records import tokenized
from vectide.llm.simhash import one_of_each
from vectide.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, a score of 0.5 among them. Repeated rows share their fate; null and empty texts have the
    bias as their score; without labels all stay."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the smallest doc_id (null comes first), then
    the smallest fingerprint, then the text with the smallest hash. All texts without words are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its error budget go; null and empty texts and items match nothing."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: one row for each pass that takes words of a document, with these words. Documents without words
    go, as there is nothing to take; a null source is a source; repeated rows are documents of their own."""
    return mixed_documents(docs)


def binary_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Record files of token ids; the result is their index, read back from them: a row for each document, in the order of
    doc_id (null as the least long) and of a hash of the text."""
    return tokenized(docs).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_id_binary_output", binary_output),
]

#: No SQL: the stages train a model, draw pseudorandom permutations and run a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{name}")
    return docs
