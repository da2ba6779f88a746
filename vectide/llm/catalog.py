"""Queries of this subpackage. Each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

#: Modules that hold an op query, in the order of their numbers.
MODULES = ("sharding", "decontaminate", "neighbours", "secrets", "mixing", "simhash", "phrases", "passages", "toxicity", "records", "conversations", "language", "resample")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"vectide.llm.{name}").QUERIES
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(import_module(f"vectide.llm.{name}"), "ORACLE_SQL", {})
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
