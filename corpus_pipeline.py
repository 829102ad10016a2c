"""A corpus made ready for training: language, repeated lines, copies, benchmark leaks, pieces.

Each stage reads what its predecessor kept and calls one operator of `barloom.llm`. All stages but the last return the columns
of `documents`. Rows survive with all their columns; null and empty texts are rejected by the first stage, as they have no
language. An empty table passes through every stage.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.llm import decontaminate, language, linededup, neardup, pieces  # noqa: E402
from barloom.llm.registry import prepared, table  # noqa: E402
from barloom.llm.scratch import kept  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; profiles are learned from the given documents."""
    return language.accepted(prepared_docs(spark, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document holds too, where at least three documents hold them."""
    return linededup.deduped(prepared_docs(spark, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.without_copies(prepared_docs(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(prepared_docs(spark, docs), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, counts and digests of every text, and whether decoding gives it back."""
    return pieces.digests(prepared_docs(spark, docs), with_ids=True)


def prepared_docs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepared(spark)
    return docs


STAGES = [
    ("language ID", language_id), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination),
    ("SentencePiece", encoding),
]

#: Language profiles cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(prepared(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, "stage")
    return docs
