"""The queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from barloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "toxicity", "pieces", "archives", "neardup", "licences", "decontaminate", "linededup", "chat", "quality", "language", "simhash",
    "prefix_trie", "whitening",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its reference."""

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(prepared(spark), folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def prepared(spark: SparkSession) -> SparkSession:
    """Arrow batches of a few hundred whole texts, so that a Python worker holds a few MB at a time."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def load() -> None:
    """Import every operator, which registers its query."""
    for name in MODULES:
        import_module(f"barloom.llm.{name}")
