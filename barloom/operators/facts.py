"""Joins of many rows with a few facts about each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import written

BROADCAST_FACTS = 100_000  # rows; beyond, facts are copied to SALTS places and joined by shuffle
SALTS = 16
_SALT = "_salt"


def join_facts(rows: DataFrame, facts: DataFrame, by: Sequence[str], *, limit: int = BROADCAST_FACTS, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with a few facts per series; a series with a third of all rows is no single task's work.

    Facts are written and counted. Up to `limit` rows they are broadcast and the rows stay where they are. Beyond, each fact goes to
    `salts` places and the rows of a series are dealt to these by the hash of all their columns.
    """
    by = list(by)
    facts = written(facts, "facts")
    if facts.count() <= limit:
        return rows.join(F.broadcast(facts), by, how)
    copies = facts.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*by, _SALT], how).drop(_SALT)
