"""Chronological splits and walk-forward folds by position on the common timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.blocks import POS, number_rows


def timeline(df: DataFrame, *, step_seconds: int) -> DataFrame:
    """Distinct times with their positions; the table is bounded by the calendar, not by the number of series."""
    return number_rows(df.select("ts").distinct(), step_seconds=step_seconds)


def chrono_split(df: DataFrame, *, share: float = 0.8, step_seconds: int) -> DataFrame:
    """Flag the first `share` of all times as training rows."""
    line = timeline(df, step_seconds=step_seconds)
    size = line.agg(F.max(POS))
    flags = line.select("ts", (F.col(POS) <= F.floor(size.scalar() * F.lit(share))).alias("is_train"))
    return df.join(flags, "ts")


def test_folds(pos: Column, min_train: int, test: int, step: int) -> Column:
    """The folds that test a position, as an array."""
    last = F.floor((pos - 1 - min_train) / step).cast("int")
    first = F.greatest(F.lit(0), F.ceil((pos - min_train - test) / step).cast("int"))
    return F.when((pos > min_train) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def with_test_folds(numbered: DataFrame, *, min_train: int, test: int, step: int) -> DataFrame:
    """One row per test row and fold, with `k` = its number in the fold's test window."""
    rows = numbered.withColumn("fold", F.explode(test_folds(F.col(POS), min_train, test, step)))
    return rows.withColumn("k", F.col(POS) - min_train - F.col("fold") * step)


def fold_bounds(line: DataFrame, *, min_train: int, test: int, step: int) -> DataFrame:
    """Times and sizes of each fold. Training windows grow, so they are described and never copied."""
    tests = with_test_folds(line, min_train=min_train, test=test, step=step).groupBy("fold").agg(
        F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.count(F.lit(1)).alias("test_rows")
    )
    ends = line.filter((F.col(POS) >= min_train) & ((F.col(POS) - min_train) % step == 0)).select(
        ((F.col(POS) - min_train) / step).cast("int").alias("fold"), F.col("ts").alias("train_end"),
        F.col(POS).cast("long").alias("train_rows"),
    )
    start = line.agg(F.min("ts"))
    return tests.join(ends, "fold").withColumn("train_start", start.scalar()).select(
        "fold", "train_start", "train_end", "train_rows", "test_start", "test_end", "test_rows"
    )
