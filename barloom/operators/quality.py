"""Freshness, completeness and the gate before training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import GATE_MAX_MISSING_RATE, MIN_ROWS_PER_SYMBOL


def freshness(bars: DataFrame, *, as_of: Column, limit_seconds: int) -> DataFrame:
    """Is the newest bar at most `limit_seconds` older than `as_of`?"""
    return bars.agg(F.max("ts").alias("newest")).select(
        "newest",
        F.coalesce(F.timestamp_diff("SECOND", F.col("newest"), as_of) <= limit_seconds, F.lit(False)).alias("freshness_ok"),
    )


def rows_per_symbol(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("close").alias("n")).withColumn("enough", F.col("n") > MIN_ROWS_PER_SYMBOL)


def rows_ok(bars: DataFrame) -> DataFrame:
    """One row: do all symbols have enough rows? No symbol at all counts as yes."""
    return rows_per_symbol(bars).agg(F.coalesce(F.bool_and("enough"), F.lit(True)).alias("missing_rate_ok"))


def missing_rate(original: Column, after: Column) -> Column:
    """Share of rows lost in cleaning, 0 when nothing is left."""
    lost = F.try_divide(original - after, original)
    return F.when(after == 0, 0.0).otherwise(F.greatest(lost, F.lit(0.0)))


def etl_quality(timeline: DataFrame, *, in_range: Column, complete: Column, threshold: float) -> DataFrame:
    """One row of counts over timestamps flagged as inside the date range and complete enough."""
    kept = F.coalesce(in_range & complete, F.lit(False))
    return timeline.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(kept).alias("after_cleaning_rows"),
        F.count_if(~in_range).alias("rows_out_of_range"),
    ).withColumn("missing_rate", missing_rate(F.col("original_rows"), F.col("after_cleaning_rows"))).withColumn(
        "missing_threshold_percent", F.lit(threshold * 100)
    )


def gate(metrics: DataFrame, *, strict: bool = False) -> DataFrame:
    """Which way a run goes: an absent rate fails, and with `strict` an empty result fails as well."""
    passed = F.coalesce(F.col("missing_rate"), F.lit(1.0)) <= GATE_MAX_MISSING_RATE
    if strict:
        passed = passed & (F.col("after_cleaning_rows") > 0)
    return metrics.withColumn("branch", F.when(passed, "ok_path").otherwise("fail_path"))
