"""Dropping and flagging unusable rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import PRICE_CEILING, Cells, Share
from barloom.functions.scalar import finite, missing_cells

PRICES = ["open", "high", "low", "close"]


def until(df: DataFrame, end: Column, ts: str = "ts") -> DataFrame:
    """Rows up to and including an end time; reaches the scan of stored bars. Bars built from ticks take `until` themselves."""
    return df.filter(F.col(ts) <= end)


def inf_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in cols})


def filter_missing(panel: DataFrame, cols: list[str], limit: Cells | Share) -> DataFrame:
    """Drop panel rows with more missing cells than the limit."""
    return panel.filter(missing_cells(cols) <= limit.of(len(cols)))


def timeline_missing(bars: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing cells per timestamp of a long table, counted without building the (time x symbol) grid."""
    symbols = bars.agg(F.count_distinct("symbol").alias("n"))
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("long") for c in features])
    return (
        bars.groupBy("ts")
        .agg(F.sum(present).alias("present"))
        .withColumn("cells", symbols.scalar() * len(features))
        .select("ts", "cells", (F.col("cells") - F.col("present")).alias("missing"))
    )


def filter_missing_long(bars: DataFrame, features: Sequence[str], limit: Cells | Share) -> DataFrame:
    """Long-table version of `filter_missing`."""
    gaps = timeline_missing(bars, features)
    few = F.col("missing") / F.col("cells") <= limit.share if isinstance(limit, Share) else F.col("missing") <= limit.number
    return bars.join(gaps.filter(few).select("ts"), "ts", "left_semi")


def filter_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """Filter, but keep everything where the filter would leave nothing."""
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    any_kept = flagged.agg(F.coalesce(F.bool_or("_keep"), F.lit(False)))
    return flagged.filter(F.col("_keep") | ~any_kept.scalar()).drop("_keep")


def reject_reason(cols: Sequence[str] = PRICES, prices: Sequence[str] = PRICES) -> Column:
    """Why a row is unusable (the first test that hits), NULL for a good row."""

    def all_of(test) -> Column:
        return reduce(lambda a, b: a & b, [test(F.col(c)) for c in cols])

    def any_of(test, names) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(test(F.col(c)), F.lit(False)) for c in names])

    return (
        F.when(all_of(lambda x: x.isNull() | F.isnan(x)), "all_missing")
        .when(any_of(lambda x: F.abs(x) == float("inf"), cols), "infinite")
        .when(all_of(lambda x: F.coalesce(x == 0, F.lit(False))), "all_zero")
        .when(any_of(lambda x: ((x <= 0) | (x > PRICE_CEILING)) & ~F.isnan(x), prices), "abnormal")
    )


def clean_prices(df: DataFrame) -> DataFrame:
    return df.filter(reject_reason().isNull())


def clean_report(df: DataFrame) -> DataFrame:
    """One row: rows before, after and dropped by reason; missing, infinite and zero cells that remain."""
    reason = F.col("_reason")
    good = reason.isNull()

    def cells(test) -> Column:
        return F.sum(F.when(good, reduce(lambda a, b: a + b, [test(F.col(c)).cast("long") for c in PRICES])).otherwise(0))

    return df.withColumn("_reason", reject_reason()).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(good).alias("rows_after"),
        *[F.count_if(reason == r).alias(r) for r in ("all_missing", "infinite", "all_zero", "abnormal")],
        cells(lambda x: x.isNull() | F.isnan(x)).alias("missing_cells"),
        cells(lambda x: F.coalesce(F.abs(x) == float("inf"), F.lit(False))).alias("infinite_cells"),
        cells(lambda x: F.coalesce(x == 0, F.lit(False))).alias("zero_cells"),
    )
