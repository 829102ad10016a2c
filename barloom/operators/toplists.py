"""Sorts and the first or last rows of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sort_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """By time, undated rows first."""
    return df.orderBy(F.col(ts).asc_nulls_first())


def _limited(df: DataFrame, by: Sequence[str], order, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def tail_rows(df: DataFrame, n: int, *, by: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """Last n rows of each series; each map task already drops all but its n candidates per series."""
    return _limited(df, by, F.col(order).desc(), n)


def head_rows(df: DataFrame, n: int, *, by: Sequence[str] = ("model",), order: str = "ts") -> DataFrame:
    return _limited(df, by, F.col(order).asc(), n)


def last_values(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """The newest row's values per series, by map-side aggregation."""
    return df.groupBy(*by).agg(*[F.max_by(c, order).alias(c) for c in cols], F.max(order).alias(order))


def rank_forecasts(final: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Models ordered by their final forecast."""
    return final.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy("yhat")))


def select_model(metrics: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """The model with the smallest error, better direction accuracy on a tie."""
    best = Window.partitionBy(*by).orderBy("mae", F.col("dir_acc").desc(), "model")
    return metrics.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1).drop("_rank")
