"""Writers. Each one replaces its target and never writes onto the path a frame is read from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import iso_z


def sink_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def sink_csv(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).option("header", True).csv(path)
    return path


def sink_forecasts(forecast: DataFrame, path: str) -> str:
    """One folder per model; a model without any value is left out."""
    alive = forecast.filter(F.col("yhat").isNotNull()).select("model").distinct()
    return sink_csv(forecast.join(alive, "model", "left_semi"), path, partition_by=["model"])


def sink_by_symbol(bars: DataFrame, path: str) -> str:
    """One folder per symbol with canonical column names."""
    named = bars.select("symbol", F.col("ts").alias("Date"), *[F.col(c.lower()).alias(c) for c in ("Open", "High", "Low", "Close")])
    return sink_csv(named, path, partition_by=["symbol"])


def sink_json(df: DataFrame, path: str) -> str:
    """A one-row metrics table as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def history_documents(feed: DataFrame) -> DataFrame:
    """`{"data": [...]}` per symbol, times as ISO text. For feeds of a bounded span only: a document is one cell."""
    row = F.struct(iso_z(F.col("ts")).alias("time"), "open", "high", "low", "close")
    rows = F.array_sort(F.collect_list(row))
    return feed.groupBy("symbol").agg(F.to_json(F.struct(rows.alias("data"))).alias("document"))


def sink_history(documents: DataFrame, path: str) -> str:
    documents.select("symbol", F.col("document").alias("value")).write.mode("overwrite").partitionBy("symbol").text(path)
    return path
