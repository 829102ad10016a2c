"""Future values of regressors: the expected path of each family of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Horizon
from barloom.functions.scalar import with_calendar
from barloom.operators.blocks import over_blocks

# Name parts that decide how a feature moves on, tested in this order.
FAMILIES = [
    ("price", ["_close", "_open", "_high", "_low"]),
    ("average", ["sma", "ema", "bb_middle"]),
    ("rsi", ["rsi"]),
    ("oscillator", ["macd", "volume_ratio", "roc"]),
    ("recent", ["volatility", "returns"]),
]


def family(feature: str) -> str:
    """The first family one of whose parts the name contains, else `last`."""
    return next((name for name, parts in FAMILIES if any(p in feature for p in parts)), "last")


def melt(table: DataFrame, features: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by, ts, feature, family, value) without missing values."""
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(family(f)).alias("family"), F.col(f"`{f}`").alias("value")) for f in features]
    )
    return table.select(*by, "ts", F.inline(cells)).filter(F.col("value").isNotNull())


def path_value(h: Horizon) -> Column:
    """Value at `step` from the facts of a feature's history."""
    k, last = F.col("step"), F.col("last")
    walk = last * F.pow(1 + F.coalesce("drift", F.lit(0.0)), k - 1)
    low, high = h.rsi_band
    rsi_first = F.greatest(F.lit(low), F.least(F.lit(high), last + h.reversion * (50 - last)))
    rsi = 50 + (rsi_first - 50) * F.pow(F.lit(1 - h.reversion), k - 1)
    goal = F.when(F.contains("feature", F.lit("volume_ratio")), 1.0).otherwise(0.0)
    reverting = goal + (last - goal) * F.pow(F.lit(1 - h.reversion), k)
    return (
        F.when(F.col("n") <= h.min_history, last)
        .when(F.col("family").isin("price", "average"), walk)
        .when(F.col("family") == "rsi", rsi)
        .when(F.col("family") == "oscillator", reverting)
        .when(F.col("family") == "recent", F.col("recent"))
        .otherwise(last)
    )


def future_regressors(
    table: DataFrame, features: Sequence[str], horizon: Horizon, *, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """(by, feature, step, ts, value) for the horizon's steps.

    Drift is the mean one-row return, `recent` the mean of the newest rows; a return from 0 is left out.
    """
    keys = [*by, "feature", "family"]
    long = melt(table, features, by)

    def moves(d: DataFrame, w) -> DataFrame:
        newest = w.rowsBetween(-(horizon.recent_rows - 1), 0)
        back = F.try_divide(F.col("value"), F.lag("value").over(w)) - 1
        return d.withColumn("_ret", back).withColumn("_recent", F.avg("value").over(newest))

    facts = (
        over_blocks(long, moves, by=keys, step_seconds=horizon.step_seconds, halo=horizon.recent_rows)
        .groupBy(*keys)
        .agg(
            F.max_by("value", "ts").alias("last"), F.count(F.lit(1)).alias("n"), F.avg("_ret").alias("drift"),
            F.max_by("_recent", "ts").alias("recent"),
        )
    )
    ends = table.groupBy(*by).agg(F.max("ts").alias("_end"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon.steps))).alias("step")
    placed = facts.join(ends, list(by)) if by else facts.withColumn("_end", ends.scalar())
    grown = placed.select(*keys, "last", "n", "drift", "recent", "_end", steps)
    return grown.select(
        *by, "feature", "family", "step",
        F.timestamp_add("SECOND", F.col("step") * horizon.step_seconds, F.col("_end")).alias("ts"),
        path_value(horizon).alias("value"),
    )


def future_frame(future: DataFrame, features: Sequence[str], *, by: Sequence[str] = ("symbol",), hours: bool = True) -> DataFrame:
    """One row per step with the features as columns and the calendar of the step's time."""
    cells = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    return with_calendar(future.groupBy(*by, "step", "ts").agg(*cells), hours=hours)
