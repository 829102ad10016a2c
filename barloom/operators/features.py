"""Feature scores, selection, scaling and sequences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import over_blocks
from barloom.operators.facts import join_facts
from barloom.operators.metrics import correlation


def feature_scores(panel: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Univariate F score of each feature against the row mean of the targets, all in one aggregation.

    The result has one row per feature (`pos` is the column position); a constant feature scores NULL.
    """
    mean = reduce(lambda a, b: a + b, [F.col(f"`{t}`") for t in targets]) / len(targets)
    base = panel.withColumn("_mean", mean)
    stats = [correlation(F.col(f"`{f}`"), F.col("_mean")).alias(f"r{i}") for i, f in enumerate(features)]
    row = base.agg(F.count(F.lit(1)).alias("n"), *stats)
    items = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f"r{i}").alias("r")) for i, f in enumerate(features)]
    scored = row.select("n", F.explode(F.array(*items)).alias("s")).select("s.pos", "s.feature", "s.r", "n")
    r = F.when(~F.isnan("r"), F.col("r"))
    return scored.select(
        "pos", "feature", (F.try_divide(r * r, 1 - r * r) * (F.col("n") - 2)).alias("score")
    )


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The k best features in column order; of equal scores the later column wins, no score ranks last."""
    best = Window.orderBy(F.col("score").desc_nulls_last(), F.col("pos").desc())
    return scores.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank").orderBy("pos")


def fit_minmax(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value of each column, one row per group."""
    return df.groupBy(*by).agg(
        *[f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))]
    )


def _scaled(c: str) -> Column:
    low, high = F.col(f"`min_{c}`"), F.col(f"`max_{c}`")
    span = F.when(high == low, 1.0).otherwise(high - low)
    return (F.col(f"`{c}`") - low) / span


def _unscaled(c: str) -> Column:
    low, high = F.col(f"`min_{c}`"), F.col(f"`max_{c}`")
    span = F.when(high == low, 1.0).otherwise(high - low)
    return F.col(f"`{c}`") * span + low


def apply_minmax(
    df: DataFrame, scaler: DataFrame, cols: Sequence[str], by: Sequence[str], *, inverse: bool = False
) -> DataFrame:
    """Scale to [0, 1] by a fitted table, or back; a constant column maps to 0."""
    if by:
        joined = join_facts(df, scaler, by)
    else:
        joined = df.withColumns({c: scaler.select(F.col(f"`{c}`")).scalar() for c in scaler.columns})
    expr = _unscaled if inverse else _scaled
    return joined.withColumns({c: expr(c) for c in cols}).select(*df.columns)


def sequence_windows(
    df: DataFrame, features: Sequence[str], *, steps: int, by: Sequence[str] = ("symbol",), step_seconds: int
) -> DataFrame:
    """The `steps` rows before each row as an array of feature arrays; rows with fewer before them are dropped."""

    def build(d: DataFrame, w) -> DataFrame:
        row = F.array(*[F.col(f"`{f}`") for f in features])
        return d.withColumn("sequence", F.collect_list(row).over(w.rowsBetween(-steps, -1)))

    out = over_blocks(df, build, by=by, step_seconds=step_seconds, halo=steps)
    return out.filter(F.size("sequence") == steps)
