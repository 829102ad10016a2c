"""Forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.blocks import over_blocks

EPS = 2.220446049250313e-16  # fixed value: smallest denominator of a relative error

KEYS = ("model", "target")


def error() -> Column:
    return F.col("actual") - F.col("predicted")


def mae() -> Column:
    return F.avg(F.abs(error()))


def rmse() -> Column:
    return F.sqrt(F.avg(error() * error()))


def mape() -> Column:
    return F.avg(F.abs(error()) / F.greatest(F.abs("actual"), F.lit(EPS)))


def smape() -> Column:
    size = F.abs("actual") + F.abs("predicted")
    return 100 * F.avg(F.when(size == 0, 0.0).otherwise(F.try_divide(2 * F.abs(error()), size)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs, NULL where one side is constant (the built-in one raises there)."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def is_spread(target: Column) -> Column:
    return F.contains(target, F.lit("spread"))


def rises(x: str, w) -> Column:
    """Did the value go up against the row before, by the sign of the relative change? The first row did not."""
    now, before = F.col(x), F.lag(x).over(w)
    up = F.when(before == 0, now > 0).otherwise(F.try_divide(now, before) - 1 > 0)
    return F.coalesce(up, F.lit(False))


def with_direction_hits(pairs: DataFrame, *, by: Sequence[str], step_seconds: int) -> DataFrame:
    """Flag the rows where actual and predicted agree on going up."""
    return over_blocks(
        pairs,
        lambda d, w: d.withColumn("hit", rises("actual", w) == rises("predicted", w)),
        by=by,
        step_seconds=step_seconds,
        halo=1,
    )


def direction_accuracy(pairs: DataFrame, *, by: Sequence[str] = KEYS, step_seconds: int) -> DataFrame:
    hits = with_direction_hits(pairs, by=by, step_seconds=step_seconds)
    return hits.groupBy(*by).agg(F.avg(F.col("hit").cast("double")).alias("dir_acc"))


def evaluate(pairs: DataFrame, *, by: Sequence[str] = KEYS, step_seconds: int) -> DataFrame:
    """All errors per group: MAPE for prices, sMAPE for spreads, the other one NULL."""
    spread = F.first(is_spread(F.col("target")))
    return (
        with_direction_hits(pairs, by=by, step_seconds=step_seconds)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            mae().alias("mae"),
            rmse().alias("rmse"),
            F.when(~spread, mape()).alias("mape"),
            F.when(spread, smape()).alias("smape"),
            F.avg(F.col("hit").cast("double")).alias("dir_acc"),
        )
    )


def with_failed(found: DataFrame, series: DataFrame, models: Sequence[str], targets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A row for every series (`keys`), model and target; n is 0 and the errors are NULL where a model gave no pairs.

    `series` has one row for each series.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("target")) for m in models for t in targets])
    full = series.select(*keys, F.inline(cells)).join(found, [*keys, "model", "target"], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0)))


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics as rows; those that do not apply are left out."""
    names = ["mae", "rmse", "mape", "smape", "dir_acc"]
    return wide.unpivot(list(keys), names, "metric", "value").filter(F.col("value").isNotNull())


def backtest_summary(folds: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Over the folds of a model and target: how many, mean and deviation of the errors, mean direction accuracy."""
    spreads = [F.avg(m).alias(f"{m}_mean") for m in ("mae", "rmse", "mape", "smape", "dir_acc")]
    deviations = [F.stddev_samp(m).alias(f"{m}_std") for m in ("mae", "rmse", "mape", "smape")]
    return folds.groupBy(*by).agg(F.count("mae").alias("n_folds"), *spreads, *deviations)
