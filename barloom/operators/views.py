"""Chart-ready tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import (
    DEFAULT_PERIOD_DAYS,
    LONG_PERIODS,
    PERIOD_DAYS,
    change_columns,
    nonnegative,
    period_seconds,
    shift_seconds,
    time_label,
    trend_label,
    with_envelope,
)
from barloom.operators.align import calendar_reindex
from barloom.operators.blocks import POS, calendar_pos, number_rows, over_blocks
from barloom.operators.facts import join_facts
from barloom.operators.fill import fill_rows


def candle_table(forecast: DataFrame, *, by: Sequence[str] = ("model",), long: bool, step_seconds: int) -> DataFrame:
    """Candles from forecast (ts, close, high, low): open is the close before, high and low hold all four.

    The first row has no open and is dropped; the next one then has none either and is dropped as well. Long
    horizons get a row for each missing day in between.
    """

    def opened(df: DataFrame) -> DataFrame:
        return over_blocks(
            df, lambda d, w: d.withColumn("open", F.lag("close").over(w)), by=by, step_seconds=step_seconds, halo=1
        )

    rows = forecast.select(*by, "ts", "close", "high", "low")
    rows = number_rows(rows, by=by, step_seconds=step_seconds)
    rows = opened(rows).dropna(subset=["ts", "open", "high", "low", "close"]).drop("open")
    if not long:
        rows = number_rows(rows.drop(POS), by=by, step_seconds=step_seconds)
    if long:
        cells = ["close", "high", "low"]
        rows = calendar_reindex(rows, cells, by=by, step_seconds=step_seconds)
        rows = rows.withColumn(POS, calendar_pos("ts", step_seconds))
        rows = fill_rows(rows, cells, by=by, step_seconds=step_seconds, how="forward")
    rows = with_envelope(opened(rows)).dropna(subset=["open", "high", "low", "close"])
    return change_columns(rows.drop(POS)).withColumn("label", time_label(F.col("ts"), long=long))


def tagged_history(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return history.select(*by, "ts", F.col("close").alias("price"), F.lit("Historical").alias("model"), F.lit("Historical").alias("kind"))


def union_history_forecast(history: DataFrame, forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History and the forecasts of all models as one line table."""
    predicted = forecast.select(*by, "ts", F.col("yhat").alias("price"), "model", F.lit("Predict").alias("kind"))
    return tagged_history(history, by).unionByName(predicted)


def merge_cutoff(history: DataFrame, forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History of each series up to and including its first forecast time, then all forecast rows, tagged by source.

    A series without a forecast has no cut-off and no history.
    """
    cells = [*by, "ts", "open", "high", "low", "close"]
    if by:
        first = forecast.groupBy(*by).agg(F.min("ts").alias("_first"))
        kept = join_facts(history, first, by).filter("ts <= _first")
    else:
        kept = history.filter(F.col("ts") <= forecast.agg(F.min("ts")).scalar())
    kept = kept.select(*cells, F.lit("history").alias("source"))
    return kept.unionByName(forecast.select(*cells, F.lit("forecast").alias("source")))


def cut_from_start(forecast: DataFrame, periods: Sequence[str], *, by: Sequence[str] = ("model",)) -> DataFrame:
    """First span of each series for several periods at once, both ends included."""
    starts = forecast.groupBy(*by).agg(F.min("ts").alias("_start"))
    each = F.explode(F.array(*[F.lit(p) for p in periods])).alias("period")
    limits = starts.select(*by, "_start", each).withColumn("_end", shift_seconds(F.col("_start"), period_seconds(F.col("period"))))
    return join_facts(forecast, limits, by).filter(F.col("ts").between(F.col("_start"), F.col("_end"))).drop("_start", "_end")


def cut_from_end(rows: DataFrame, periods: Sequence[str], *, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last span of each series: whole days before the day after the newest row, or the closed span up to it.

    Rows without a time are kept.
    """
    newest = rows.groupBy(*by).agg(F.max("ts").alias("_max"))
    each = F.explode(F.array(*[F.lit(p) for p in periods])).alias("period")
    limits = newest.select(*by, "_max", each)
    long = F.col("period").isin(LONG_PERIODS)
    day_after = F.date_trunc("DAY", "_max").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    end = F.when(long, day_after).otherwise(F.col("_max"))
    limits = limits.withColumn("_end", end).withColumn("_start", shift_seconds(F.col("_end"), -period_seconds(F.col("period"))))
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    inside = F.when(long, (day >= F.col("_start")) & (day < F.col("_end"))).otherwise(
        F.col("ts").between(F.col("_start"), F.col("_end"))
    )
    return join_facts(rows, limits, by).filter(F.col("ts").isNull() | inside).drop("_max", "_start", "_end")


def range_until(rows: DataFrame, period: str, as_of: Column) -> DataFrame:
    """Rows in [as_of - span, as_of]; long periods compare dates only."""
    start = shift_seconds(as_of, -period_seconds(F.lit(period)))
    if period in LONG_PERIODS:
        return rows.filter(F.to_date("ts").between(F.to_date(start), F.to_date(as_of)))
    return rows.filter(F.col("ts").between(start, as_of))


def range_bounds(period: str, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """First and last time that `range_until` can keep, for the scan below it."""
    start = as_of - dt.timedelta(days=PERIOD_DAYS.get(period, DEFAULT_PERIOD_DAYS))
    if period not in LONG_PERIODS:
        return start, as_of
    midnight = dt.datetime.combine(start, dt.time())
    return midnight, dt.datetime.combine(as_of, dt.time()) + dt.timedelta(days=1, microseconds=-1)


def visible_high_low(rows: DataFrame, start: Column, end: Column, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Highest high and lowest low in a time range, ignoring what is not finite."""

    def usable(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))

    return rows.filter(F.col("ts").between(start, end)).groupBy(*by).agg(
        F.max(usable("high")).alias("high"), F.min(usable("low")).alias("low")
    )


def current_vs_forecast(current: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Change in percent from the last actual to the last forecast value."""
    last = forecast.groupBy("model", *keys).agg(F.max_by("yhat", "step").alias("yhat"))
    gap = F.col("yhat") - F.col("current")
    return last.join(current, list(keys)).withColumn("change_percent", F.try_divide(gap, F.col("current")) * 100)


def horizon_table(
    forecast: DataFrame, steps: Sequence[int], limit: float, keys: Sequence[str] = ("model", "target"), current: DataFrame | None = None
) -> DataFrame:
    """Forecasts at fixed steps and the trend between the first and last one that exists.

    With `current` (target, current) the trend goes from the last actual value to the last forecast instead.
    """
    cells = [F.max(F.when(F.col("step") == s, F.col("yhat"))).alias(f"h{s}") for s in steps]
    wide = forecast.filter(F.col("step").isin(list(steps))).groupBy(*keys).agg(*cells)
    if current is not None:
        change = current_vs_forecast(current, forecast.select(*keys, "step", "yhat")).select(*keys, "change_percent")
        return wide.join(change, list(keys), "left").withColumn("trend", trend_label(F.col("change_percent"), limit))
    names = [f"h{s}" for s in steps]
    first, last = F.coalesce(*names), F.coalesce(*reversed(names))
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    change = F.when(known >= 2, F.try_divide(last - first, first) * 100)
    return wide.withColumn("change_percent", change).withColumn("trend", trend_label(change, limit))


def consensus(forecast: DataFrame, early: int, late: int, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Mean over the models at two steps and the change between them."""
    return (
        forecast.filter(F.col("step").isin(early, late))
        .groupBy(*keys)
        .agg(*[F.avg(F.when(F.col("step") == s, F.col("yhat"))).alias(n) for n, s in (("early", early), ("late", late))])
        .withColumn("change_percent", F.try_divide(F.col("late") - F.col("early"), F.col("early")) * 100)
    )


def rebuild_high_low(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """High and low from forecast close and spreads; negative spreads count as 0."""
    cell = {t: F.max(F.when(F.col("target") == t, F.col("yhat"))) for t in ("close", "high_spread", "low_spread")}
    wide = forecast.groupBy(*keys).agg(*[v.alias(k) for k, v in cell.items()])
    return wide.select(
        *keys,
        "close",
        (F.col("close") + nonnegative(F.col("high_spread"))).alias("high"),
        (F.col("close") - nonnegative(F.col("low_spread"))).alias("low"),
    )


def metric_trend(folds: DataFrame, keys: Sequence[str] = ("model", "target", "metric")) -> DataFrame:
    """Metric values numbered over the folds that have one."""
    w = Window.partitionBy(*keys).orderBy("fold")
    return folds.filter(F.col("value").isNotNull()).withColumn("n", F.row_number().over(w) - 1)
