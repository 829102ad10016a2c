"""Bars from tick tables, and feeds over stored bars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def bucket(ts: Column, unit: str) -> Column:
    """Start of the bar a tick falls into, as a zone-free timestamp."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def tick_rank(ticks: DataFrame, columns: Sequence[str]) -> Column:
    """One value in the order of the columns.

    A time and a whole number become one decimal, which has a fixed width: aggregates that hold it hash, while those that hold
    a struct sort all ticks first. A null number comes first, a tick without a time is left out.
    """
    kinds = [ticks.schema[c].dataType for c in columns]
    if len(columns) == 1:
        return F.col(columns[0])
    if len(columns) == 2 and isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType)) and isinstance(kinds[1], (T.IntegerType, T.LongType)):
        micros = F.unix_micros(F.col(columns[0]).cast("timestamp")).cast("decimal(20,0)")
        number = F.coalesce(F.col(columns[1]).cast("long"), F.lit(-(2**63)).cast("long")).cast("decimal(20,0)")
        return micros * F.lit(str(2**64)).cast("decimal(20,0)") + (number + F.lit(str(2**63)).cast("decimal(20,0)"))
    return F.struct(*columns)


# Lengths of the bar units.
UNITS = {"MINUTE": dt.timedelta(minutes=1), "HOUR": dt.timedelta(hours=1), "DAY": dt.timedelta(days=1)}
_EPOCH = dt.datetime(1970, 1, 1)


def within(ticks: DataFrame, ts: str, unit: str, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """The ticks of all bars whose start lies between `since` and `until`, both included.

    Bounds are literals on the raw time, rounded to whole bars, so that they reach the scan.
    """
    width = UNITS[unit]
    kind = ticks.schema[ts].dataType
    if since is not None:
        first = _EPOCH - (_EPOCH - since) // width * width  # rounded up
        ticks = ticks.filter(F.col(ts) >= F.lit(first).cast("timestamp_ntz").cast(kind))
    if until is not None:
        end = _EPOCH + ((until - _EPOCH) // width + 1) * width
        ticks = ticks.filter(F.col(ts) < F.lit(end).cast("timestamp_ntz").cast(kind))
    return ticks


def bars(
    ticks: DataFrame, *, symbol: str, ts: str, price: str, tick_order: Sequence[str], unit: str, since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """Open, high, low, close and tick count per symbol and time bucket, of all bars or of those from `since` to `until`.

    `tick_order` names the columns that order the ticks of one symbol uniquely. All aggregates combine on the map
    side, so a symbol with a third of all ticks costs its reducer one row per map task and bar.
    """
    ticks = within(ticks, ts, unit, since, until)
    order = tick_rank(ticks, tick_order)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), unit).alias("_bar"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("_bar", "ts")
        .select(*BAR_COLUMNS)
    )


def feed(stored: DataFrame, *, symbols: Sequence[str], span_days: int | None = None) -> DataFrame:
    """Bars of the wanted symbols over the last `span_days` days of the table; empty symbols vanish, none is an error."""
    wanted = stored.filter(F.col("symbol").isin(list(symbols)))
    if span_days is not None:
        newest = wanted.agg(F.max("ts").alias("ts"))
        since = newest.select((F.col("ts") - F.expr(f"INTERVAL {span_days} DAYS")).alias("ts"))
        wanted = wanted.filter(F.col("ts") >= since.scalar())
    return wanted


def recent_bars(ticks: DataFrame, *, symbol: str, ts: str, unit: str, symbols: Sequence[str], span_days: int, **rest: object) -> DataFrame:
    """`feed` over the bars of a tick table, which builds only the bars it returns.

    The newest time is one aggregate of two columns; it then bounds the scan. A feed without ticks is empty.
    """
    wanted = ticks.filter(F.col(symbol).isin(list(symbols)))
    newest = wanted.agg(F.max(bucket(F.col(ts), unit))).first()[0]
    since = newest - dt.timedelta(days=span_days) if newest is not None else None
    return bars(wanted, symbol=symbol, ts=ts, unit=unit, since=since, **rest)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early when a feed came back empty."""
    if df.isEmpty():
        raise ValueError(f"no data for {what}")
    return df
