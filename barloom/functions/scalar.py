"""Row-level expressions. Every missing value, NaN and infinity included, is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Period names and their spans.
PERIOD_DAYS = {"1H": 1 / 24, "24H": 1, "1W": 7, "1M": 30, "3M": 90, "6M": 180}
LONG_PERIODS = ["1M", "3M", "6M"]
DEFAULT_PERIOD_DAYS = 180


def numeric(c: str) -> Column:
    """Text that is not a number becomes NULL."""
    return finite(F.col(c).try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number_or(x: Column, default: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def nonnegative(x: Column) -> Column:
    """Clip at zero, NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def high_spread() -> Column:
    return nonnegative(F.col("high") - F.col("close"))


def low_spread() -> Column:
    return nonnegative(F.col("close") - F.col("low"))


def missing_cells(cols: list[str]) -> Column:
    """How many of the columns are NULL in this row."""
    return F.expr(" + ".join(f"CAST(`{c}` IS NULL AS INT)" for c in cols))


def with_calendar(df: DataFrame, ts: str = "ts", *, hours: bool = False) -> DataFrame:
    """day_of_week (Monday 0), month, quarter, year; for forecasts also hour and is_weekend."""
    t = F.col(ts)
    parts = {"day_of_week": F.weekday(t), "month": F.month(t), "quarter": F.quarter(t), "year": F.year(t)}
    if hours:
        parts |= {"hour": F.hour(t), "is_weekend": (F.weekday(t) >= 5).cast("int")}
    return df.withColumns(parts)


def to_utc_naive(ts: Column, zone: str | Column = "UTC") -> Column:
    """A wall-clock time in some zone as zone-free UTC."""
    return F.to_utc_timestamp(ts, zone).cast("timestamp_ntz")


def time_label(ts: Column, *, long: bool) -> Column:
    return F.date_format(ts, "yyyy-MM-dd" if long else "yyyy-MM-dd HH:mm")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO text to a zone-free time; a Z is ignored, anything else unreadable is NULL."""
    return F.replace(text, F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")


def change_columns(df: DataFrame) -> DataFrame:
    """Candle change, change in percent and direction."""
    delta = F.col("close") - F.col("open")
    return df.withColumns(
        {
            "change": delta,
            "change_percent": F.try_divide(delta, F.col("open")) * 100,
            "color": F.when(delta >= 0, "Up").otherwise("Down"),
        }
    )


def with_envelope(df: DataFrame) -> DataFrame:
    """High and low widened to hold open and close; missing cells are skipped."""
    return df.withColumns(
        {"high": F.greatest("open", "close", "high"), "low": F.least("open", "close", "low")}
    )


def with_ohlc_limits(df: DataFrame) -> DataFrame:
    """High at least, low at most everything else; missing high or low filled; open and close inside."""
    cells = [F.col(c) for c in ("open", "high", "low", "close")]
    top, bottom = F.greatest(*cells), F.least(*cells)

    def inside(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), bottom), top))

    return df.withColumns({"open": inside("open"), "high": top, "low": bottom, "close": inside("close")})


def period_seconds(period: Column) -> Column:
    """Span of a period name in seconds, 180 days for unknown names."""
    out = F.lit(DEFAULT_PERIOD_DAYS * 86400)
    for name, days in PERIOD_DAYS.items():
        out = F.when(period == name, round(days * 86400)).otherwise(out)
    return out


def shift_seconds(ts: Column, seconds: Column | int) -> Column:
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_add("SECOND", s.cast("int"), ts)


def map_ohlc_row(df: DataFrame) -> DataFrame:
    """Rows with Date/Open/... or time/open/... as one shape; a date without a time gets midnight."""

    def either(upper: str, lower: str) -> Column:
        present = [F.col(c) for c in (upper, lower) if c in df.columns]
        return F.coalesce(*present)

    date = either("Date", "time")
    date = F.when(~F.contains(date, F.lit("T")), F.concat(date, F.lit("T00:00:00"))).otherwise(date)
    pairs = [("Open", "open"), ("High", "high"), ("Low", "low"), ("Close", "close")]
    return df.select(date.alias("Date"), *[either(u, low).alias(u) for u, low in pairs])


def trend_label(change_percent: Column, limit: float) -> Column:
    return (
        F.when(change_percent.isNull(), "N/A")
        .when(change_percent > limit, "BULLISH")
        .when(change_percent < -limit, "BEARISH")
        .otherwise("NEUTRAL")
    )


def utc_time(text: Column) -> Column:
    """A date or time in UTC, zone-free: an offset in the text is applied, a text without one is taken as UTC."""
    return F.when(text.try_cast("timestamp_ntz").isNotNull(), text.try_cast("timestamp").cast("timestamp_ntz"))


def parse_time_smart(df: DataFrame, text: str, name: str) -> DataFrame:
    """Parse times; if not one value parses, read numbers as epoch milliseconds (median above 1e11) or seconds.

    The median test needs no sort: it follows from the counts on both sides of 1e11 and the two values next to it.
    """
    limit = 1e11
    parsed = utc_time(F.col(text))
    number = F.col(text).try_cast("double")
    above, below = number > limit, number <= limit
    facts = df.agg(
        F.coalesce(F.bool_or(parsed.isNotNull()), F.lit(False)).alias("any_text"),
        F.count_if(above).alias("hi"),
        F.count_if(below).alias("lo"),
        F.max(F.when(below, number)).alias("left"),
        F.min(F.when(above, number)).alias("right"),
    ).select(
        F.struct(
            "any_text",
            F.when(F.col("hi") == F.col("lo"), (F.col("left") + F.col("right")) / 2 > limit)
            .otherwise(F.col("hi") > F.col("lo"))
            .alias("millis"),
        ).alias("facts")
    )
    probed = df.withColumn("_facts", facts.scalar())
    seconds = F.when(F.col("_facts.millis"), number / 1000).otherwise(number)
    micros = F.timestamp_micros(F.round(seconds * 1e6).try_cast("long")).cast("timestamp_ntz")
    return probed.withColumn(name, F.when(F.col("_facts.any_text"), parsed).otherwise(micros)).drop("_facts")
