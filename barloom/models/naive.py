"""The fallback forecast: a pull toward the recent mean, with bounds from the average true range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DAY
from barloom.functions.scalar import shift_seconds, with_ohlc_limits
from barloom.operators.indicators import atr
from barloom.operators.toplists import last_values, tail_rows

SMA_ROWS = 10
ATR_ROWS = 14


def naive_forecast(bars: DataFrame, *, horizon: int = 1, step_seconds: int) -> DataFrame:
    """One candle per symbol, `horizon` days after its last bar."""
    last = last_values(atr(bars, step_seconds=step_seconds, n=ATR_ROWS, at_least=2), ["open", "high", "low", "close", "atr"])
    mean = tail_rows(bars, SMA_ROWS).groupBy("symbol").agg(F.avg("close").alias("sma"))
    ratio = F.coalesce(F.try_divide(F.col("close"), F.col("sma")), F.lit(1.0))
    reach = F.coalesce(
        F.nullif("atr", F.lit(0.0)), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.abs(F.col("close") * 0.01)
    )
    guess = (
        last.join(mean, "symbol")
        .withColumn("_close", F.col("close") * (0.5 + 0.5 * ratio))
        .withColumn("_open", (F.col("_close") + F.col("open")) / 2)
        .withColumn("_reach", 0.5 * reach)
        .select(
            "symbol",
            shift_seconds(F.col("ts"), horizon * DAY).alias("ts"),
            F.col("_open").alias("open"),
            (F.greatest("_open", "_close") + F.col("_reach")).alias("high"),
            (F.least("_open", "_close") - F.col("_reach")).alias("low"),
            F.col("_close").alias("close"),
        )
    )
    cells = ["open", "high", "low", "close"]
    return with_ohlc_limits(guess).withColumns({c: F.round(c, 4) for c in cells}).withColumn("model", F.lit("naive_sma_atr"))
