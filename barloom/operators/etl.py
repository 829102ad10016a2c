"""The three batch steps before training: the merged panel, the feature table and the validation record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Horizon
from barloom.operators import quality
from barloom.operators.align import wide_panel
from barloom.operators.blocks import POS, over_blocks
from barloom.operators.clean import filter_missing, timeline_missing, until
from barloom.operators.ewm import add_ewm_recursive, block_rows, reach
from barloom.operators.fill import fill_panel
from barloom.operators.indicators import add_rsi, rolling
from barloom.session import written

CELLS = ["open", "high", "low", "close", "volume"]
PANEL_FEATURES = [*CELLS, "sma14", "ema14", "rsi14"]
_SPAN = 14


def basic_indicators(bars: DataFrame, *, step_seconds: int) -> DataFrame:
    """Partial 14-row mean, recursive EMA and partial RSI, behind one shuffle."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("sma14", rolling(F.avg, F.col("close"), _SPAN, w))
        d = add_ewm_recursive(d, "close", "ema14", _SPAN, w)
        return add_rsi(d, w, "close", "rsi14", n=_SPAN, full=False)

    halo = reach(_SPAN)
    return over_blocks(bars, build, step_seconds=step_seconds, halo=halo, rows=block_rows([_SPAN], halo))


def etl_panel(bars: DataFrame, symbols: Sequence[str], horizon: Horizon, *, end: Column | None = None) -> DataFrame:
    """One row per time with eight columns per symbol: cut at the end date, sparse times dropped, gaps filled.

    The merged panel is written out before it is filled, since filling reads it twice.
    """
    step = horizon.step_seconds
    panel = wide_panel(basic_indicators(bars, step_seconds=step), symbols, PANEL_FEATURES)
    cols = [c for c in panel.columns if c != "ts"]
    if end is not None:
        panel = until(panel, end)
    kept = written(filter_missing(panel, cols, horizon.max_missing_etl), "panel")
    return fill_panel(kept, cols, step_seconds=step).drop(POS)


def etl_record(bars: DataFrame, horizon: Horizon, *, end: Column | None = None) -> DataFrame:
    """The row counts of the panel step, as one row."""
    gaps = timeline_missing(bars, CELLS)
    in_range = F.lit(True) if end is None else F.col("ts") <= end
    complete = F.col("missing") / F.col("cells") <= horizon.max_missing_etl.share
    return quality.etl_quality(gaps, in_range=in_range, complete=complete, threshold=horizon.max_missing_etl.share)


def feature_table(bars: DataFrame, *, step_seconds: int, n: int = 20) -> DataFrame:
    """Partial n-row mean and deviation of the close per symbol."""

    def build(d: DataFrame, w) -> DataFrame:
        close = F.col("close")
        return d.withColumns(
            {"sma20": rolling(F.avg, close, n, w), "rolling_vol20": rolling(F.stddev_samp, close, n, w)}
        )

    return over_blocks(bars, build, step_seconds=step_seconds, halo=n - 1)


def validation_record(bars: DataFrame, *, as_of: Column, limit_seconds: int) -> DataFrame:
    """One row: is the table fresh, does every symbol have enough rows; no error is known at this point."""
    fresh = quality.freshness(bars, as_of=as_of, limit_seconds=limit_seconds).select("freshness_ok")
    enough = quality.rows_ok(bars)
    return fresh.withColumn("missing_rate_ok", enough.scalar()).withColumn("last_mape", F.lit(None).cast("double"))
