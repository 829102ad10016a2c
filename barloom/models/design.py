"""Training tables: targets and features of each series, numbered and without gaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Cells, Share
from barloom.functions.columns import cells_where
from barloom.functions.scalar import with_calendar
from barloom.operators.align import wide_panel
from barloom.operators.blocks import POS, number_rows, over_blocks
from barloom.operators.clean import filter_missing
from barloom.operators.fill import fill_panel
from barloom.operators.indicators import INDICATORS, add_volatility, change, indicator_set
from barloom.session import written

OHLCV = ["open", "high", "low", "close", "volume"]
TARGETS = ["close", "high_spread", "low_spread"]
CALENDAR = ["day_of_week", "month", "quarter", "year"]


@dataclass(frozen=True)
class Design:
    """What the columns of a training table mean."""

    targets: tuple[str, ...]
    features: tuple[str, ...]
    step_seconds: int
    by: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.targets, *self.features]

    def with_features(self, features: Sequence[str]) -> Design:
        return Design(self.targets, tuple(features), self.step_seconds, self.by)


def features_then_fill(
    bars: DataFrame, symbols: Sequence[str], *, max_missing: Cells | Share, step_seconds: int, past_only: bool = False,
    names: Sequence[str] = (*OHLCV, *INDICATORS),
) -> DataFrame:
    """Training order: indicators per symbol, merged on time, sparse times dropped, gaps filled.

    The merged panel is written out before it is filled, since filling reads it several times. `past_only` carries the
    last value forward instead of interpolating, and so uses nothing that was not known at the time.
    """
    panel = wide_panel(indicator_set(bars, step_seconds=step_seconds), symbols, names)
    cols = [c for c in panel.columns if c != "ts"]
    kept = written(filter_missing(panel, cols, max_missing), "panel")
    return fill_panel(kept, cols, step_seconds=step_seconds, how="forward" if past_only else "linear")


def fill_then_features(
    bars: DataFrame, symbols: Sequence[str], *, max_missing: Cells | Share, step_seconds: int,
    names: Sequence[str] = (*OHLCV, *INDICATORS),
) -> DataFrame:
    """Prediction order: bars merged on time, sparse times dropped, gaps filled, then indicators per symbol."""
    panel = wide_panel(bars, symbols, OHLCV)
    cols = [c for c in panel.columns if c != "ts"]
    kept = written(filter_missing(panel, cols, max_missing), "panel")
    filled = fill_panel(kept, cols, step_seconds=step_seconds, how="linear").fillna(0.0)
    rows = F.array(
        *[F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{s}_{f}`").alias(f) for f in OHLCV]) for s in symbols]
    )
    long = filled.select("ts", POS, F.inline(rows))
    full = indicator_set(long, step_seconds=step_seconds)
    return wide_panel_with_pos(full, symbols, names)


def wide_panel_with_pos(rows: DataFrame, symbols: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.groupBy("ts", POS).agg(*cells_where("symbol", symbols, features))


def training_table(panel: DataFrame, target: str, *, step_seconds: int) -> tuple[DataFrame, Design]:
    """Targets and features of the target asset: its own close, high and low become targets, all else features."""

    def macro(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("target_returns_30", change(F.col(f"`{target}_close`"), 30, w))
        return add_volatility(d, w, "target_volatility_30", n=30, x=f"`{target}_close`")

    rows = over_blocks(panel.fillna(0.0), macro, by=[], step_seconds=step_seconds, halo=31)
    rows = with_calendar(rows)
    high, low, close = (F.col(f"`{target}_{c}`") for c in ("high", "low", "close"))
    rows = rows.withColumns(
        {
            "close": close,
            "high_spread": F.greatest(high - close, F.lit(0.0)),
            "low_spread": F.greatest(close - low, F.lit(0.0)),
        }
    )
    own = {f"{target}_{c}" for c in ("close", "high", "low")}
    features = [c for c in panel.columns if c not in {"ts", POS, *own}] + [*CALENDAR, "target_returns_30", "target_volatility_30"]
    cells = [F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS `{c}`") for c in [*TARGETS, *features]]
    return rows.select("ts", POS, *cells), Design(tuple(TARGETS), tuple(features), step_seconds)


def series_table(bars: DataFrame, features: Sequence[str], *, step_seconds: int, warm_up: int = 33) -> tuple[DataFrame, Design]:
    """Many series at once: each symbol's own targets and indicators, without the rows before all are there.

    Rows are numbered from 1 again, since windows of training rows are cut by position.
    """
    numbered = number_rows(bars, by=["symbol"], step_seconds=step_seconds)
    rows = indicator_set(numbered, step_seconds=step_seconds)
    close = F.col("close")
    rows = rows.withColumns(
        {"high_spread": F.greatest(F.col("high") - close, F.lit(0.0)), "low_spread": F.greatest(close - F.col("low"), F.lit(0.0))}
    ).filter(F.col(POS) > warm_up)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in [*TARGETS, *features]]
    rows = rows.withColumn(POS, F.col(POS) - warm_up)
    return rows.select("symbol", "ts", POS, *cells), Design(tuple(TARGETS), tuple(features), step_seconds, ("symbol",))
