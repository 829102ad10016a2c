"""Technical indicators over bars, each computed on blocks of a series.

`strict` windows give NULL until they are full; partial ones use what there is. The functions named `add_*` take a
blocked frame and its window so that several of them can share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.operators import ewm
from barloom.operators.blocks import over_blocks


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def rolling(fn: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """Partial n-row window aggregate."""
    return fn(x).over(_frame(w, n))


def strict(fn: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """n-row window aggregate, NULL unless all n values are there."""
    return F.when(F.count(x).over(_frame(w, n)) == n, fn(x).over(_frame(w, n)))


def change(x: Column, k: int, w: WindowSpec) -> Column:
    """k-row relative change as a fraction."""
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def add_rsi(df: DataFrame, w: WindowSpec, x: str, name: str, *, n: int = 14, full: bool = True) -> DataFrame:
    """RSI. `full` windows give 100 where nothing was lost; partial ones give NULL there. Flat is NULL in both."""
    step = F.col(x) - F.lag(x).over(w)
    df = df.withColumn("_up", F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0))).withColumn(
        "_down", F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))
    )
    mean = strict if full else rolling
    gain, loss = mean(F.avg, F.col("_up"), n, w), mean(F.avg, F.col("_down"), n, w)
    df = df.withColumn("_gain", gain).withColumn("_loss", loss)
    value = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_gain"), F.col("_loss")))
    if full:
        value = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0).otherwise(value)
    return df.withColumn(name, value).drop("_up", "_down", "_gain", "_loss")


def add_bollinger(df: DataFrame, w: WindowSpec, x: str = "close", *, n: int = 20, width: float = 2.0) -> DataFrame:
    col = F.col(x)
    df = df.withColumn("bb_middle", strict(F.avg, col, n, w)).withColumn("_std", strict(F.stddev_samp, col, n, w))
    return (
        df.withColumn("bb_upper", F.col("bb_middle") + width * F.col("_std"))
        .withColumn("bb_lower", F.col("bb_middle") - width * F.col("_std"))
        .withColumn("bb_width", F.col("bb_upper") - F.col("bb_lower"))
        .drop("_std")
    )


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def add_atr(df: DataFrame, w: WindowSpec, *, n: int = 14, at_least: int | None = None) -> DataFrame:
    """Mean true range; `at_least` rows are enough when given, else all n are needed."""
    df = df.withColumn("_range", true_range(w))
    if at_least is None:
        atr = strict(F.avg, F.col("_range"), n, w)
    else:
        seen = F.count("_range").over(_frame(w, n))
        atr = F.when(seen >= at_least, rolling(F.avg, F.col("_range"), n, w))
    return df.withColumn("atr", atr).drop("_range")


def add_stochastic(df: DataFrame, w: WindowSpec, *, n: int = 14, smooth: int = 3) -> DataFrame:
    low, high = strict(F.min, F.col("low"), n, w), strict(F.max, F.col("high"), n, w)
    df = df.withColumn("_low", low).withColumn("_high", high)
    k = 100 * F.try_divide(F.col("close") - F.col("_low"), F.col("_high") - F.col("_low"))
    df = df.withColumn("stoch_k", k)
    return df.withColumn("stoch_d", strict(F.avg, F.col("stoch_k"), smooth, w)).drop("_low", "_high")


def add_volume_ratio(df: DataFrame, w: WindowSpec, *, n: int = 20) -> DataFrame:
    df = df.withColumn("volume_sma", strict(F.avg, F.col("volume"), n, w))
    return df.withColumn("volume_ratio", F.try_divide(F.col("volume"), F.col("volume_sma")))


def add_volatility(df: DataFrame, w: WindowSpec, name: str, *, n: int = 20, x: str = "close") -> DataFrame:
    df = df.withColumn("_ret", change(F.col(x), 1, w))
    return df.withColumn(name, strict(F.stddev_samp, F.col("_ret"), n, w)).drop("_ret")


# --- one indicator per call -----------------------------------------------------------------------------------------


def sma(bars: DataFrame, *, n: int, name: str, step_seconds: int, full: bool, x: str = "close") -> DataFrame:
    mean = strict if full else rolling
    return over_blocks(
        bars, lambda d, w: d.withColumn(name, mean(F.avg, F.col(x), n, w)), step_seconds=step_seconds, halo=n - 1
    )


def rolling_std(bars: DataFrame, *, n: int, name: str, step_seconds: int, x: str = "close") -> DataFrame:
    return over_blocks(
        bars,
        lambda d, w: d.withColumn(name, rolling(F.stddev_samp, F.col(x), n, w)),
        step_seconds=step_seconds,
        halo=n - 1,
    )


def rsi(bars: DataFrame, *, name: str, step_seconds: int, full: bool, n: int = 14) -> DataFrame:
    return over_blocks(
        bars, lambda d, w: add_rsi(d, w, "close", name, n=n, full=full), step_seconds=step_seconds, halo=n
    )


def bollinger(bars: DataFrame, *, step_seconds: int, n: int = 20) -> DataFrame:
    return over_blocks(bars, lambda d, w: add_bollinger(d, w, n=n), step_seconds=step_seconds, halo=n - 1)


def atr(bars: DataFrame, *, step_seconds: int, n: int = 14, at_least: int | None = None) -> DataFrame:
    return over_blocks(bars, lambda d, w: add_atr(d, w, n=n, at_least=at_least), step_seconds=step_seconds, halo=n)


def stochastic(bars: DataFrame, *, step_seconds: int) -> DataFrame:
    return over_blocks(bars, lambda d, w: add_stochastic(d, w), step_seconds=step_seconds, halo=14 + 3 - 2)


def volume_ratio(bars: DataFrame, *, step_seconds: int) -> DataFrame:
    return over_blocks(bars, lambda d, w: add_volume_ratio(d, w), step_seconds=step_seconds, halo=19)


def rate_of_change(bars: DataFrame, *, step_seconds: int, n: int = 10, name: str = "roc") -> DataFrame:
    return over_blocks(
        bars, lambda d, w: d.withColumn(name, change(F.col("close"), n, w)), step_seconds=step_seconds, halo=n
    )


def volatility(bars: DataFrame, *, step_seconds: int, n: int = 20, name: str = "volatility") -> DataFrame:
    return over_blocks(bars, lambda d, w: add_volatility(d, w, name, n=n), step_seconds=step_seconds, halo=n)


def target_macro(bars: DataFrame, *, target: str, step_seconds: int, n: int = 30) -> DataFrame:
    """n-row return and return deviation of the target asset alone."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("returns_30", change(F.col("close"), n, w))
        return add_volatility(d, w, "volatility_30", n=n)

    return over_blocks(bars.filter(F.col("symbol") == target), build, step_seconds=step_seconds, halo=n)


def returns(bars: DataFrame, *, step_seconds: int, periods: tuple[int, ...] = (1, 10)) -> DataFrame:
    """First difference and relative changes over the given numbers of rows."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("diff_1", F.col("close") - F.lag("close").over(w))
        for k in periods:
            d = d.withColumn(f"pct_{k}", change(F.col("close"), k, w))
        return d

    return over_blocks(bars, build, step_seconds=step_seconds, halo=max(periods))


def previous_close_open(bars: DataFrame, *, step_seconds: int) -> DataFrame:
    """Open becomes the close of the row before."""
    return over_blocks(
        bars, lambda d, w: d.withColumn("open", F.lag("close").over(w)), step_seconds=step_seconds, halo=1
    )


# --- exponential means and the whole set ----------------------------------------------------------------------------

_MACD_SPANS = [12, 26, 9]
_MACD_HALO = ewm.reach(26) + ewm.reach(9)
_MACD_ROWS = ewm.block_rows(_MACD_SPANS, _MACD_HALO)


def _add_macd(df: DataFrame, w: WindowSpec) -> DataFrame:
    def mean(c: str, span: int) -> Column:
        return ewm.ewm_adjusted(F.col(c), span, w, _MACD_ROWS, _MACD_HALO)

    df = df.withColumn("ema_12", mean("close", 12)).withColumn("ema_26", mean("close", 26))
    df = df.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    df = df.withColumn("macd_signal", mean("macd", 9))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def macd(bars: DataFrame, *, step_seconds: int) -> DataFrame:
    """EMA 12 and 26, their difference, its 9-row EMA and the rest, in one pass over blocks."""
    return over_blocks(bars, _add_macd, step_seconds=step_seconds, halo=_MACD_HALO, rows=_MACD_ROWS)


INDICATORS = [
    "sma_20", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi", "bb_middle", "bb_upper", "bb_lower",
    "bb_width", "atr", "stoch_k", "stoch_d", "volume_sma", "volume_ratio", "roc", "volatility",
]


def indicator_set(bars: DataFrame, *, step_seconds: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """All indicators of a symbol behind one shuffle, one sort and two window passes.

    The first pass holds every window over the bars themselves, the second every window over its results.
    """

    def mean(c: str, span: int, w: WindowSpec) -> Column:
        return ewm.ewm_adjusted(F.col(c), span, w, _MACD_ROWS, _MACD_HALO)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        close, high, low = F.col("close"), F.col("high"), F.col("low")
        d = d.withColumns(
            {
                "ema_12": mean("close", 12, w),
                "ema_26": mean("close", 26, w),
                "sma_20": strict(F.avg, close, 20, w),
                "_std": strict(F.stddev_samp, close, 20, w),
                "_low": strict(F.min, low, 14, w),
                "_high": strict(F.max, high, 14, w),
                "volume_sma": strict(F.avg, F.col("volume"), 20, w),
                "_before": F.lag(close).over(w),
                "_before10": F.lag(close, 10).over(w),
            }
        )
        step = close - F.col("_before")
        d = d.withColumns(
            {
                "macd": F.col("ema_12") - F.col("ema_26"),
                "_up": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)),
                "_down": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0)),
                "_range": F.greatest(high - low, F.abs(high - F.col("_before")), F.abs(low - F.col("_before"))),
                "stoch_k": 100 * F.try_divide(close - F.col("_low"), F.col("_high") - F.col("_low")),
                "_ret": F.try_divide(close, F.col("_before")) - 1,
                "roc": F.try_divide(close, F.col("_before10")) - 1,
                "volume_ratio": F.try_divide(F.col("volume"), F.col("volume_sma")),
                "bb_middle": F.col("sma_20"),
                "bb_upper": F.col("sma_20") + 2.0 * F.col("_std"),
                "bb_lower": F.col("sma_20") - 2.0 * F.col("_std"),
            }
        )
        d = d.withColumns(
            {
                "macd_signal": mean("macd", 9, w),
                "_gain": strict(F.avg, F.col("_up"), 14, w),
                "_loss": strict(F.avg, F.col("_down"), 14, w),
                "atr": strict(F.avg, F.col("_range"), 14, w),
                "stoch_d": strict(F.avg, F.col("stoch_k"), 3, w),
                "volatility": strict(F.stddev_samp, F.col("_ret"), 20, w),
            }
        )
        index = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_gain"), F.col("_loss")))
        return d.withColumns(
            {
                "macd_hist": F.col("macd") - F.col("macd_signal"),
                "rsi": F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0).otherwise(index),
                "bb_width": F.col("bb_upper") - F.col("bb_lower"),
            }
        )

    out = over_blocks(bars, build, by=by, step_seconds=step_seconds, halo=_MACD_HALO, rows=_MACD_ROWS)
    return out.select(*bars.columns, *INDICATORS)
