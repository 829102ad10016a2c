"""Exponentially weighted means as one cumulative sum per block.

With d = 1 - alpha the mean at row i is a ratio of sums of d^(i-j). Scaling by d^(-position in block) turns both sums
into running sums, which need no row-by-row recursion. The scale stays finite because a block is at most `block_rows`
long, and rows further back than `reach` weigh less than 1e-17, so a halo of that length makes the result equal to the
one over the whole series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.operators.blocks import BLOCK, BLOCK_ROWS, POS, number_rows, over_blocks
from barloom.operators.fill import fill_rows

_LOG_SCALE_LIMIT = 600.0  # e^600 leaves room for values up to 1e40 in a double


def alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def reach(span: int) -> int:
    """Rows after which an old value weighs less than 1e-17."""
    decay = 1.0 - alpha(span)
    return 0 if decay == 0 else math.ceil(17 * math.log(10) / -math.log(decay))


def block_rows(spans: list[int], halo: int) -> int:
    """Longest block whose scale factors fit a double for all spans."""
    steepest = max((-math.log(1.0 - alpha(s)) for s in spans if s > 1), default=1.0)
    room = int(_LOG_SCALE_LIMIT / steepest) - halo
    return max(64, min(BLOCK_ROWS, room))


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ewm_adjusted(x: Column, span: int, w: WindowSpec, rows: int, halo: int) -> Column:
    """Weighted mean with weights d^k over the values seen so far; a missing value decays the others."""
    decay = 1.0 - alpha(span)
    if decay == 0:
        return x
    offset = F.col(POS) - F.col(BLOCK) * rows + halo
    weight = F.when(x.isNotNull(), F.pow(F.lit(decay), -offset))
    return F.try_divide(F.sum(x * weight).over(_running(w)), F.sum(weight).over(_running(w)))


def add_ewm_recursive(df: DataFrame, source: str, name: str, span: int, w: WindowSpec) -> DataFrame:
    """y = a*x + (1-a)*y_prev from the first value; after a gap the weights are renormalised."""
    a = alpha(span)
    decay = 1.0 - a
    x = F.col(source)
    if decay == 0:
        return df.withColumn(name, x)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    keep = F.pow(F.lit(decay), F.col(POS) - F.col("_seen"))
    return (
        df.withColumn("_seen", F.last(F.when(x.isNotNull(), F.col(POS)), ignorenulls=True).over(earlier))
        .withColumn("_log", F.when(x.isNull() | F.col("_seen").isNull(), 0.0).otherwise(F.log(keep) - F.log(keep + a)))
        .withColumn("_cum", F.sum("_log").over(_running(w)))
        .withColumn("_new", F.when(F.col("_seen").isNull(), 1.0).otherwise(1.0 - F.exp("_log")))
        .withColumn(name, F.exp("_cum") * F.sum(x * F.col("_new") * F.exp(-F.col("_cum"))).over(_running(w)))
        .drop("_seen", "_log", "_cum", "_new")
    )


def ewm(
    df: DataFrame,
    source: str,
    name: str,
    *,
    span: int,
    adjust: bool = True,
    by: tuple[str, ...] = ("symbol",),
    order: str = "ts",
    step_seconds: int,
    gaps: bool = True,
) -> DataFrame:
    """Add the exponentially weighted mean of a column.

    `gaps=False` is for columns without missing values. With gaps, a run of missing values longer than the halo
    keeps the mean of the last value before it, however far back that is.
    """
    halo = reach(span)
    rows = block_rows([span], halo)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        if adjust:
            return d.withColumn(name, ewm_adjusted(F.col(source), span, w, rows, halo))
        return add_ewm_recursive(d, source, name, span, w)

    if not gaps:
        return over_blocks(df, build, by=by, order=order, step_seconds=step_seconds, halo=halo, rows=rows)
    given = POS in df.columns
    numbered = df if given else number_rows(df, by=by, order=order, step_seconds=step_seconds)
    out = over_blocks(numbered, build, by=by, step_seconds=step_seconds, halo=halo, rows=rows)
    known = out.withColumn(name, F.when(F.col(source).isNotNull(), F.col(name)))
    filled = fill_rows(known, [name], by=by, step_seconds=step_seconds, how="forward")
    return filled if given else filled.drop(POS)
