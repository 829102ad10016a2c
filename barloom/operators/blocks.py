"""Row positions and blocks: windows over a long series without one task per series.

A window partitioned by symbol puts a whole series into one task. Here every series is cut into blocks of
consecutive rows and a window is partitioned by (symbol, block). Each block also receives copies of the `halo` rows
before it, so a frame that looks back at most `halo` rows sees exactly what it would see over the whole series.

Positions come in two steps: rows are numbered inside calendar chunks of a fixed time span, and the chunk sizes are
summed up per series. A bar series has at most one row per bar width, so a chunk never holds more than CHUNK_ROWS
rows, and the table of chunk sizes is bounded by the calendar: 200 years of one-minute bars make 25,677 rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

POS = "_pos"
BLOCK = "_block"
HALO = "_halo"
CHUNK_ROWS = 4096
BLOCK_ROWS = 4096


def chunk_of(order: str, step_seconds: int) -> Column:
    """The calendar chunk a bar falls into."""
    seconds = F.unix_seconds(F.col(order).cast("timestamp"))
    return F.floor(seconds / F.lit(step_seconds * CHUNK_ROWS)).cast("long")


def number_rows(
    df: DataFrame, *, by: Sequence[str] = (), order: str = "ts", step_seconds: int
) -> DataFrame:
    """Add `_pos`, the exact 1-based position of each row in its series; (by, order) must be unique."""
    by = list(by)
    keys = [*by, "_chunk"]
    chunked = df.withColumn("_chunk", chunk_of(order, step_seconds))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys).orderBy(order)
    return (
        chunked.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(POS, F.col("_before") + F.col("_rank"))
        .drop("_chunk", "_rank", "_before")
    )


def calendar_pos(order: str, step_seconds: int) -> Column:
    """Positions of a series without gaps in time: the number of its step since 1970."""
    seconds = F.unix_seconds(F.col(order).cast("timestamp"))
    return F.floor(seconds / F.lit(step_seconds)).cast("long") + 1


def to_blocks(numbered: DataFrame, *, halo: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `_block` and `_halo`; a row is copied into each later block that starts within `halo` rows after it."""
    own = F.floor((F.col(POS) - 1) / rows).cast("long")
    if halo == 0:
        return numbered.withColumn(BLOCK, own).withColumn(HALO, F.lit(False))
    reach = F.floor((F.col(POS) - 1 + halo) / rows).cast("long")
    return numbered.withColumn(BLOCK, F.explode(F.sequence(own, reach))).withColumn(HALO, F.col(BLOCK) != own)


def block_window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by, BLOCK).orderBy(POS)


def over_blocks(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    by: Sequence[str] = ("symbol",),
    order: str = "ts",
    step_seconds: int,
    halo: int,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run `build(df, window)` over blocks with a halo and drop the copied rows afterwards.

    A frame that already has `_pos` keeps it: numbered once, it can pass through any number of operators. Its
    positions must be consecutive within each series of `by`; where they start does not matter.
    """
    known = POS in df.columns
    numbered = df if known else number_rows(df, by=by, order=order, step_seconds=step_seconds)
    built = build(to_blocks(numbered, halo=halo, rows=rows), block_window(by))
    out = built.filter(~F.col(HALO)).drop(BLOCK, HALO)
    return out if known else out.drop(POS)
