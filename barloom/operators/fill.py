"""Forward fill, backward fill and positional interpolation of long series.

Each block fills itself with a window. What lies outside the block comes from a table with one row per block: the
last and first known value of each column, carried over the blocks of the series and joined back. For bars that table is
bounded by the calendar, like the table of chunk sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import BLOCK, HALO, POS, block_window, number_rows, to_blocks


def _with_neighbours(
    df: DataFrame, cols: Sequence[str], by: Sequence[str], order: str, step_seconds: int, positions: bool, how: str
) -> DataFrame:
    """Add, per column, the nearest known value (and its position) at or before and at or after each row."""
    by = list(by)
    back, ahead = how in ("forward", "both"), how in ("backward", "both")
    numbered = df if POS in df.columns else number_rows(df, by=by, order=order, step_seconds=step_seconds)
    blocked = to_blocks(numbered).drop(HALO)
    keys = [*by, BLOCK]

    ends: list[Column] = []
    for i, c in enumerate(cols):
        known = F.when(F.col(f"`{c}`").isNotNull(), F.col(POS))
        if back:
            ends += [F.max_by(F.col(f"`{c}`"), known).alias(f"_lv{i}"), F.max(known).alias(f"_lp{i}")]
        if ahead:
            ends += [F.min_by(F.col(f"`{c}`"), known).alias(f"_fv{i}"), F.min(known).alias(f"_fp{i}")]
    summary = blocked.groupBy(*keys).agg(*ends)
    series = Window.partitionBy(*by).orderBy(BLOCK)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in the opposite order: a frame open to the end is rebuilt for every row
    after = Window.partitionBy(*by).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    for i in range(len(cols)):
        if back:
            carried += [F.last(f"_l{k}{i}", ignorenulls=True).over(before).alias(f"_cl{k}{i}") for k in "vp"]
        if ahead:
            carried += [F.last(f"_f{k}{i}", ignorenulls=True).over(after).alias(f"_cf{k}{i}") for k in "vp"]
    carry = summary.select(*keys, *carried)

    w = block_window(by)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*by, BLOCK).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local: list[Column] = []
    for i, c in enumerate(cols):
        value = F.col(f"`{c}`")
        known = F.when(value.isNotNull(), F.col(POS))
        if back:
            local.append(F.last(value, ignorenulls=True).over(upto).alias(f"_pv{i}"))
            if positions:
                local.append(F.last(known, ignorenulls=True).over(upto).alias(f"_pp{i}"))
        if ahead:
            local.append(F.last(value, ignorenulls=True).over(onward).alias(f"_nv{i}"))
            if positions:
                local.append(F.last(known, ignorenulls=True).over(onward).alias(f"_np{i}"))
    return blocked.select("*", *local).join(carry, keys)


def _plain(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (POS, BLOCK, HALO)]


def fill_rows(
    df: DataFrame,
    cols: Sequence[str],
    *,
    by: Sequence[str] = (),
    order: str = "ts",
    step_seconds: int,
    how: str = "both",
) -> DataFrame:
    """Fill missing values from the last known one (`forward`), the next one (`backward`), or in that order (`both`)."""
    if how not in ("forward", "backward", "both"):
        raise ValueError(f"unknown fill {how!r}")
    near = _with_neighbours(df, cols, by, order, step_seconds, positions=False, how=how)
    index = {c: i for i, c in enumerate(cols)}

    def filled(c: str) -> Column:
        if c not in index:
            return F.col(f"`{c}`")
        i = index[c]
        previous = [F.col(f"_pv{i}"), F.col(f"_clv{i}")] if how != "backward" else []
        following = [F.col(f"_nv{i}"), F.col(f"_cfv{i}")] if how != "forward" else []
        return F.coalesce(*previous, *following).alias(c)

    extra = [POS] if POS in df.columns else []
    return near.select(*[filled(c) for c in _plain(df)], *extra)


def interpolate_rows(
    df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = (), order: str = "ts", step_seconds: int
) -> DataFrame:
    """Linear interpolation by row position; before the first and after the last value the nearest one holds."""
    near = _with_neighbours(df, cols, by, order, step_seconds, positions=True, how="both")
    index = {c: i for i, c in enumerate(cols)}

    def filled(c: str) -> Column:
        if c not in index:
            return F.col(f"`{c}`")
        i = index[c]
        left, right = F.coalesce(f"_pv{i}", f"_clv{i}"), F.coalesce(f"_nv{i}", f"_cfv{i}")
        left_at, right_at = F.coalesce(f"_pp{i}", f"_clp{i}"), F.coalesce(f"_np{i}", f"_cfp{i}")
        slope = F.try_divide(right - left, (right_at - left_at).cast("double"))
        inside = left + slope * (F.col(POS) - left_at)
        return F.coalesce(F.col(f"`{c}`"), inside, left, right).alias(c)

    extra = [POS] if POS in df.columns else []
    return near.select(*[filled(c) for c in _plain(df)], *extra)


def fill_panel(panel: DataFrame, cols: Sequence[str], *, step_seconds: int, how: str = "both") -> DataFrame:
    """Fill all columns of a wide panel, `how` as in `fill_rows` or `linear`; the result has positions.

    The panel is filled in long form, one series per column, so the plan stays the same for ten columns or hundreds.
    """
    numbered = number_rows(panel.select("ts", *[F.col(f"`{c}`") for c in cols]), step_seconds=step_seconds)
    values = F.expr("array(" + ", ".join(f"`{c}`" for c in cols) + ")")
    long = numbered.select("ts", POS, F.posexplode(values).alias("place", "value"))
    if how == "linear":
        filled = interpolate_rows(long, ["value"], by=["place"], step_seconds=step_seconds)
    else:
        filled = fill_rows(long, ["value"], by=["place"], step_seconds=step_seconds, how=how)
    # every time has a row for every column, so a sorted list puts each value back into its place
    rows = filled.groupBy("ts", POS).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_row"))
    return rows.select("ts", POS, *[F.expr(f"_row[{i}].value AS `{c}`") for i, c in enumerate(cols)])
