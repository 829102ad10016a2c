"""Joins on time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import cells_where
from barloom.operators.blocks import over_blocks
from barloom.operators.facts import BROADCAST_FACTS, join_facts
from barloom.session import written


def wide_panel(bars: DataFrame, symbols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Outer merge of all symbols on time: one row per timestamp, one column per symbol and feature, one shuffle."""
    wanted = bars.filter(F.col("symbol").isin(list(symbols)))
    return wanted.groupBy("ts").agg(*cells_where("symbol", symbols, features))


def merge_frames(frames: Sequence[DataFrame], on: str = "ts") -> DataFrame:
    """Outer merge of frames with distinct columns and unique times: a union and one aggregation, not N-1 joins."""
    columns = [c for f in frames for c in f.columns if c != on]
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    return merged.groupBy(on).agg(*[F.max(f"`{c}`").alias(c) for c in columns])


def melt_panel(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Wide panel to (ts, symbol, feature, value), names split at the first underscore."""
    long = panel.unpivot("ts", [F.col(f"`{c}`") for c in cols], "name", "value")
    return long.select(
        "ts",
        F.regexp_extract("name", "^([^_]*)_(.*)$", 1).alias("symbol"),
        F.regexp_extract("name", "^([^_]*)_(.*)$", 2).alias("feature"),
        "value",
    )


def reindex_columns(df: DataFrame, keys: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Columns in the wanted order; those that do not exist become NULL."""
    have = set(df.columns)
    return df.select(
        *keys, *[(F.col(f"`{c}`") if c in have else F.lit(None).cast("double")).alias(c) for c in wanted]
    )


def align_actual(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of actual and predicted values at the same keys, incomplete pairs dropped."""
    return actual.join(predicted, list(keys), "inner").dropna(subset=["actual", "predicted"])


def calendar_reindex(
    df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = ("symbol",), step_seconds: int, step: str = "1 DAY"
) -> DataFrame:
    """Insert each missing step between the first and last row of a series, holding the values before it.

    Every row brings along the empty steps since the row before it, so the inserted rows arise where the data is and
    no calendar has to be built per series.
    """

    def build(d: DataFrame, w) -> DataFrame:
        before = F.lag(F.struct("ts", *cols)).over(w)
        return d.withColumn("_before", before)

    linked = over_blocks(df, build, by=by, step_seconds=step_seconds, halo=1)
    first_gap = F.col("_before.ts") + F.expr(f"INTERVAL {step}")
    last_gap = F.col("ts") - F.expr(f"INTERVAL {step}")
    none = F.array().cast("array<timestamp_ntz>")
    gaps = F.when(first_gap <= last_gap, F.sequence(first_gap, last_gap, F.expr(f"INTERVAL {step}"))).otherwise(none)
    held = F.transform(
        F.coalesce(gaps, none),
        lambda t: F.struct(t.alias("ts"), *[F.col(f"_before.{c}").alias(c) for c in cols]),
    )
    rows = F.concat(held, F.array(F.struct("ts", *cols)))
    return linked.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.ts", *[f"_row.{c}" for c in cols])


def nearest_rows(
    probes: DataFrame, bars: DataFrame, cols: Sequence[str], *, by: Sequence[str] = ("symbol",), step_seconds: int
) -> DataFrame:
    """For each probe time the bar nearest in time, the earlier one on a tie; NULL without a time or without bars.

    Bars of a series are kept in arrays of ASOF_ROWS bar widths (`step_seconds`), each with the last bar before and the first one
    after it; a gap in the calendar holds just these two. A probe meets the one array of its time and is searched there, so no
    window runs over probes, and any number of them may fall into one bar.
    """
    by = list(by)
    arrays = written(_candidates(bars, cols, by, step_seconds), "candidates")
    ends = arrays.groupBy(*by).agg(F.min("_chunk").alias("_from"), F.max("_chunk").alias("_to"))
    few = (arrays.agg(F.sum(F.size("_bars"))).first()[0] or 0) <= BROADCAST_FACTS
    at = F.greatest(F.least(_asof_chunk("ts", step_seconds), F.col("_to")), F.col("_from"))
    placed = join_facts(probes, ends, by, how="left").withColumn("_chunk", at).drop("_from", "_to")
    met = join_facts(placed, arrays, [*by, "_chunk"], limit=BROADCAST_FACTS if few else 0, how="left")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    nearest = F.array_min(F.transform("_bars", lambda b: F.struct(F.abs(b["us"] - micros).alias("gap"), b.alias("bar"))))["bar"]
    best = met.withColumn("_best", F.when(F.col("ts").isNotNull(), nearest))
    return best.select(*probes.columns, "_best.bar_ts", *[f"_best.{c}" for c in cols])


ASOF_ROWS = 64


def _asof_chunk(ts: str, step_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(step_seconds * ASOF_ROWS)).cast("long")


def _candidates(bars: DataFrame, cols: Sequence[str], by: Sequence[str], step_seconds: int) -> DataFrame:
    """(by, _chunk, _bars): every stretch of the calendar between a series' first and last bar with the bars to search for it."""
    bar = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").alias("bar_ts"), *cols)
    keys = [*by, "_chunk"]
    own = bars.filter(F.col("ts").isNotNull()).withColumn("_chunk", _asof_chunk("ts", step_seconds))
    own = own.groupBy(*keys).agg(F.array_sort(F.collect_list(bar)).alias("_own"))
    series = Window.partitionBy(*by).orderBy("_chunk")
    before, after = F.lag(F.element_at("_own", -1)).over(series), F.lead(F.element_at("_own", 1)).over(series)
    linked = own.select(*keys, "_own", before.alias("_b"), after.alias("_a"), F.lead("_chunk").over(series).alias("_next"))
    present = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    full = F.struct(F.col("_chunk"), F.concat(present(F.col("_b")), F.col("_own"), present(F.col("_a"))).alias("_bars"))
    gap = F.when(F.col("_next") > F.col("_chunk") + 1, F.sequence(F.col("_chunk") + 1, F.col("_next") - 1)).otherwise(F.array().cast("array<bigint>"))
    between = F.transform(gap, lambda c: F.struct(c.alias("_chunk"), present(F.element_at("_own", -1), F.col("_a")).alias("_bars")))
    return linked.select(*by, F.inline(F.concat(F.array(full), between)))


def forecast_times(last: DataFrame, *, steps: int, step_seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Step numbers and times after the last time of each series."""
    step = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    return last.select(*keys, "last_ts", step).withColumn(
        "ts", F.timestamp_add("SECOND", F.col("step") * step_seconds, F.col("last_ts"))
    ).select(*keys, "step", "ts")
