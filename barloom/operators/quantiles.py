"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here the values are counted first,
cut into slices at approximate quantiles, and only the slices that hold a wanted rank are looked at row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.facts import join_facts
from barloom.session import written

_SLICES = 128


def exact_quantiles(df: DataFrame, *, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per group with `q` = array of linearly interpolated quantiles, and the group's size `n`."""
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    counted = written(counted, "values")
    cuts = counted.groupBy(*by).agg(
        F.percentile_approx("_v", [i / _SLICES for i in range(1, _SLICES)], 4 * _SLICES).alias("_cuts")
    )
    # the slice of a value is the number of cuts below it
    sliced = join_facts(counted, cuts, by).withColumn(
        "_slice", F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col("_v")).cast("int"))
    ).drop("_cuts")
    series = Window.partitionBy(*by)
    slices = sliced.groupBy(*by, "_slice").agg(F.sum("_c").alias("_rows"))
    slices = slices.withColumn(
        "_upto", F.sum("_rows").over(series.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_n", F.sum("_rows").over(series))
    # ranks are 0-based; each probability needs the ranks around p * (n - 1)
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    wanted = (
        slices.withColumn("_from", F.col("_upto") - F.col("_rows"))
        .select(*by, "_slice", "_from", "_upto", "_n", spot.alias("_q"))
        .withColumn("_at", F.col("_q.p") * (F.col("_n") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
        .filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
        .select(*by, "_slice", "_from", "_n", "_at", "_rank", F.col("_q.i").alias("_i"))
    )
    touched = wanted.select(*by, "_slice", "_from").distinct()
    inside = Window.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(touched, [*by, "_slice"]).withColumn("_end", F.col("_from") + F.sum("_c").over(inside)).select(
        *by, "_slice", "_v", (F.col("_end") - F.col("_c")).alias("_lo"), F.col("_end").alias("_hi")
    )
    hit = wanted.drop("_from").join(ranked, [*by, "_slice"]).filter(
        (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    )
    lower = F.min_by("_v", "_rank")
    upper = F.max_by("_v", "_rank")
    part = F.first(F.col("_at") - F.floor("_at"))
    each = hit.groupBy(*by, "_i", "_n").agg((lower + (upper - lower) * part).alias("_x"))
    return each.groupBy(*by, F.col("_n").alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("q")
    )


def box_statistics(df: DataFrame, *, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 interquartile ranges; the values are written once for both passes."""
    df = written(df.select(*by, value), "values")
    q = exact_quantiles(df, by=by, value=value, probs=[0.25, 0.5, 0.75]).select(
        *by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return join_facts(df, q, by).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
