"""Forecast panels: one row per model, target and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_panel(
    forecasts: Sequence[DataFrame], *, models: Sequence[str], targets: Sequence[str], steps: int, series: DataFrame, by: Sequence[str]
) -> DataFrame:
    """The forecasts of all models on the full grid; what a model did not forecast is NULL.

    `series` has one row per series; models and targets are lists of names, so the grid is as large as the answer.
    """
    stacked = forecasts[0]
    for f in forecasts[1:]:
        stacked = stacked.unionByName(f)
    keys = [*by, "model", "target", "step"]
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("target")) for m in models for c in targets])
    grid = series.select(*by, F.inline(pairs)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return grid.join(stacked.select(*keys, "yhat"), keys, "left")
