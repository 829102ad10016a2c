"""Feature selection inside each training window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.models.design import Design
from barloom.models.gram import gram, matrix, running_gram, vectors
from barloom.models.windows import END, Cutter, pick


def window_scores(rows: DataFrame, design: Design, windows: DataFrame, cutter: Cutter) -> DataFrame:
    """(by, fold, pos, feature, score): univariate F scores against the mean of the targets, per training window."""
    by = list(design.by)
    cols = design.columns
    size = 1 + len(cols)
    n_targets = len(design.targets)
    features = list(design.features)
    sums = gram(vectors(cutter.cut(rows, windows, by), cols, [*by, "piece"]), [*by, "piece"], size)
    ends = cutter.places(windows, by).filter(F.col("slot") == END)
    at_end = pick(running_gram(sums, by), ends, by)
    keys = [*by, "fold"]
    schema = T.StructType(
        [at_end.schema[k] for k in keys]
        + [T.StructField("pos", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        g = matrix(pdf, size)
        n = g[0, 0]
        y = np.zeros(size)
        y[1 : 1 + n_targets] = 1 / n_targets
        mean = g[0] / n
        centred = g - n * np.outer(mean, mean)
        cov, var, var_y = centred @ y, np.diag(centred), y @ centred @ y
        usable = (var > 1e-12 * np.maximum(np.diag(g), 1e-300)) & (var_y > 0)
        r2 = np.where(usable, cov**2 / np.where(usable, var * var_y, 1.0), np.nan)
        value = np.clip(r2, 0, 1 - 1e-15) / (1 - np.clip(r2, 0, 1 - 1e-15)) * (n - 2)
        out = pd.DataFrame({"pos": range(len(features)), "feature": features, "score": value[1 + n_targets :]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "pos", "feature", "score"]]

    return at_end.groupBy(*keys).applyInPandas(score, schema).withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def select_features(scores: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, selected): the k best features of each window in column order."""
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col("pos").desc())
    top = scores.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature"))), lambda s: s["feature"]).alias("selected")
    )


def chosen_anywhere(selected: DataFrame, features: Sequence[str]) -> list[str]:
    """Features chosen in at least one window, in column order; the list is bounded by the number of columns."""
    names = {r["feature"] for r in selected.select(F.explode("selected").alias("feature")).distinct().collect()}
    return [f for f in features if f in names]
