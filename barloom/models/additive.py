"""Trend with changepoints, yearly and weekly seasons and regressors, as one penalised regression.

A changepoint adds the column max(t - c, 0). Its sums of products follow from the running sums of (1, t, other
columns) at c and at the end of the window, so neither folds nor changepoints add a pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.models.design import Design
from barloom.models.gram import dot, gram, matrix, per_window, running_gram
from barloom.models.windows import END, VALID, Cutter, pick
from barloom.operators.blocks import POS

# Season lengths in days and numbers of waves, prior scales.
SEASONS = [(365.25, 10), (7.0, 3)]
CHANGEPOINT_SCALE = 0.05
WEIGHT_SCALE = 10.0
TREND_SCALE = 5.0
REGRESSORS = 10
T_UNIT = 1000.0  # rows per unit of t


def seasonal(ts: str = "ts") -> list[Column]:
    days = F.unix_micros(F.col(ts).cast("timestamp")) / 86400e6
    out = []
    for length, waves in SEASONS:
        for k in range(1, waves + 1):
            angle = days * (2 * math.pi * k / length)
            out += [F.sin(angle), F.cos(angle)]
    return out


N_SEASONAL = 2 * sum(waves for _, waves in SEASONS)


def base_vector(position: Column, regressors: Sequence[str]) -> Column:
    """[1, t, seasons..., regressors...]"""
    t = position.cast("double") / T_UNIT
    return F.array(F.lit(1.0), t, *seasonal(), *[F.col(f"`{r}`").cast("double") for r in regressors])


def penalised_trend(end: np.ndarray, cuts: list[tuple[float, np.ndarray]], n_base: int, y: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base coefficients, changepoint coefficients) of one target.

    `end` are the sums over the window, `cuts` pairs of a changepoint in units of t and the sums up to it. Changepoint
    sizes have a Laplace prior, reached by reweighted ridge steps; all other weights have normal priors. Everything is
    scaled as in the usual formulation: t to [0, 1], y by its size, regressors to standard scores.
    """
    base = np.flatnonzero(used[:n_base])
    n = end[0, 0]
    size = len(base) + len(cuts)
    xx, xy = np.zeros((size, size)), np.zeros(size)
    nb = len(base)
    xx[:nb, :nb], xy[:nb] = end[np.ix_(base, base)], end[base, y]
    tails = [end - upto for _, upto in cuts]
    for j, (c, _) in enumerate(cuts):
        hinge = tails[j][1] - c * tails[j][0]
        xx[nb + j, :nb] = xx[:nb, nb + j] = hinge[base]
        xy[nb + j] = hinge[y]
        for i, (b, _) in enumerate(cuts[: j + 1]):
            both = tails[j][1, 1] - (b + c) * tails[j][0, 1] + b * c * tails[j][0, 0]
            xx[nb + j, nb + i] = xx[nb + i, nb + j] = both
    yy = end[y, y]
    # change of variables: t and hinges to the unit interval, regressors and seasons centred, y to size one
    length = max(n / T_UNIT, 1e-12)
    y_size = max(math.sqrt(yy / n), 1e-12)
    scale = np.ones(size)
    scale[1] = 1 / length
    scale[nb:] = 1 / length
    shift = np.zeros(size)
    for i in range(2, nb):
        if base[i] >= 2 + N_SEASONAL:
            mean = xx[0, i] / n
            deviation = math.sqrt(max(xx[i, i] / n - mean**2, 0.0))
            if deviation > 1e-9 * max(abs(mean), 1e-300):
                scale[i], shift[i] = 1 / deviation, -mean / deviation
    change = np.diag(scale)
    change[:, 0] += shift
    a, b = change @ xx @ change.T, change @ xy / y_size
    total = yy / y_size**2
    prior = np.full(size, 1 / WEIGHT_SCALE**2)
    prior[:2] = 1 / TREND_SCALE**2
    delta, noise = np.full(len(cuts), CHANGEPOINT_SCALE), 0.25
    weights = np.zeros(size)
    for _ in range(25):
        prior[nb:] = 1 / (CHANGEPOINT_SCALE * np.maximum(np.abs(delta), 1e-6))
        weights = np.linalg.lstsq(a / noise + np.diag(prior), b / noise, rcond=None)[0]
        delta = weights[nb:]
        noise = max((total - 2 * weights @ b + weights @ a @ weights) / n, 1e-9)
    raw = change.T @ weights * y_size
    full = np.zeros(n_base)
    full[base] = raw[:nb]
    return full, raw[nb:]


def additive_fit(rows: DataFrame, design: Design, windows: DataFrame, cutter: Cutter, selected: DataFrame | None = None) -> DataFrame:
    """(by, fold, target, coef, cuts, deltas): per window and target; windows with under two rows have none.

    `selected(by, fold, selected)` limits the regressors of a window to the first ten it names.
    """
    by = list(design.by)
    keys = [*by, "fold"]
    regressors = list(design.features) if selected is not None else list(design.features)[:REGRESSORS]
    n_base = 2 + N_SEASONAL + len(regressors)
    size = n_base + len(design.targets)
    vector = F.concat(base_vector(F.col(POS), regressors), F.array(*[F.col(c) for c in design.targets]))
    sums = gram(cutter.cut(rows, windows, by).select(*by, "piece", vector.alias("v")), [*by, "piece"], size)
    places = cutter.places(windows, by).filter(F.col("slot") != VALID)
    picked = pick(running_gram(sums, by), places, by)
    state = windows if selected is None else windows.join(selected, keys, "left")
    schema = T.StructType(
        [state.schema[k] for k in keys]
        + [T.StructField("target", T.StringType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
           T.StructField("cuts", T.ArrayType(T.DoubleType())), T.StructField("deltas", T.ArrayType(T.DoubleType()))]
    )
    targets = list(design.targets)

    def fit(pdf: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or one.empty:
            return pd.DataFrame(columns=schema.names)
        parts = {s: (p["at"].iloc[0] / T_UNIT, matrix(p, size)) for s, p in pdf.groupby("slot")}
        end = parts[END][1]
        if end[0, 0] < 2:
            return pd.DataFrame(columns=schema.names)
        cuts = [parts[s] for s in sorted(parts) if s >= 0]
        used = np.ones(n_base, dtype=bool)
        if "selected" in one.columns and one["selected"].iloc[0] is not None:
            first = list(one["selected"].iloc[0])[:REGRESSORS]
            used[2 + N_SEASONAL :] = [r in first for r in regressors]
        head = {k: one[k].iloc[0] for k in keys}
        out = []
        for i, t in enumerate(targets):
            coef, deltas = penalised_trend(end, cuts, n_base, n_base + i, used)
            out.append(head | {"target": t, "coef": coef.tolist(), "cuts": [c for c, _ in cuts], "deltas": deltas.tolist()})
        return pd.DataFrame(out)[schema.names]

    return per_window(picked, state, keys, fit, schema)


def additive_forecast(models: DataFrame, future: DataFrame, design: Design, *, selected: bool = False) -> DataFrame:
    """(by, fold, model, target, k, ts, yhat) for rows with positions, times and regressors."""
    keys = [*design.by, "fold"]
    regressors = list(design.features) if selected else list(design.features)[:REGRESSORS]
    rows = future.select(*keys, "ts", "k", F.col(POS), base_vector(F.col(POS), regressors).alias("_x"))
    t = F.col(POS).cast("double") / T_UNIT
    bends = F.aggregate(
        F.zip_with("cuts", "deltas", lambda c, d: F.greatest(t - c, F.lit(0.0)) * d), F.lit(0.0), lambda acc, x: acc + x
    )
    yhat = dot(F.col("coef"), F.col("_x")) + bends
    return rows.join(models, keys).select(*keys, F.lit("additive").alias("model"), "target", "k", "ts", yhat.alias("yhat"))
