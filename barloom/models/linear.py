"""ARMA-error regression, vector autoregression and sequence regression from lagged sums of products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import columns_with
from barloom.models.design import Design
from barloom.models.gram import dot, finite_or_none, lag_vectors, per_window, solve
from barloom.models.lagsums import lagged_sums, last_vector, window_gram
from barloom.models.windows import END, VALID, Cutter

LONG_AR = 5  # order of the autoregression that stands in for the unseen errors
PHI_BOUND = 0.999  # largest size of the first error coefficient
ARMA_LAGS = LONG_AR + 1
VAR_MAX_LAGS = 5
RIDGES = [1e-8, 1e-6, 1e-4, 1e-3, 1e-2, 1e-1, 1.0]


class Layout:
    """Where a column sits in a lag vector."""

    def __init__(self, design: Design, lags: int) -> None:
        self.design, self.lags = design, lags
        self.index = {c: i for i, c in enumerate(design.columns)}

    def at(self, column: str, lag: int) -> int:
        return 1 + (self.lags - lag) * len(self.index) + self.index[column]

    def many(self, columns: Sequence[str], lag: int) -> list[int]:
        return [self.at(c, lag) for c in columns]


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _features_of(end: pd.DataFrame, design: Design) -> list[str]:
    """The features selected for a window, all of them where no selection is given."""
    if "selected" not in end.columns or end["selected"].iloc[0] is None:
        return list(design.features)
    chosen = set(end["selected"].iloc[0])
    return [f for f in design.features if f in chosen]


# --- regression with ARMA(1,1) errors -------------------------------------------------------------------------------


def arma_regression(g: np.ndarray, last: np.ndarray, layout: Layout, target: str, features: list[str]) -> dict:
    """Three regressions in a row on one table of sums: y on x, residuals on their lags, residuals on (u, e) before.

    Errors must die out: a phi beyond PHI_BOUND is set to the bound and theta fitted again beside it.

    The residual of a row is linear in the row's lag vector, and so is the error estimate; every sum the second and
    third regression need is therefore a quadratic form of the first one's table.
    """
    size = len(g)
    x = layout.many(features, 0)
    b = solve(g[np.ix_(x, x)], g[x, layout.at(target, 0)]) if x else np.zeros(0)
    u = np.zeros((layout.lags + 1, size))
    for lag in range(layout.lags + 1):
        u[lag, layout.at(target, lag)] = 1.0
        u[lag, layout.many(features, lag)] -= b
    uu = u @ g @ u.T
    ar = solve(uu[1 : LONG_AR + 1, 1 : LONG_AR + 1], uu[1 : LONG_AR + 1, 0])
    error = [u[k] - ar @ u[k + 1 : k + 1 + LONG_AR] for k in (0, 1)]
    pair = np.stack([u[1], error[1]])
    phi, theta = solve(pair @ g @ pair.T, pair @ g @ u[0])
    if abs(phi) > PHI_BOUND:
        phi = np.clip(phi, -PHI_BOUND, PHI_BOUND)
        (theta,) = solve(pair[1:] @ g @ pair[1:].T, pair[1:] @ g @ (u[0] - phi * pair[0]))
    full = np.zeros(len(layout.design.features))
    for f, value in zip(features, b):
        full[layout.design.features.index(f)] = value
    return {
        "target": target, "coef": full.tolist(), "phi": float(phi), "theta": float(theta),
        "u_last": float(u[0] @ last), "e_last": float(error[0] @ last), "n": int(round(g[0, 0])),
    }


def arimax_fit(sums: DataFrame, ends: DataFrame, design: Design) -> DataFrame:
    """(by, fold, target, coef, phi, theta, u_last, e_last, n, train_rows) for every window and target.

    `sums` and `ends` come from `lagged_sums` with ARMA_LAGS or more, `ends` maybe with `selected`.
    """
    keys = [*design.by, "fold"]
    layout = Layout(design, ARMA_LAGS)
    fields = _key_fields(ends, keys) + [
        T.StructField("target", T.StringType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("phi", T.DoubleType()), T.StructField("theta", T.DoubleType()), T.StructField("u_last", T.DoubleType()),
        T.StructField("e_last", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("train_rows", T.LongType()),
    ]
    schema = T.StructType(fields)

    def fit(pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or end.empty or end["train_rows"].iloc[0] <= ARMA_LAGS:
            return pd.DataFrame(columns=schema.names)
        g, last = window_gram(pdf, end, ARMA_LAGS), last_vector(end, len(design.columns), ARMA_LAGS)
        features = _features_of(end, design)
        fitted = [arma_regression(g, last, layout, t, features) for t in design.targets]
        head = {k: end[k].iloc[0] for k in [*keys, "train_rows"]}
        return pd.DataFrame([head | row for row in fitted])[schema.names]

    return per_window(sums, ends, keys, fit, schema)


def arimax_forecast(models: DataFrame, future: DataFrame, design: Design) -> DataFrame:
    """(by, fold, model, target, k, ts, yhat): regression value plus the fading ARMA error, `k` steps ahead."""
    keys = [*design.by, "fold"]
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in design.features])
    rows = future.select(*keys, "ts", "k", x.alias("_x"))
    shock = F.col("phi") * F.col("u_last") + F.col("theta") * F.col("e_last")
    yhat = dot(F.col("coef"), F.col("_x")) + F.pow(F.col("phi"), F.col("k") - 1) * shock
    return rows.join(models, keys).select(*keys, F.lit("arimax").alias("model"), "target", "k", "ts", yhat.alias("yhat"))


# --- vector autoregression ------------------------------------------------------------------------------------------


def vector_autoregression(g: np.ndarray, layout: Layout, names: list[str]) -> tuple[int, np.ndarray]:
    """(lag order, coefficients): constant and lags chosen by AIC on the rows that have all lags."""
    n, k = g[0, 0], len(names)
    now = layout.many(names, 0)
    scale = np.sqrt(np.maximum(np.diag(g)[now] / n, 1e-300))
    best: tuple[float, int, np.ndarray] | None = None
    for p in range(1, VAR_MAX_LAGS + 1):
        z = [0] + [i for lag in range(1, p + 1) for i in layout.many(names, lag)]
        b = solve(g[np.ix_(z, z)], g[np.ix_(z, now)])
        cross = g[np.ix_(z, now)].T @ b
        left = (g[np.ix_(now, now)] - cross - cross.T + b.T @ g[np.ix_(z, z)] @ b) / n / np.outer(scale, scale)
        spread = np.clip(np.linalg.eigvalsh(left), 1e-12, None)
        aic = float(np.log(spread).sum()) + 2.0 / n * (p * k * k + k)
        if best is None or aic < best[0]:
            best = (aic, p, b)
    return best[1], best[2]


def var_columns(features: Sequence[str], limit: int) -> list[str]:
    return columns_with(features, limit=limit)


def _var_of_window(g, end, design, layout, target, limit) -> tuple[list[str], int, np.ndarray]:
    names = [target, *var_columns(_features_of(end, design), limit)]
    order, b = vector_autoregression(g, layout, names)
    return names, order, b


def var_fit(sums: DataFrame, ends: DataFrame, design: Design, *, limit: int) -> DataFrame:
    """(by, fold, target, lag_order, columns, coef, system, history): one equation system per window and target.

    `coef` is the target's own equation, `system` all equations side by side, `history` the window's last rows, newest first.
    """
    keys = [*design.by, "fold"]
    layout = Layout(design, ARMA_LAGS)
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        _key_fields(ends, keys)
        + [T.StructField("target", T.StringType()), T.StructField("lag_order", T.IntegerType()),
           T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("coef", doubles),
           T.StructField("system", doubles), T.StructField("history", doubles)]
    )

    def fit(pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or end.empty or end["train_rows"].iloc[0] <= ARMA_LAGS:
            return pd.DataFrame(columns=schema.names)
        g, last = window_gram(pdf, end, ARMA_LAGS), last_vector(end, len(design.columns), ARMA_LAGS)
        head = {k: end[k].iloc[0] for k in keys}
        out = []
        for t in design.targets:
            names, order, b = _var_of_window(g, end, design, layout, t, limit)
            history = np.concatenate([last[layout.many(names, lag)] for lag in range(order)])
            out.append(head | {
                "target": t, "lag_order": order, "columns": names, "coef": b[:, 0].tolist(), "system": b.ravel().tolist(), "history": history.tolist()
            })
        return pd.DataFrame(out)[schema.names]

    return per_window(sums, ends, keys, fit, schema)


def var_forecast(models: DataFrame, design: Design, *, steps: int) -> DataFrame:
    """(by, fold, model, target, k, yhat): the stored systems run forward from their windows' last rows."""
    keys = [*design.by, "fold"]
    schema = T.StructType(
        _key_fields(models, keys)
        + [T.StructField("model", T.StringType()), T.StructField("target", T.StringType()),
           T.StructField("k", T.LongType()), T.StructField("yhat", T.DoubleType())]
    )

    def path(row) -> list[float | None]:
        order, k = row.lag_order, len(row.columns)
        b = np.asarray(row.system).reshape(-1, k)
        history = list(np.asarray(row.history).reshape(order, k))
        out = []
        for _ in range(steps):
            with np.errstate(all="ignore"):
                value = b[0] + np.concatenate(history) @ b[1:]
            history = [value, *history[:-1]]
            out.append(finite_or_none(value[0]))
        return out

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                table = pd.DataFrame({"model": "var", "target": row.target, "k": range(1, steps + 1), "yhat": path(row)})
                for name in keys:
                    table[name] = getattr(row, name)
                yield table[schema.names]

    return models.select(*keys, "target", "lag_order", "columns", "system", "history").mapInPandas(run, schema)


# --- regression on sequences ----------------------------------------------------------------------------------------


def sequence_regression(
    end_sums: np.ndarray, valid_from: np.ndarray, layout: Layout, targets: Sequence[str], features: list[str],
    low: np.ndarray, span: np.ndarray,
) -> tuple[np.ndarray, list[float]]:
    """Coefficients (1 + steps * features) x targets on scaled values, and each target's ridge, chosen on the last fifth."""
    x = [0] + [i for lag in range(layout.lags, 0, -1) for i in layout.many(features, lag)]
    y = layout.many(targets, 0)
    used = x + y
    # scaling to [0, 1] is linear in (1, value): fold it into the sums instead of the rows
    names = [None] + [f for _ in range(layout.lags) for f in features] + list(targets)
    change = np.eye(len(used))
    for row, name in enumerate(names):
        if name is not None:
            i = layout.index[name]
            change[row, row] = 1.0 / span[i]
            change[row, 0] = -low[i] / span[i]

    def scaled(g: np.ndarray) -> np.ndarray:
        return change @ g[np.ix_(used, used)] @ change.T

    whole, train = scaled(end_sums), scaled(valid_from)
    valid = whole - train
    nx = len(x)
    on_train, on_whole = _ridge_path(train, nx), _ridge_path(whole, nx)
    losses = []
    for ridge in RIDGES:
        b = on_train(ridge)
        losses.append(np.diag(valid[nx:, nx:] - 2 * b.T @ valid[:nx, nx:] + b.T @ valid[:nx, :nx] @ b))
    chosen = [RIDGES[i] for i in np.argmin(np.stack(losses), axis=0)]
    fits = {r: on_whole(r) for r in set(chosen)}
    return np.column_stack([fits[r][:, i] for i, r in enumerate(chosen)]), chosen


def _ridge_path(g: np.ndarray, nx: int):
    """Ridge solutions of one table of sums for any strength, from one decomposition.

    The intercept, the first of `nx` columns, is free: it is taken out by centring. Strengths count against columns scaled to size one.
    """
    n = max(g[0, 0], 1e-300)
    size = np.sqrt(np.clip(np.diag(g)[1:nx], 1e-300, None))
    mean = g[0] / n
    centred = (g - np.outer(g[0], mean))[1:, 1:]
    values, basis = np.linalg.eigh(centred[: nx - 1, : nx - 1] / np.outer(size, size))
    inner = basis.T @ (centred[: nx - 1, nx - 1 :] / size[:, None])
    floor = max(values.max(initial=0.0), 0.0) * 1e-11

    def fitted(ridge: float) -> np.ndarray:
        damped = values + ridge
        use = damped > floor
        slopes = (basis[:, use] @ (inner[use] / damped[use][:, None])) / size[:, None]
        return np.vstack([mean[nx:] - mean[1:nx] @ slopes, slopes])

    return fitted


def window_scalers(rows: DataFrame, design: Design, windows: DataFrame, cutter: Cutter) -> DataFrame:
    """(by, fold, low, high): smallest and largest value of every column in each training window."""
    by = list(design.by)
    cols = design.columns
    per = cutter.cut(rows, windows, by).groupBy(*by, "piece").agg(
        *[F.min(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(cols)], *[F.max(f"`{c}`").alias(f"_h{i}") for i, c in enumerate(cols)]
    )
    w = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    running = per.select(
        *by, "piece",
        F.array(*[F.min(f"_l{i}").over(w) for i in range(len(cols))]).alias("low"),
        F.array(*[F.max(f"_h{i}").over(w) for i in range(len(cols))]).alias("high"),
    )
    ends = cutter.places(windows, by).filter(F.col("slot") == END)
    return ends.join(running, [*by, "piece"]).select(*by, "fold", "low", "high")


def sequence_fit(sums: DataFrame, state: DataFrame, design: Design, steps: int) -> DataFrame:
    """(by, fold, target, intercept, coef, ridge): coefficients on raw values, oldest row of the sequence first.

    `sums` and `state` come from `lagged_sums` with `steps` lags or more and validation; `state` also has `low`, `high` and maybe
    `selected`.
    """
    keys = [*design.by, "fold"]
    layout = Layout(design, steps)
    schema = T.StructType(
        _key_fields(state, keys)
        + [T.StructField("target", T.StringType()), T.StructField("intercept", T.DoubleType()),
           T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("ridge", T.DoubleType())]
    )

    def fit(pdf: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or one.empty or one["train_rows"].iloc[0] <= steps:
            return pd.DataFrame(columns=schema.names)
        whole, train = (window_gram(pdf, one, steps, s) for s in (END, VALID))
        low, high = (np.asarray(one[c].iloc[0], dtype=float) for c in ("low", "high"))
        span = np.where(high == low, 1.0, high - low)
        features = _features_of(one, design)
        b, ridges = sequence_regression(whole, train, layout, design.targets, features, low, span)
        at = [layout.index[f] for f in features]
        head = {k: one[k].iloc[0] for k in keys}
        out = []
        for i, t in enumerate(design.targets):
            y = layout.index[t]
            grid = b[1:, i].reshape(steps, len(features)) * span[y] / span[at]
            intercept = b[0, i] * span[y] + low[y] - float((grid * low[at]).sum())
            full = np.zeros((steps, len(design.features)))
            full[:, [design.features.index(f) for f in features]] = grid
            out.append(head | {"target": t, "intercept": intercept, "coef": full.ravel().tolist(), "ridge": ridges[i]})
        return pd.DataFrame(out)[schema.names]

    return per_window(sums, state, keys, fit, schema)


def sequence_forecast(models: DataFrame, sequences: DataFrame, design: Design) -> DataFrame:
    """(by, fold, model, target, k, ts, yhat) from rows that carry the features of the rows before them as `v`."""
    keys = [*design.by, "fold"]
    yhat = F.col("intercept") + dot(F.col("coef"), F.col("v"))
    return sequences.join(models, keys).select(*keys, F.lit("sequence").alias("model"), "target", "k", "ts", yhat.alias("yhat"))


def feature_sequences(
    rows: DataFrame, design: Design, steps: int, *, by: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Rows with `v` = the features of the `steps` rows before, oldest first; positions must be consecutive in `by`."""
    lagged = lag_vectors(rows, list(design.features), steps, by=by, step_seconds=design.step_seconds, keep=keep)
    return lagged.withColumn("v", F.slice("v", 2, steps * len(design.features)))
