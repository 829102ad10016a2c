"""Walk-forward backtest of all models: selection, fits, forecasts and errors per fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.models import additive, linear
from barloom.models.design import Design
from barloom.models.selection import chosen_anywhere, select_features, window_scores
from barloom.models.windows import Cutter, Folds, Holdout
from barloom.operators.blocks import POS
from barloom.operators.metrics import evaluate, with_failed
from barloom.session import written

MODELS = ("arimax", "var", "additive", "sequence")


@dataclass(frozen=True)
class Result:
    predictions: DataFrame  # (by, fold, model, target, ts, k, actual, predicted)
    selected: DataFrame  # (by, fold, selected)
    windows: DataFrame  # (by, fold, train_rows)
    targets: tuple[str, ...]
    models: tuple[str, ...] = MODELS

    def metrics(self, by: Sequence[str] = (), *, step_seconds: int) -> DataFrame:
        """Errors per fold, model and target; rows of a test window are numbered already.

        Every fold has a row for every model and target. Where a model could not be fitted or gave no value, n is 0 and the errors
        are NULL.
        """
        keys = [*by, "fold"]
        pairs = self.predictions.withColumn(POS, F.col("k"))
        found = evaluate(pairs, by=[*keys, "model", "target"], step_seconds=step_seconds)
        return with_failed(found, self.windows, self.models, self.targets, keys)


def fit_all(
    rows: DataFrame, design: Design, windows: DataFrame, cutter: Cutter, selected: DataFrame, *, var_limit: int, sequence_steps: int,
    models: Sequence[str] = MODELS,
) -> dict[str, DataFrame]:
    """The fitted table of each model for all windows; the three lagged models share one table of sums."""
    keys = [*design.by, "fold"]
    out = {}
    if set(models) - {"additive"}:
        lags = max(linear.ARMA_LAGS, sequence_steps if "sequence" in models else 0)
        sums, ends = linear.lagged_sums(rows, design, windows, lags, cutter, validation="sequence" in models)
        sums, ends = written(sums, "lagged-sums"), written(ends.join(selected, keys, "left"), "window-ends")
    if "arimax" in models:
        out["arimax"] = linear.arimax_fit(sums, ends, design)
    if "var" in models:
        out["var"] = linear.var_fit(sums, ends, design, limit=var_limit)
    if "additive" in models:
        out["additive"] = additive.additive_fit(rows, design, windows, cutter, selected)
    if "sequence" in models:
        scalers = linear.window_scalers(rows, design, windows, cutter)
        fitted = linear.sequence_fit(sums, ends.join(scalers, keys), design, sequence_steps)
        out["sequence"] = fitted.join(scalers, keys)
    return out


def forecast_tests(
    fitted: dict[str, DataFrame], rows: DataFrame, design: Design, windows: DataFrame, cutter: Folds | Holdout, *, steps: int, sequence_steps: int
) -> DataFrame:
    """(by, fold, model, target, ts, k, actual, predicted) of all test rows, with the regressors that they had; no value, no row."""
    by, keys = list(design.by), [*design.by, "fold"]
    tests = cutter.tests(rows, windows, by)
    forecasts = []
    if "arimax" in fitted:
        forecasts.append(linear.arimax_forecast(fitted["arimax"], tests, design).drop("ts"))
    if "var" in fitted:
        forecasts.append(linear.var_forecast(fitted["var"], design, steps=steps))
    if "additive" in fitted:
        forecasts.append(additive.additive_forecast(fitted["additive"], tests, design, selected=True).drop("ts"))
    if "sequence" in fitted:
        sequences = cutter.tests(linear.feature_sequences(rows, design, sequence_steps, by=by), windows, by)
        forecasts.append(linear.sequence_forecast(fitted["sequence"], sequences, design).drop("ts"))
    stacked = forecasts[0]
    for f in forecasts[1:]:
        stacked = stacked.unionByName(f)
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual")) for t in design.targets])
    actual = tests.select(*keys, "ts", "k", F.inline(cells))
    pairs = actual.join(stacked, [*keys, "target", "k"]).withColumnRenamed("yhat", "predicted")
    return pairs.dropna(subset=["actual", "predicted"])


def backtest(
    rows: DataFrame, design: Design, folds: Folds, *, top_k: int, var_limit: int, sequence_steps: int,
    models: Sequence[str] = MODELS,
) -> Result:
    """Fit every model on every growing window and predict the rows after it.

    Each model reads the table once, however many folds there are. The table and the selection are written out first,
    since every model starts from them.
    """
    by, keys = list(design.by), [*design.by, "fold"]
    rows = written(rows, "training")
    windows = folds.windows(rows, by)
    selected = written(select_features(window_scores(rows, design, windows, folds), keys, top_k), "selected")
    chosen = design.with_features(chosen_anywhere(selected, design.features))
    fitted = fit_all(rows, chosen, windows, folds, selected, var_limit=var_limit, sequence_steps=sequence_steps, models=models)
    pairs = forecast_tests(fitted, rows, chosen, windows, folds, steps=folds.test, sequence_steps=sequence_steps)
    return Result(pairs, selected, windows, tuple(design.targets), tuple(models))
