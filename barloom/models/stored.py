"""Trained models as one table: parameters of all four models, scalers, selected features; forecasts that fit nothing.

A stored model is one row for each series and target: `features` names the columns that its coefficients belong to, `numbers` its
parameters by name, `columns` the equations of an autoregression, `trained_to` and `train_rows` where its training ended. Horizon,
version and model are partitions, so a forecast reads its own models only, and a new version leaves the old ones alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Horizon
from barloom.models.backtest import Result, fit_all, forecast_tests
from barloom.models.design import Design
from barloom.models.forecast import Forecaster
from barloom.models.selection import chosen_anywhere, select_features, window_scores
from barloom.models.windows import Holdout
from barloom.operators.blocks import POS
from barloom.session import written
from barloom.sources.store import selected_features

#: Parameters of each model in `numbers`: single numbers and lists.
_SINGLE = {"arimax": ["phi", "theta", "u_last", "e_last"], "var": ["lag_order"], "additive": [], "sequence": ["intercept", "ridge"]}
_LISTS = {"arimax": ["coef"], "var": ["coef", "system", "history"], "additive": ["coef", "cuts", "deltas"], "sequence": ["coef", "low", "high"]}


@dataclass(frozen=True)
class Trained:
    """What training leaves: fitted tables by model, their design, the held-out errors."""

    fitted: dict[str, DataFrame]
    design: Design
    selected: DataFrame  # (by, fold, selected)
    ends: DataFrame  # (by, trained_to, train_rows)
    result: Result  # predictions of the held-out rows


def train(rows: DataFrame, design: Design, horizon: Horizon, *, share: float = 0.8) -> Trained:
    """Select features and fit all models on the first `share` of each series, and predict the rest with its own regressors.

    The held-out rows take part in nothing but the errors: scores, scalers and fits see the training rows alone. Series with no
    training row are left out; a model that cannot be fitted on a series is missing for it.
    """
    by, keys = list(design.by), [*design.by, "fold"]
    rows = written(rows, "training")
    cutter = Holdout(share=share)
    windows = written(cutter.windows(rows, by), "windows")
    selected = written(select_features(window_scores(rows, design, windows, cutter), keys, horizon.top_features), "selected")
    chosen = design.with_features(chosen_anywhere(selected, design.features))
    fitted = fit_all(rows, chosen, windows, cutter, selected, var_limit=horizon.var_columns, sequence_steps=horizon.sequence_steps)
    fitted = {m: written(f, f"fit-{m}") for m, f in fitted.items()}
    size = rows.groupBy(*by).agg(F.max(POS).alias("n")).agg(F.max(F.col("n") - F.floor(F.col("n") * share))).first()[0] or 0
    predictions = forecast_tests(fitted, rows, chosen, windows, cutter, steps=int(size), sequence_steps=horizon.sequence_steps)
    ends = rows.join(windows.drop("fold").withColumnRenamed("train_rows", POS), [*by, POS]) if by else rows.filter(F.col(POS) == windows.select("train_rows").scalar())
    ends = ends.select(*by, F.col("ts").alias("trained_to"), F.col(POS).cast("long").alias("train_rows"))
    return Trained(fitted, chosen, selected, ends, Result(predictions, selected, windows, tuple(design.targets)))


def packed(trained: Trained, horizon: Horizon, version: str) -> DataFrame:
    """The rows to store."""
    by = list(trained.design.by)
    tables = []
    for model, table in trained.fitted.items():
        parts = [x for n in _SINGLE[model] for x in (F.lit(n), F.array(F.col(n).cast("double")))]
        parts += [x for n in _LISTS[model] for x in (F.lit(n), F.col(n))]
        columns = F.col("columns") if model == "var" else F.lit(None).cast("array<string>")
        tables.append(table.select(*by, F.lit(model).alias("model"), "target", columns.alias("columns"), F.create_map(*parts).alias("numbers")))
    stacked = tables[0]
    for t in tables[1:]:
        stacked = stacked.unionByName(t)
    stacked = stacked.join(trained.ends, by) if by else stacked.withColumns({c: trained.ends.select(c).scalar() for c in ("trained_to", "train_rows")})
    names = F.array(*[F.lit(f) for f in trained.design.features]).cast("array<string>")
    return stacked.withColumns({"features": names, "horizon": F.lit(horizon.name), "version": F.lit(version)})


def unpacked(stored: DataFrame, model: str, by: list[str]) -> DataFrame:
    """The fitted table of one model, as its forecast function takes it."""
    number = lambda n: F.col("numbers")[n]
    kinds: dict[str, Column] = {n: number(n)[0].cast("int" if n == "lag_order" else "double") for n in _SINGLE[model]}
    kinds |= {n: number(n) for n in _LISTS[model]}
    rows = stored.filter(F.col("model") == model)
    extra = ["columns"] if model == "var" else []
    return rows.select(*by, F.lit(0).alias("fold"), "target", *extra, *[c.alias(n) for n, c in kinds.items()])


class TrainedForecaster(Forecaster):
    """Forecasts beyond the last given row from models that ended earlier; rows only supply the regressors, nothing is fitted."""

    selects = True
    ends: DataFrame  # (by, trained_to, train_rows)

    def fitted(self, model: str) -> DataFrame:
        raise NotImplementedError

    def arimax_models(self) -> DataFrame:
        return self.fitted("arimax")

    def var_models(self) -> DataFrame:
        return self.fitted("var")

    def additive_models(self) -> DataFrame:
        return self.fitted("additive")

    def sequence_models(self, steps: int) -> DataFrame:
        return self.fitted("sequence")

    def trend_rows(self) -> DataFrame:
        """Future rows at the positions they have counted from the end of training."""
        future = self.future().drop("train_rows", POS)
        if self.by:
            future = future.join(self.ends, self.by)
        else:
            future = future.withColumns({c: self.ends.select(c).scalar() for c in ("trained_to", "train_rows")})
        steps = F.timestamp_diff("SECOND", F.col("trained_to"), F.col("ts")) / self.design.step_seconds
        return future.withColumn(POS, F.col("train_rows") + steps)

    def all(self) -> DataFrame:
        """(by, fold, model, target, k, ts, yhat) of all four models."""
        stacked = self.arimax()
        for forecast in (self.var(), self.additive(), self.sequence(self.horizon.sequence_steps)):
            stacked = stacked.unionByName(forecast)
        return stacked


class FittedForecaster(TrainedForecaster):
    """From the tables that training left."""

    def __init__(self, rows: DataFrame, trained: Trained, horizon: Horizon, future: DataFrame | None = None) -> None:
        super().__init__(rows.select(*trained.design.by, "ts", POS, *[f"`{c}`" for c in trained.design.columns]), trained.design, horizon, future=future)
        self.trained, self.ends = trained, trained.ends

    def fitted(self, model: str) -> DataFrame:
        return self.trained.fitted[model]


class StoredForecaster(TrainedForecaster):
    """From a stored table."""

    def __init__(self, rows: DataFrame, design: Design, horizon: Horizon, stored: DataFrame, future: DataFrame | None = None) -> None:
        """`stored` is one version of one horizon. A feature that the rows no longer have counts as 0."""
        names = stored.select(F.explode("features").alias("feature")).distinct()
        order = stored.select("features").first()
        wanted = list(order["features"]) if order else selected_features(None, rows.columns, design.targets)
        present = set(selected_features(names, rows.columns, design.targets))
        filled = [F.col(f"`{f}`") if f in present else F.lit(0.0).alias(f) for f in wanted]
        kept = rows.select(*design.by, "ts", POS, *design.targets, *filled)
        super().__init__(kept, replace(design, features=tuple(wanted)), horizon, future=future)
        self.stored = stored
        self.ends = stored.select(*self.by, "trained_to", "train_rows").distinct()

    def fitted(self, model: str) -> DataFrame:
        return unpacked(self.stored, model, self.by)
