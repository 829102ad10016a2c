"""Forecasts beyond the last row of each series, from models fitted on all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Horizon
from barloom.models import additive, linear
from barloom.models.design import Design
from barloom.models.future import future_frame, future_regressors
from barloom.models.windows import Whole
from barloom.operators.blocks import POS
from barloom.session import written


FIFTHS = Whole(5)  # the last fifth of a series validates


class Forecaster:
    """The four models over one training table; every one of them reads it once."""

    selects = False  # whether the additive model had features selected for each series

    def __init__(self, rows: DataFrame, design: Design, horizon: Horizon, future: DataFrame | None = None) -> None:
        self.design, self.horizon = design, horizon
        self.by = list(design.by)
        self.rows = written(rows, "training")
        self.whole = Whole()
        self.windows = self.whole.windows(self.rows, self.by)
        self._future = future

    def future(self) -> DataFrame:
        """(by, fold, ts, k, _pos, features) for the horizon's steps, written once for all models."""
        if self._future is None:
            self._future = written(self._build_future(), "future")
        return self._future

    def _build_future(self) -> DataFrame:
        features = list(self.design.features)
        long = future_regressors(self.rows, features, self.horizon, by=self.by)
        wide = future_frame(long, features, by=self.by, hours=False).withColumnRenamed("step", "k")
        rows = wide.withColumn("k", F.col("k").cast("long")).fillna(0.0)
        if self.by:
            return rows.join(self.windows, self.by).withColumn(POS, F.col("train_rows") + F.col("k"))
        last = self.windows.select("train_rows").scalar()
        return rows.withColumn("fold", F.lit(0)).withColumn(POS, last + F.col("k"))

    def _sums(self):
        return linear.lagged_sums(self.rows, self.design, self.windows, linear.ARMA_LAGS, Whole(1))

    def arimax_models(self) -> DataFrame:
        return linear.arimax_fit(*self._sums(), self.design)

    def arimax(self) -> DataFrame:
        return linear.arimax_forecast(self.arimax_models(), self.future(), self.design)

    def var_models(self) -> DataFrame:
        return linear.var_fit(*self._sums(), self.design, limit=self.horizon.predict_var_columns)

    def var(self) -> DataFrame:
        path = linear.var_forecast(self.var_models(), self.design, steps=self.horizon.steps)
        last = self.rows.groupBy(*self.by).agg(F.max("ts").alias("_last")).withColumn("fold", F.lit(0))
        seconds = (F.col("k") * self.horizon.step_seconds).cast("int")
        return path.join(last, [*self.by, "fold"]).withColumn("ts", F.timestamp_add("SECOND", seconds, F.col("_last"))).drop("_last")

    def additive_models(self) -> DataFrame:
        return additive.additive_fit(self.rows, self.design, self.windows, self.whole)

    def additive(self) -> DataFrame:
        return additive.additive_forecast(self.additive_models(), self.trend_rows(), self.design, selected=self.selects)

    def trend_rows(self) -> DataFrame:
        return self.future()

    def sequence_models(self, steps: int) -> DataFrame:
        sums, ends = linear.lagged_sums(self.rows, self.design, self.windows, steps, FIFTHS, validation=True)
        scalers = linear.window_scalers(self.rows, self.design, self.windows, Whole(1))
        return linear.sequence_fit(sums, ends.join(scalers, [*self.by, "fold"]), self.design, steps)

    def sequence(self, steps: int) -> DataFrame:
        """The windows of all steps hold known rows and future regressors only, so one pass scores them all."""
        keys = [*self.by, "fold"]
        cols = [*keys, "ts", POS, "k", *self.design.features]
        size = self.windows.select(*self.by, "fold", "train_rows")
        known = self.rows.withColumn("k", F.lit(0).cast("long"))
        if self.by:
            known = known.join(size, self.by)
        else:
            known = known.withColumn("fold", F.lit(0)).withColumn("train_rows", size.select("train_rows").scalar())
        tail = known.filter(F.col(POS) > F.col("train_rows") - steps)
        line = tail.select(*cols).unionByName(self.future().select(*cols))
        sequences = linear.feature_sequences(line, self.design, steps, by=keys, keep=["k"]).filter(F.col("k") > 0)
        return linear.sequence_forecast(self.sequence_models(steps), sequences, self.design)
