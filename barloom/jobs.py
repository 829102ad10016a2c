"""The batch steps as jobs over stored bars: `python -m barloom.jobs <step> --bars PATH --out PATH ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import LONG, SHORT, Horizon
from barloom.models import stored
from barloom.models.backtest import backtest
from barloom.models.design import features_then_fill, fill_then_features, training_table
from barloom.models.forecast import Forecaster
from barloom.models.windows import Folds
from barloom.operators import etl, metrics, quality, views
from barloom.session import prepare
from barloom.sources import sinks, store

HORIZONS = {"short": SHORT, "long": LONG}


def run_etl(bars: DataFrame, symbols: list[str], horizon: Horizon, out: str, end: str | None = None) -> None:
    """Panel to Parquet, record with the gate's decision to JSON."""
    limit = F.lit(end).cast("timestamp_ntz") if end else None
    sinks.sink_parquet(etl.etl_panel(bars, symbols, horizon, end=limit), f"{out}/panel")
    sinks.sink_json(quality.gate(etl.etl_record(bars, horizon, end=limit)), f"{out}/record")


def run_features(bars: DataFrame, horizon: Horizon, out: str) -> None:
    sinks.sink_parquet(etl.feature_table(bars, step_seconds=horizon.step_seconds), f"{out}/features", partition_by=["symbol"])


def run_validate(bars: DataFrame, horizon: Horizon, out: str, as_of: str) -> None:
    moment = F.lit(as_of).cast("timestamp_ntz")
    sinks.sink_json(etl.validation_record(bars, as_of=moment, limit_seconds=horizon.fresh_seconds), f"{out}/validation")


def run_backtest(bars: DataFrame, symbols: list[str], target: str, horizon: Horizon, out: str) -> None:
    """Fold metrics and their summary."""
    step = horizon.step_seconds
    panel = features_then_fill(bars, symbols, max_missing=horizon.max_missing_train, step_seconds=step)
    rows, design = training_table(panel, target, step_seconds=step)
    folds = Folds(horizon.fold_min_train, horizon.fold_test, horizon.fold_step)
    done = backtest(
        rows, design, folds, top_k=horizon.backtest_features, var_limit=horizon.var_columns, sequence_steps=horizon.sequence_steps
    )
    path = sinks.sink_parquet(done.metrics(step_seconds=step), f"{out}/fold-metrics")
    table = bars.sparkSession.read.parquet(path)
    sinks.sink_csv(metrics.backtest_summary(table), f"{out}/summary")


def run_train(bars: DataFrame, symbols: list[str], target: str, horizon: Horizon, out: str, version: str, end: str | None = None) -> None:
    """Select and fit on the first four fifths, errors of the rest to CSV, models with their metadata to the store under `version`."""
    step = horizon.step_seconds
    known = bars.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else bars
    panel = features_then_fill(known, symbols, max_missing=horizon.max_missing_train, step_seconds=step)
    rows, design = training_table(panel, target, step_seconds=step)
    done = stored.train(rows, design, horizon)
    sinks.sink_csv(done.result.metrics(step_seconds=step).drop("fold"), f"{out}/holdout")
    store.save_models(stored.packed(done, horizon, version), f"{out}/models")


def run_forecast(
    bars: DataFrame, symbols: list[str], target: str, horizon: Horizon, out: str, features: list[str], models: str | None = None, version: str | None = None
) -> None:
    """Forecasts of all models: one folder per model with close, high and low.

    With a folder of stored `models` nothing is fitted: its last version, or the named one, forecasts from the given bars. Else the
    models are fitted on all bars, with the named features or all of them.
    """
    step = horizon.step_seconds
    panel = fill_then_features(bars, symbols, max_missing=horizon.max_missing_predict, step_seconds=step)
    rows, design = training_table(panel, target, step_seconds=step)
    if models:
        trained = store.load_models(bars.sparkSession, models, horizon=horizon.name, version=version)
        stacked = stored.StoredForecaster(rows, design, horizon, trained).all()
    else:
        chosen = design.with_features([f for f in design.features if f in features] or design.features)
        fresh = Forecaster(rows.select("ts", "_pos", *chosen.columns), chosen, horizon)
        stacked = fresh.arimax()
        for forecast in (fresh.var(), fresh.additive(), fresh.sequence(horizon.predict_sequence_steps)):
            stacked = stacked.unionByName(forecast)
    path = sinks.sink_parquet(stacked, f"{out}/forecast-rows", partition_by=["model"])
    table = bars.sparkSession.read.parquet(path)
    wide = views.rebuild_high_low(table, ["model", "ts"]).dropna(subset=["close"])
    sinks.sink_csv(wide, f"{out}/forecasts", partition_by=["model"])
    by_step = table.withColumnRenamed("k", "step")
    ends = [24, 48, 72, 168] if horizon is SHORT else [30, 90, 180]
    last = F.array(*[F.struct(F.lit(t).alias("target"), F.max_by(t, "ts").alias("current")) for t in design.targets])
    current = rows.agg(last.alias("last")).select(F.inline("last")) if horizon.trend_from_current else None
    sinks.sink_csv(views.horizon_table(by_step, ends, horizon.trend_percent, current=current), f"{out}/horizons")
    sinks.sink_csv(views.consensus(by_step, ends[0], ends[-1]), f"{out}/consensus")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("step", choices=["etl", "features", "validate", "train", "backtest", "forecast"])
    parser.add_argument("--bars", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--horizon", choices=sorted(HORIZONS), default="short")
    parser.add_argument("--symbols", default="")
    parser.add_argument("--target", default="")
    parser.add_argument("--features", default="")
    parser.add_argument("--end")
    parser.add_argument("--as-of")
    parser.add_argument("--models", help="folder of stored models to forecast from")
    parser.add_argument("--version", help="name under which models are stored, or are loaded (default: the last one)")
    args = parser.parse_args()
    spark = prepare(SparkSession.builder.appName(f"barloom-{args.step}").getOrCreate())
    bars, horizon = spark.read.parquet(args.bars), HORIZONS[args.horizon]
    symbols = [s for s in args.symbols.split(",") if s]
    if args.step == "etl":
        run_etl(bars, symbols, horizon, args.out, args.end)
    elif args.step == "features":
        run_features(bars, horizon, args.out)
    elif args.step == "validate":
        run_validate(bars, horizon, args.out, args.as_of)
    elif args.step == "train":
        run_train(bars, symbols, args.target, horizon, args.out, args.version or args.end or "1", args.end)
    elif args.step == "backtest":
        run_backtest(bars, symbols, args.target, horizon, args.out)
    else:
        run_forecast(bars, symbols, args.target, horizon, args.out, [f for f in args.features.split(",") if f], args.models, args.version)


if __name__ == "__main__":
    main()
