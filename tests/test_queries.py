"""Registered queries against their reference SQL on the smallest tables, streams against batch, and the batch jobs."""

from __future__ import annotations

import json
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from barloom import jobs  # noqa: E402
from barloom.config import SHORT  # noqa: E402
from barloom.plans.catalog import HOURLY_SYMBOLS, Tables  # noqa: E402
from compare import TABLES, compare  # noqa: E402

CHECKED = [
    "bars_hourly", "bars_daily", "bars_by_supplier", "scan_csv_any", "scan_csv_epoch", "scan_json_rows", "sink_csv", "sink_json_history",
    "model_locate", "filter_missing_count", "clean_report", "split_symbol_feature", "calendar_reindex", "nearest_row", "indicator_set",
    "fill_both", "interpolate_linear", "etl_panel", "fold_metrics", "error_distribution", "topk_features", "candle_table_daily",
    "cut_from_end", "future_regressors", "forecast_panel", "naive_sma_atr", "stream_bars", "stream_latest", "least_squares",
]


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, tables, name):
    message = compare(spark, con, name, tables)
    assert ": ok" in message and "TYPES" not in message, message


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 140


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_jobs_run_end_to_end(spark, tables, tmp_path):
    bars = Tables(spark, tables).hourly()
    out = str(tmp_path)
    jobs.run_etl(bars, HOURLY_SYMBOLS, SHORT, out, end="2024-01-28")
    record = json.loads(next((tmp_path / "record").glob("*.json")).read_text())
    assert record["branch"] in ("ok_path", "fail_path") and record["original_rows"] >= record["after_cleaning_rows"]
    panel = spark.read.parquet(f"{out}/panel")
    assert len(panel.columns) == 1 + 8 * len(HOURLY_SYMBOLS)
    jobs.run_features(bars, SHORT, out)
    assert spark.read.parquet(f"{out}/features").count() == bars.count()
    jobs.run_validate(bars, SHORT, out, "2024-01-30 23:00:00")
    assert "missing_rate_ok" in json.loads(next((tmp_path / "validation").glob("*.json")).read_text())


def test_forecast_job(spark, tables, tmp_path):
    bars = Tables(spark, tables).hourly()
    out = str(tmp_path)
    wanted = ["click_rsi", "view_roc", "error_macd", "click_volatility"]
    jobs.run_forecast(bars, HOURLY_SYMBOLS, "click", SHORT, out, wanted)
    got = spark.read.option("header", True).csv(f"{out}/forecasts").groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in got} == {m: SHORT.steps for m in ("arimax", "var", "additive", "sequence")}
    assert spark.read.option("header", True).csv(f"{out}/horizons").count() == 4 * 3


def test_forecast_job_from_stored_models(spark, tables, tmp_path, monkeypatch):
    bars = Tables(spark, tables).hourly()
    out = str(tmp_path)
    jobs.run_train(bars, HOURLY_SYMBOLS, "click", SHORT, out, "2024-01-28", end="2024-01-28")
    held = spark.read.option("header", True).csv(f"{out}/holdout")
    assert held.count() == 4 * 3 and held.filter("CAST(n AS INT) > 0").count() == 12
    models = spark.read.parquet(f"{out}/models")
    assert {tuple(r) for r in models.select("horizon", "model", F.size("features")).distinct().collect()} == {("short", m, SHORT.top_features) for m in ("arimax", "var", "additive", "sequence")}

    def fits(*args, **kwargs):
        raise AssertionError("a forecast from stored models fits nothing")

    for name in ("arimax_fit", "var_fit", "sequence_fit", "lagged_sums"):
        monkeypatch.setattr(jobs.stored.Forecaster.__init__.__globals__["linear"], name, fits)
    jobs.run_forecast(bars, HOURLY_SYMBOLS, "click", SHORT, out, [], models=f"{out}/models")
    got = spark.read.option("header", True).csv(f"{out}/forecasts").groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in got} == {m: SHORT.steps for m in ("arimax", "var", "additive", "sequence")}
