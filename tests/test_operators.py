"""Row, join, aggregate and chart operators on hand-made frames."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import LONG, SHORT, Cells, Share
from barloom.functions import columns, scalar
from barloom.models import folds
from barloom.models.future import family, future_regressors
from barloom.models.naive import naive_forecast
from barloom.operators import align, clean, features, metrics, quality, toplists, views
from barloom.plans.catalog import Tables
from barloom.session import work_folder
from barloom.sources.ticks import bars
from barloom.operators.quantiles import box_statistics, exact_quantiles
from helpers import HOUR, START, column, random_bars, same, series, times, to_spark

INF, NAN = float("inf"), float("nan")


def bars_of(spark, rows):
    return spark.createDataFrame(
        [("a", START + dt.timedelta(hours=i), *r, 1.0) for i, r in enumerate(rows)],
        "symbol STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE",
    )


def test_reject_reasons_in_order(spark):
    df = bars_of(spark, [
        (None, None, None, None), (INF, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, -1.0, 1.0), (1.0, 100001.0, 1.0, 1.0),
        (None, 2.0, 1.0, 1.0), (1.0, 2.0, 1.0, 1.5), (NAN, NAN, NAN, NAN), (0.0, 0.0, 0.0, INF),
    ])
    got = column(df.withColumn("r", clean.reject_reason()), "r")
    assert got == ["all_missing", "infinite", "all_zero", "abnormal", "abnormal", None, None, "all_missing", "infinite"]
    assert clean.clean_prices(df).count() == 2
    report = clean.clean_report(df).collect()[0].asDict()
    assert report == {
        "rows_before": 9, "rows_after": 2, "all_missing": 2, "infinite": 2, "all_zero": 1, "abnormal": 2,
        "missing_cells": 1, "infinite_cells": 0, "zero_cells": 0,
    }


def test_missing_filters_agree(spark):
    pdf = random_bars(60, symbols=("a", "b", "c"), drop=0.4)
    bars = to_spark(spark, pdf)
    cells = ["open", "high", "low", "close", "volume"]
    panel = align.wide_panel(bars, ["a", "b", "c"], cells)
    wide = clean.filter_missing(panel, [c for c in panel.columns if c != "ts"], Share(0.4))
    long = clean.filter_missing_long(bars, cells, Share(0.4))
    assert {r["ts"] for r in wide.select("ts").collect()} == {r["ts"] for r in long.select("ts").distinct().collect()}
    assert 0 < wide.count() < panel.count()


def test_filter_or_all(spark):
    df = series(spark, {"a": [1.0, 2.0, None]})
    assert clean.filter_or_all(df, F.col("close") > 1).count() == 1
    assert clean.filter_or_all(df, F.col("close") > 5).count() == 3
    assert clean.filter_or_all(df.limit(0), F.col("close") > 5).count() == 0


def test_merge_frames_is_an_outer_merge(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ts INT, x DOUBLE")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "ts INT, y DOUBLE")
    got = sorted(tuple(r) for r in align.merge_frames([a, b]).collect())
    assert got == [(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)]


def test_symbols_with_odd_names(spark):
    pdf = random_bars(5, symbols=("GC=F", "^GSPC", "it's"))
    panel = align.wide_panel(to_spark(spark, pdf), ["GC=F", "^GSPC", "it's"], ["close"])
    assert panel.columns == ["ts", "GC=F_close", "^GSPC_close", "it's_close"]
    same(column(panel, "it's_close"), pdf[pdf.symbol == "it's"]["close"])
    back = align.melt_panel(panel, panel.columns[1:])
    assert {(r["symbol"], r["feature"]) for r in back.select("symbol", "feature").distinct().collect()} == {
        ("GC=F", "close"), ("^GSPC", "close"), ("it's", "close")
    }


def test_calendar_reindex_holds_values(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 5)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "symbol STRING, ts TIMESTAMP_NTZ, close DOUBLE")
    got = align.calendar_reindex(df, ["close"], step_seconds=86400).orderBy("ts").collect()
    assert [(r["ts"].day, r["close"]) for r in got] == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 2.0)]


def test_nearest_row_prefers_the_earlier_on_a_tie(spark):
    bars = series(spark, {"a": [1.0, 2.0]}).unionByName(
        spark.createDataFrame([("a", START + dt.timedelta(days=40), 9.0)], "symbol STRING, ts TIMESTAMP_NTZ, close DOUBLE")
    )
    moments = [START - dt.timedelta(days=9), START + dt.timedelta(minutes=30), START + dt.timedelta(minutes=31),
               START + dt.timedelta(days=15), START + dt.timedelta(days=25), START + dt.timedelta(days=90)]
    probes = spark.createDataFrame([("a", m) for m in moments] + [("zzz", START)], "symbol STRING, ts TIMESTAMP_NTZ")
    got = align.nearest_rows(probes, bars, ["close"], step_seconds=60)
    assert column(got, "close", "a") == [1.0, 1.0, 2.0, 2.0, 9.0, 9.0]
    assert column(got, "close", "zzz") == [None]


def test_quality(spark):
    bars = to_spark(spark, random_bars(120))
    last = START + dt.timedelta(hours=119)
    for hours, want in ((6, True), (7, False)):
        as_of = F.lit(str(last + dt.timedelta(hours=hours))).cast("timestamp_ntz")
        assert quality.freshness(bars, as_of=as_of, limit_seconds=6 * HOUR).collect()[0]["freshness_ok"] is want
    assert quality.rows_ok(bars).collect()[0][0] is True
    assert quality.rows_ok(bars.limit(0)).collect()[0][0] is True
    assert quality.rows_ok(to_spark(spark, random_bars(100))).collect()[0][0] is False


@pytest.mark.parametrize("rate, rows, plain, strict", [
    (0.1, 5, "ok_path", "ok_path"), (0.11, 5, "fail_path", "fail_path"), (None, 5, "fail_path", "fail_path"), (0.0, 0, "ok_path", "fail_path"),
])
def test_gate(spark, rate, rows, plain, strict):
    df = spark.createDataFrame([(rate, rows)], "missing_rate DOUBLE, after_cleaning_rows LONG")
    assert quality.gate(df).collect()[0]["branch"] == plain
    assert quality.gate(df, strict=True).collect()[0]["branch"] == strict


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = np.abs(rng.normal(size=300)).round(1), np.abs(rng.normal(size=300)).round(1)
    y[5] = p[5] = 0.0
    rows = [("m", t, ts, float(a), float(b)) for t in ("close", "low_spread") for ts, a, b in zip(times(300), y, p)]
    df = spark.createDataFrame(rows, "model STRING, target STRING, ts TIMESTAMP_NTZ, actual DOUBLE, predicted DOUBLE")
    got = {r["target"]: r for r in metrics.evaluate(df, step_seconds=HOUR).collect()}
    e = y - p
    up = (pd.Series(y).pct_change() > 0).astype(int) == (pd.Series(p).pct_change() > 0).astype(int)
    c = got["close"]
    np.testing.assert_allclose([c["mae"], c["rmse"], c["dir_acc"]], [np.abs(e).mean(), np.sqrt((e**2).mean()), up.mean()])
    np.testing.assert_allclose(c["mape"], np.mean(np.abs(e) / np.maximum(np.abs(y), 2.220446049250313e-16)))
    size = np.abs(y) + np.abs(p)
    np.testing.assert_allclose(got["low_spread"]["smape"], 100 * np.mean(np.where(size == 0, 0, 2 * np.abs(e) / np.where(size == 0, 1, size))))
    assert c["smape"] is None and got["low_spread"]["mape"] is None


def test_first_direction_is_a_hit(spark):
    df = spark.createDataFrame([("m", "close", t, a, b) for t, a, b in zip(times(2), [1.0, 2.0], [2.0, 1.0])],
                               "model STRING, target STRING, ts TIMESTAMP_NTZ, actual DOUBLE, predicted DOUBLE")
    assert metrics.direction_accuracy(df, step_seconds=HOUR).collect()[0]["dir_acc"] == 0.5


@pytest.mark.parametrize("kind", ["smooth", "ties", "one"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(1)
    values = {"smooth": rng.normal(size=5000), "ties": np.r_[np.zeros(3000), rng.integers(0, 5, 2000)].astype(float), "one": np.array([4.0])}[kind]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", 2.0)], "g STRING, v DOUBLE")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, by=["g"], value="v", probs=probs).collect()}
    np.testing.assert_allclose(got["g"]["q"], np.quantile(values, probs), atol=1e-12)
    np.testing.assert_allclose(got["h"]["q"], np.quantile([1.0, 2.0], probs))
    assert got["g"]["n"] == len(values)


def test_box_statistics(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g STRING, v DOUBLE")
    r = box_statistics(df, by=["g"], value="v").collect()[0]
    assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["median"]) == (1.0, 5.0, 1, 3.5)


def test_feature_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=100)
    y = x + rng.normal(size=100)
    df = spark.createDataFrame([(float(a), float(a), 1.0, float(b)) for a, b in zip(x, y)], "p DOUBLE, q DOUBLE, flat DOUBLE, y DOUBLE")
    scores = features.feature_scores(df, ["p", "q", "flat"], ["y"])
    got = {r["feature"]: r["score"] for r in scores.collect()}
    r2 = np.corrcoef(x, y)[0, 1] ** 2
    np.testing.assert_allclose(got["p"], r2 / (1 - r2) * 98)
    assert got["flat"] is None
    assert [r["feature"] for r in features.top_features(scores, 1).collect()] == ["q"]
    assert [r["feature"] for r in features.top_features(scores, 2).collect()] == ["p", "q"]


def test_minmax_constant_column(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0)], "symbol STRING, x DOUBLE, c DOUBLE")
    fitted = features.fit_minmax(df, ["x", "c"], ["symbol"])
    got = features.apply_minmax(df, fitted, ["x", "c"], ["symbol"])
    assert sorted((r["x"], r["c"]) for r in got.collect()) == [(0.0, 0.0), (1.0, 0.0)]
    back = features.apply_minmax(got, fitted, ["x", "c"], ["symbol"], inverse=True)
    assert sorted((r["x"], r["c"]) for r in back.collect()) == [(1.0, 5.0), (3.0, 5.0)]


def test_sequence_windows(spark):
    got = features.sequence_windows(series(spark, {"a": [1.0, 2.0, 3.0, 4.0]}), ["close"], steps=2, step_seconds=HOUR)
    assert column(got, "sequence") == [[[1.0], [2.0]], [[2.0], [3.0]]]


@pytest.mark.parametrize("n, m, t, s", [(720, 300, 60, 60), (710, 300, 60, 60), (300, 300, 60, 60), (301, 300, 60, 60), (500, 100, 90, 40)])
def test_folds(spark, n, m, t, s):
    line = folds.timeline(series(spark, {"a": [0.0] * n}), step_seconds=HOUR)
    got = folds.fold_bounds(line, min_train=m, test=t, step=s).orderBy("fold").collect()
    want, f = [], 0
    while m + f * s < n:
        end = m + f * s
        want.append((f, end, min(t, n - end)))
        f += 1
    assert [(r["fold"], r["train_rows"], r["test_rows"]) for r in got] == want
    for r in got:
        assert r["train_end"] < r["test_start"] <= r["test_end"] and r["train_start"] == START
        assert r["train_end"] == START + dt.timedelta(hours=r["train_rows"] - 1)


def test_chrono_split(spark):
    got = folds.chrono_split(series(spark, {"a": [0.0] * 7, "b": [0.0] * 4}), step_seconds=HOUR)
    assert column(got, "is_train", "a") == [True] * 5 + [False] * 2
    assert column(got, "is_train", "b") == [True] * 4


def test_ohlc_limits(spark):
    df = bars_of(spark, [(1.0, 3.0, 2.0, 5.0), (None, None, 2.0, 1.0), (None, None, None, None), (4.0, 1.0, 2.0, None)]).drop("volume")
    got = [tuple(r)[2:] for r in scalar.with_ohlc_limits(df).orderBy("ts").collect()]
    assert got == [(1.0, 5.0, 1.0, 5.0), (None, 2.0, 1.0, 1.0), (None, None, None, None), (4.0, 4.0, 1.0, None)]
    wide = scalar.with_envelope(df).filter("open IS NOT NULL AND close IS NOT NULL").collect()[0]
    assert (wide["high"], wide["low"]) == (5.0, 1.0)


@pytest.mark.parametrize("values, want", [
    (["2024-01-01 05:00:00", "junk"], [dt.datetime(2024, 1, 1, 5), None]),
    (["1704067200000", "1704070800000", "x"], [START, START + dt.timedelta(hours=1), None]),
    (["1704067200", "1704070800"], [START, START + dt.timedelta(hours=1)]),
    (["1", "400000000000"], [dt.datetime(1970, 1, 1, 0, 0, 0, 1000), dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=4e11)]),
    (["1", "150000000000"], None),
])
def test_smart_times(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "t STRING")
    got = {r["t"]: r["ts"] for r in scalar.parse_time_smart(df, "t", "ts").collect()} if want else None
    if want:
        assert [got[v] for v in values] == want
    else:  # median 7.5e10: seconds, although one value alone would be milliseconds
        one = scalar.parse_time_smart(df, "t", "ts").filter("t = '1'").collect()[0]["ts"]
        assert one == dt.datetime(1970, 1, 1, 0, 0, 1)


def test_column_choices():
    assert columns.clean_header("﻿ Date ") == "Date"
    assert columns.pick_column(["a", "My_Close"], ["Close"], containing="close") == "My_Close"
    assert columns.pick_column(["a"], ["Close"]) is None
    assert columns.columns_with(["x_close", "volume", "x_rsi", "y_macd"], limit=2) == ["x_close", "x_rsi"]
    assert columns.split_xy(["ts", "y", "a", "b"], ["y"], exclude=["ts"]) == (["a", "b"], ["y"])


def test_families_are_tested_in_order():
    assert [family(f) for f in ("a_bb_lower", "a_volume_sma", "a_bb_middle", "a_rsi", "a_macd_hist", "a_volatility", "a_volume", "a_bb_upper")] == [
        "price", "average", "average", "rsi", "oscillator", "recent", "last", "last"
    ]


def test_future_paths(spark):
    n = 60
    data = {"x_close": np.linspace(100, 130, n), "x_rsi": np.linspace(20, 90, n), "x_volume_ratio": np.full(n, 3.0), "x_volatility": np.arange(n, dtype=float), "x_atr": np.arange(n, dtype=float)}
    rows = [("a", t, *[float(data[c][i]) for c in data]) for i, t in enumerate(times(n))]
    df = spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP_NTZ, " + ", ".join(f"{c} DOUBLE" for c in data))
    got = {(r["feature"], r["step"]): r["value"] for r in future_regressors(df, list(data), SHORT).collect()}
    drift = pd.Series(data["x_close"]).pct_change().mean()
    rsi = float(np.clip(90 + 0.05 * (50 - 90), 30, 70))
    ratio = 3.0
    for k in (1, 2, 168):
        np.testing.assert_allclose(got["x_close", k], 130 * (1 + drift) ** (k - 1))
        np.testing.assert_allclose(got["x_rsi", k], 50 + (rsi - 50) * 0.95 ** (k - 1))
        np.testing.assert_allclose(got["x_volume_ratio", k], 1 + (ratio - 1) * 0.95**k)
        np.testing.assert_allclose(got["x_volatility", k], np.mean(np.arange(n)[-24:]))
        assert got["x_atr", k] == n - 1
    short = future_regressors(df.limit(24), ["x_close"], SHORT).filter("step = 168").collect()[0]
    assert short["value"] == df.limit(24).agg(F.max("x_close")).collect()[0][0]


def test_naive_forecast(spark):
    pdf = random_bars(30, symbols=("a",))
    r = naive_forecast(to_spark(spark, pdf), step_seconds=HOUR).collect()[0]
    c, last = pdf["close"], pdf.iloc[-1]
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - c.shift()).abs(), (pdf.low - c.shift()).abs()], axis=1).max(axis=1)
    close = last.close * (0.5 + 0.5 * last.close / c.tail(10).mean())
    open_ = (close + last.open) / 2
    atr = tr.rolling(14, min_periods=2).mean().iloc[-1]
    want = [open_, max(open_, close) + 0.5 * atr, min(open_, close) - 0.5 * atr, close]
    np.testing.assert_allclose([r["open"], r["high"], r["low"], r["close"]], want, atol=1e-4)
    one = naive_forecast(to_spark(spark, pdf.head(1)), step_seconds=HOUR).collect()[0]
    assert one["high"] > one["low"] and one["close"] == round(pdf.close[0], 4)


def test_candles_lose_two_rows(spark):
    pdf = random_bars(10, symbols=("m",))
    df = to_spark(spark, pdf).withColumnRenamed("symbol", "model")
    got = views.candle_table(df, long=False, step_seconds=HOUR).orderBy("ts").collect()
    assert len(got) == 8
    assert [r["open"] for r in got] == pdf["close"].tolist()[1:-1]
    assert all(r["low"] <= min(r["open"], r["close"]) and r["high"] >= max(r["open"], r["close"]) for r in got)


def test_horizons_and_trends(spark):
    rows = [("up", "close", s, float(100 + s)) for s in (24, 48, 72, 168)] + [("one", "close", 24, 5.0), ("flat", "close", 24, 100.0), ("flat", "close", 168, 101.0)]
    df = spark.createDataFrame(rows, "model STRING, target STRING, step INT, yhat DOUBLE")
    got = {r["model"]: r for r in views.horizon_table(df, [24, 48, 72, 168], 2.0).collect()}
    assert {m: r["trend"] for m, r in got.items()} == {"up": "BULLISH", "one": "N/A", "flat": "NEUTRAL"}
    assert got["one"]["h168"] is None
    both = views.consensus(df, 24, 168).collect()[0]
    np.testing.assert_allclose([both["early"], both["late"]], [(124 + 5 + 100) / 3, (268 + 101) / 2])


def test_rebuild_high_low_clips_and_keeps_missing(spark):
    rows = [("m", 1, "close", 10.0), ("m", 1, "high_spread", -2.0), ("m", 1, "low_spread", 3.0), ("m", 2, "close", 5.0)]
    df = spark.createDataFrame(rows, "model STRING, step INT, target STRING, yhat DOUBLE")
    got = [tuple(r) for r in views.rebuild_high_low(df, ["model", "step"]).orderBy("step").collect()]
    assert got == [("m", 1, 10.0, 10.0, 7.0), ("m", 2, 5.0, None, None)]


def test_cut_from_end_keeps_undated(spark):
    df = series(spark, {"a": [float(i) for i in range(100)]}).unionByName(spark.createDataFrame([("a", None, -1.0)], "symbol STRING, ts TIMESTAMP_NTZ, close DOUBLE"))
    got = views.cut_from_end(df, ["1H", "24H", "1M"]).groupBy("period").count().collect()
    assert {r["period"]: r["count"] for r in got} == {"1H": 3, "24H": 26, "1M": 101}


def test_selection_and_ranks(spark):
    df = spark.createDataFrame([("a", "t", 1.0, 0.5), ("b", "t", 1.0, 0.6), ("c", "t", 2.0, 0.9)], "model STRING, target STRING, mae DOUBLE, dir_acc DOUBLE")
    assert toplists.select_model(df).collect()[0]["model"] == "b"
    tail = toplists.tail_rows(series(spark, {"a": [1.0, 2.0, 3.0], "b": [9.0]}), 2)
    assert column(tail, "close", "a") == [2.0, 3.0] and column(tail, "close", "b") == [9.0]
    assert "WindowGroupLimit" in tail._jdf.queryExecution().executedPlan().toString()


def test_offsets_in_times_are_applied(spark):
    texts = ["2024-01-01T00:00:00+07:00", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "2024-01-01", "12:30", "no time", None]
    got = [r["t"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i INT, x STRING").select("i", scalar.utc_time(F.col("x")).alias("t")).orderBy("i").collect()]
    midnight = dt.datetime(2024, 1, 1)
    assert got == [midnight - dt.timedelta(hours=7), midnight, midnight, midnight, None, None, None]
    smart = scalar.parse_time_smart(spark.createDataFrame([(texts[0],)], "x STRING"), "x", "t").first()["t"]
    assert smart == midnight - dt.timedelta(hours=7)


@pytest.mark.parametrize("hole", [100, 4095, 4096, 4097])
def test_candles_do_not_depend_on_block_edges(spark, hole):
    rows = [("m", t, 100.0 + i % 7, None if i + 1 == hole else 110.0, 90.0) for i, t in enumerate(times(5000))]
    frame = spark.createDataFrame(rows, "model STRING, ts TIMESTAMP_NTZ, close DOUBLE, high DOUBLE, low DOUBLE")
    assert views.candle_table(frame, long=False, step_seconds=HOUR).count() == 4997


def test_a_share_of_one_keeps_all_rows(spark):
    frame = spark.createDataFrame([(None, None), (1.0, None)], "a DOUBLE, b DOUBLE")
    assert clean.filter_missing(frame, ["a", "b"], Share(1.0)).count() == 2
    assert clean.filter_missing(frame, ["a", "b"], Cells(1)).count() == 1


def test_executors_import_the_package_from_anywhere(tmp_path):
    """A Python stage in a process that starts elsewhere and knows the library only by its entry file."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.warehouse.dir', {str(tmp_path)!r}).getOrCreate()
print('ROWS', e.queries()['additive_fit'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_a_local_folder_is_refused_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/tmp/w"}.get(key, default)

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session())


def test_bars_hash_and_keep_the_order_of_ticks(spark, tables):
    hourly = Tables(spark, tables).hourly()
    assert "SortAggregate" not in hourly._jdf.queryExecution().executedPlan().toString()
    at = dt.datetime(2024, 1, 1, 5)
    ticks = [("a", at, k, float(v)) for k, v in ((9, 1), (-5, 2), (2**62, 3), (None, 4))] + [("a", at - dt.timedelta(microseconds=1), 2**63 - 1, 5.0)]
    frame = spark.createDataFrame(ticks, "s STRING, t TIMESTAMP_NTZ, k BIGINT, p DOUBLE")
    got = {r["ts"].hour: (r["open"], r["close"]) for r in bars(frame, symbol="s", ts="t", price="p", tick_order=["t", "k"], unit="HOUR").collect()}
    assert got == {4: (5.0, 5.0), 5: (4.0, 3.0)}


def test_trend_from_the_current_value(spark):
    frame = spark.createDataFrame([("m", "close", s, 100.0 + s) for s in (1, 30, 90)] + [("m", "low_spread", 1, 5.0)], "model STRING, target STRING, step LONG, yhat DOUBLE")
    current = spark.createDataFrame([("close", 200.0), ("low_spread", 5.0)], "target STRING, current DOUBLE")
    got = {r["target"]: r for r in views.horizon_table(frame, [1, 30, 90], 5.0, current=current).collect()}
    assert got["close"]["change_percent"] == pytest.approx(-5.0) and got["close"]["trend"] == "NEUTRAL" and got["close"]["h90"] == 190.0
    assert got["low_spread"]["trend"] == "NEUTRAL"
    assert LONG.trend_from_current and not SHORT.trend_from_current
