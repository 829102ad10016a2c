"""Windows over blocks against pandas over the whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import blocks, ewm, fill, indicators
from helpers import HOUR, column, random_bars, same, series, to_spark


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Chunks of 16 rows and blocks of 32, so that every frame crosses borders."""
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 16)
    original = blocks.to_blocks

    def small(numbered, *, halo=0, rows=blocks.BLOCK_ROWS):
        return original(numbered, halo=halo, rows=min(rows, 32))

    monkeypatch.setattr(blocks, "to_blocks", small)
    monkeypatch.setattr(fill, "to_blocks", small)


def test_positions_cross_chunks(spark, tiny_blocks):
    bars = to_spark(spark, random_bars(200, drop=0.4))
    got = blocks.number_rows(bars, by=["symbol"], step_seconds=HOUR)
    for s in ("a", "b"):
        p = column(got, "_pos", s)
        assert p == list(range(1, len(p) + 1))


def test_series_without_neighbours_in_the_chunk(spark, tiny_blocks):
    """Rows far apart: each halo row comes from another chunk."""
    pdf = random_bars(1000, symbols=("a",)).iloc[::37].reset_index(drop=True)
    got = indicators.sma(to_spark(spark, pdf), n=5, name="m", step_seconds=HOUR, full=True)
    same(column(got, "m"), pdf["close"].rolling(5).mean())


@pytest.mark.parametrize("drop", [0.0, 0.3])
def test_indicators_match_pandas(spark, tiny_blocks, drop):
    pdf = random_bars(150, drop=drop)
    bars = to_spark(spark, pdf)
    sma = indicators.sma(bars, n=20, name="x", step_seconds=HOUR, full=True)
    part = indicators.sma(bars, n=14, name="x", step_seconds=HOUR, full=False)
    std = indicators.rolling_std(bars, n=20, name="x", step_seconds=HOUR)
    rsi = indicators.rsi(bars, name="x", step_seconds=HOUR, full=True)
    atr = indicators.atr(bars, step_seconds=HOUR)
    sto = indicators.stochastic(bars, step_seconds=HOUR)
    vol = indicators.volatility(bars, step_seconds=HOUR)
    for s in ("a", "b"):
        p = pdf[pdf.symbol == s].reset_index(drop=True)
        c = p["close"]
        same(column(sma, "x", s), c.rolling(20).mean())
        same(column(part, "x", s), c.rolling(14, min_periods=1).mean())
        same(column(std, "x", s), c.rolling(20, min_periods=1).std())
        d = c.diff()
        gain, loss = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
        same(column(rsi, "x", s), 100 - 100 / (1 + gain / loss))
        tr = pd.concat([p.high - p.low, (p.high - c.shift()).abs(), (p.low - c.shift()).abs()], axis=1).max(axis=1)
        same(column(atr, "atr", s), tr.rolling(14).mean())
        low, high = p.low.rolling(14).min(), p.high.rolling(14).max()
        k = 100 * (c - low) / (high - low)
        same(column(sto, "stoch_k", s), k)
        same(column(sto, "stoch_d", s), k.rolling(3).mean())
        same(column(vol, "volatility", s), c.pct_change().rolling(20).std())


@pytest.mark.parametrize("span", [2, 9, 12, 14, 26])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_matches_pandas(spark, span, adjust):
    rng = np.random.default_rng(span)
    values = (50 + np.cumsum(rng.normal(size=7000))).tolist()
    got = ewm.ewm(series(spark, {"a": values}), "close", "e", span=span, adjust=adjust, step_seconds=HOUR, gaps=False)
    same(column(got, "e"), pd.Series(values).ewm(span=span, adjust=adjust).mean(), tol=1e-11)


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_with_gaps(spark, adjust):
    rng = np.random.default_rng(3)
    values = rng.normal(10, 2, 3500)
    values[rng.random(3500) < 0.5] = np.nan
    values[:4] = np.nan
    values[500:3000] = np.nan  # longer than the halo and than a block
    got = ewm.ewm(series(spark, {"a": values.tolist()}), "close", "e", span=3, adjust=adjust, step_seconds=HOUR)
    same(column(got, "e"), pd.Series(values).ewm(span=3, adjust=adjust).mean(), tol=1e-10)


def test_macd_across_blocks(spark):
    pdf = random_bars(5000, symbols=("a",))
    got = indicators.macd(to_spark(spark, pdf), step_seconds=HOUR)
    c = pdf["close"]
    line = c.ewm(span=12).mean() - c.ewm(span=26).mean()
    same(column(got, "macd"), line, tol=1e-9)
    same(column(got, "macd_signal"), line.ewm(span=9).mean(), tol=1e-9)


def test_indicator_set_equals_single_indicators(spark):
    bars = to_spark(spark, random_bars(120))
    whole = indicators.indicator_set(bars, step_seconds=HOUR)
    assert whole.columns == [*bars.columns, *indicators.INDICATORS]
    boll = indicators.bollinger(bars, step_seconds=HOUR)
    for c in ("bb_middle", "bb_upper", "bb_lower", "bb_width"):
        same(column(whole, c, "a"), column(boll, c, "a"))
    same(column(whole, "roc", "b"), column(indicators.rate_of_change(bars, step_seconds=HOUR), "roc", "b"))


def test_rsi_rules(spark):
    def rsi(values, full):
        return column(indicators.rsi(series(spark, {"a": values}), name="r", step_seconds=HOUR, full=full, n=2), "r")

    same(rsi([1.0, 2.0, 3.0, 4.0, 5.0], True), [None, 100, 100, 100, 100])
    same(rsi([1.0, 1.0, 1.0, 1.0], True), [None] * 4)
    same(rsi([1.0, 2.0, 3.0, 2.5], False), [None, None, None, 100 - 100 / (1 + 0.5 / 0.25)])


@pytest.mark.parametrize("n", [6, 200])
def test_fills_match_pandas(spark, tiny_blocks, n):
    if n == 6:
        values = np.array([np.nan, 1, np.nan, np.nan, 4, np.nan])
    else:
        rng = np.random.default_rng(5)
        values = rng.normal(size=n)
        values[rng.random(n) < 0.6] = np.nan
        values[40:130] = np.nan
        values[:3] = values[-5:] = np.nan
    df = series(spark, {"a": values.tolist(), "b": [None] * 5})
    s = pd.Series(values)
    for how, want in (("forward", s.ffill()), ("backward", s.bfill()), ("both", s.ffill().bfill())):
        got = fill.fill_rows(df, ["close"], by=["symbol"], step_seconds=HOUR, how=how)
        same(column(got, "close", "a"), want)
        assert column(got, "close", "b") == [None] * 5
    got = fill.interpolate_rows(df, ["close"], by=["symbol"], step_seconds=HOUR)
    same(column(got, "close", "a"), s.interpolate(method="linear", limit_direction="both"))


def test_interpolation_is_positional(spark):
    rows = [("a", pd.Timestamp(2024, 1, d).to_pydatetime(), v) for d, v in ((1, 1.0), (2, None), (10, 3.0))]
    df = spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP_NTZ, close DOUBLE")
    same(column(fill.interpolate_rows(df, ["close"], by=["symbol"], step_seconds=HOUR), "close"), [1, 2, 3])


def test_fill_twice_changes_nothing(spark):
    df = series(spark, {"a": [None, 1.0, None, 2.0, None]})
    once = fill.fill_rows(df, ["close"], by=["symbol"], step_seconds=HOUR)
    twice = fill.fill_rows(once, ["close"], by=["symbol"], step_seconds=HOUR)
    assert column(once, "close") == column(twice, "close") == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_no_window_holds_a_whole_series(spark):
    """Data windows are partitioned by block; only the tables of chunks are ordered per symbol."""
    bars = to_spark(spark, random_bars(50))
    plan = indicators.sma(bars, n=20, name="x", step_seconds=HOUR, full=True)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Window" in line and "avg(" in line]
    assert lines and all("_block" in line for line in lines)
    out = indicators.sma(bars, n=20, name="x", step_seconds=HOUR, full=True)
    assert out.filter(F.col("x").isNotNull()).count() == 2 * 31
