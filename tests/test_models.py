"""Models against direct least squares on small frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.models import additive, linear
from barloom.models.backtest import backtest
from barloom.config import SHORT
from barloom.models.design import Design, series_table
from barloom.models.forecast import Forecaster
from barloom.models.gram import gram, lag_vectors, matrix, vectors
from barloom.models.selection import select_features, window_scores
from barloom.models.windows import Folds, Whole
from helpers import HOUR, random_bars, times, to_spark

N = 900
FEATURES = ("x1_close", "x2_rsi")


def simulate(seed: int = 1, n: int = N, phi=0.7, theta=0.3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(2, 1, n), rng.normal(-1, 2, n)
    e = rng.normal(size=n)
    u = np.zeros(n)
    for i in range(1, n):
        u[i] = phi * u[i - 1] + e[i] + theta * e[i - 1]
    return {"close": 2.0 * x1 - 0.5 * x2 + u, "spread": np.abs(rng.normal(size=n)), "x1_close": x1, "x2_rsi": x2}


def frame(spark, data, symbol="a"):
    n = len(data["close"])
    rows = [(symbol, t, i + 1, *[float(data[c][i]) for c in data]) for i, t in enumerate(times(n))]
    return spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP_NTZ, _pos LONG, " + ", ".join(f"{c} DOUBLE" for c in data))


DESIGN = Design(("close", "spread"), FEATURES, HOUR, ("symbol",))


def lags(a: np.ndarray, n: int) -> np.ndarray:
    """Columns a[t-1] ... a[t-n] for the rows t >= n."""
    return np.column_stack([a[n - k : len(a) - k] for k in range(1, n + 1)])


def brute_arma(data, upto):
    y, x = data["close"][:upto], np.column_stack([data[f][:upto] for f in FEATURES])
    k = linear.ARMA_LAGS
    b = np.linalg.lstsq(x[k:], y[k:], rcond=None)[0]
    u = y - x @ b
    long = np.column_stack([u[k - j : upto - j] for j in range(1, linear.LONG_AR + 1)])
    ar = np.linalg.lstsq(long, u[k:], rcond=None)[0]
    e = np.full(upto, np.nan)
    for i in range(linear.LONG_AR, upto):
        e[i] = u[i] - sum(ar[j] * u[i - 1 - j] for j in range(linear.LONG_AR))
    pair = np.column_stack([u[k - 1 : upto - 1], e[k - 1 : upto - 1]])
    phi, theta = np.linalg.lstsq(pair, u[k:], rcond=None)[0]
    return b, phi, theta, u[-1], e[-1]


def test_gram_adds_up(spark):
    data = simulate(n=200)
    df = frame(spark, data).repartition(5)
    g = matrix(gram(vectors(df, list(FEATURES), ["symbol"]), ["symbol"], 3).toPandas(), 3)
    x = np.column_stack([np.ones(200), *[data[f] for f in FEATURES]])
    np.testing.assert_allclose(g, x.T @ x, rtol=1e-10)


def test_lag_vectors(spark):
    data = simulate(n=30)
    rows = lag_vectors(frame(spark, data), ["close"], 3, by=["symbol"], step_seconds=HOUR).orderBy("ts").collect()
    assert len(rows) == 27
    np.testing.assert_allclose(rows[0]["v"], [1.0, *data["close"][:4]])


def test_arimax_equals_three_regressions(spark):
    data = simulate()
    rows = frame(spark, data)
    windows = Whole().windows(rows, ["symbol"])
    sums, ends = linear.lagged_sums(rows, DESIGN, windows, linear.ARMA_LAGS, Whole(1))
    fit = {r["target"]: r for r in linear.arimax_fit(sums, ends, DESIGN).collect()}["close"]
    b, phi, theta, u, e = brute_arma(data, N)
    np.testing.assert_allclose(fit["coef"], b, rtol=1e-6)
    np.testing.assert_allclose([fit["phi"], fit["theta"], fit["u_last"], fit["e_last"]], [phi, theta, u, e], rtol=1e-5)
    assert abs(fit["phi"] - 0.7) < 0.1 and abs(fit["theta"] - 0.3) < 0.12 and abs(fit["coef"][0] - 2.0) < 0.1


def test_var_picks_order_and_equals_regression(spark):
    rng = np.random.default_rng(4)
    n = 800
    a = np.zeros((n, 2))
    m1, m2 = np.array([[0.4, 0.2], [0.0, 0.3]]), np.array([[0.2, 0.0], [0.1, 0.3]])
    for i in range(2, n):
        a[i] = [1.0, -0.5] + m1 @ a[i - 1] + m2 @ a[i - 2] + rng.normal(size=2)
    data = {"close": a[:, 0], "x1_close": a[:, 1]}
    design = Design(("close",), ("x1_close",), HOUR, ("symbol",))
    rows = frame(spark, data)
    windows = Whole().windows(rows, ["symbol"])
    sums, ends = linear.lagged_sums(rows, design, windows, linear.ARMA_LAGS, Whole(1))
    models = linear.var_fit(sums, ends, design, limit=20)
    fit = models.collect()[0]
    assert fit["lag_order"] == 2 and fit["columns"] == ["close", "x1_close"]
    k = linear.ARMA_LAGS
    z = np.column_stack([np.ones(n - k), *[a[k - j : n - j] for j in (1, 2)]])
    b = np.linalg.lstsq(z, a[k:], rcond=None)[0]
    np.testing.assert_allclose(fit["coef"], b[:, 0], rtol=1e-6)
    path = linear.var_forecast(models, design, steps=3).orderBy("k").collect()
    state = [a[-1], a[-2]]
    for row in path:
        value = b[0] + np.concatenate(state) @ b[1:]
        state = [value, state[0]]
        np.testing.assert_allclose(row["yhat"], value[0], rtol=1e-6)


def test_additive_recovers_trend_bend_and_week(spark):
    n = 1200
    rng = np.random.default_rng(2)
    t = np.arange(1, n + 1)
    week = np.sin(2 * np.pi * t / (7 * 24))
    x = rng.normal(size=n)
    y = 100 + 0.05 * t - 0.1 * np.maximum(t - 480, 0) + 4 * week + 2 * x + rng.normal(scale=0.2, size=n)
    data = {"close": y, "x1_close": x}
    design = Design(("close",), ("x1_close",), HOUR, ("symbol",))
    rows = frame(spark, data)
    whole = Whole()
    windows = whole.windows(rows, ["symbol"])
    models = additive.additive_fit(rows, design, windows, whole)
    future = rows.withColumn("fold", F.lit(0)).withColumn("k", F.col("_pos"))
    got = additive.additive_forecast(models, future, design).orderBy("k").collect()
    fitted = np.array([r["yhat"] for r in got])
    assert np.sqrt(np.mean((fitted - y) ** 2)) < 0.6
    model = models.collect()[0]
    assert abs(model["coef"][-1] - 2) < 0.1 and len(model["cuts"]) == 25


def direct_design(data, cuts_rows, n):
    """The additive design matrix written out row by row."""
    t = np.arange(1, n + 1) / additive.T_UNIT
    return np.column_stack([np.maximum(t - c / additive.T_UNIT, 0) for c in cuts_rows])


def test_hinge_sums_from_running_sums():
    rng = np.random.default_rng(0)
    n, cuts = 300, [60, 120, 180]
    t = np.arange(1, n + 1) / additive.T_UNIT
    z = rng.normal(size=n)
    y = rng.normal(size=n)
    n_base = 2 + additive.N_SEASONAL
    base = np.zeros((n, n_base + 1))
    base[:, 0], base[:, 1], base[:, 2], base[:, -1] = 1, t, z, y
    upto = {c: base[:c].T @ base[:c] for c in [*cuts, n]}
    hinges = direct_design(None, cuts, n)
    used = np.zeros(n_base, dtype=bool)
    used[:3] = True
    coef, deltas = additive.penalised_trend(upto[n], [(c / additive.T_UNIT, upto[c]) for c in cuts], n_base, n_base, used)
    # the same penalised problem solved on the rows themselves
    x = np.column_stack([base[:, :3], hinges])
    length, y_size = n / additive.T_UNIT, np.sqrt(np.mean(y**2))
    scale = np.array([1, 1 / length, 1, *[1 / length] * 3])
    xs, ys = x * scale, y / y_size
    prior = np.array([1 / 25, 1 / 25, 1 / 100, 0, 0, 0], dtype=float)
    delta, noise = np.full(3, additive.CHANGEPOINT_SCALE), 0.25
    for _ in range(25):
        prior[3:] = 1 / (additive.CHANGEPOINT_SCALE * np.maximum(np.abs(delta), 1e-6))
        w = np.linalg.solve(xs.T @ xs / noise + np.diag(prior), xs.T @ ys / noise)
        delta = w[3:]
        noise = max(np.mean((ys - xs @ w) ** 2), 1e-9)
    np.testing.assert_allclose(np.r_[coef[:3], deltas], w * scale * y_size, rtol=1e-4, atol=1e-8)


def test_sequence_regression_equals_ridge_on_sequences(spark):
    data = simulate(n=400)
    steps = 3
    x = np.column_stack([data[f] for f in FEATURES])
    data["close"] = np.r_[np.zeros(steps), [x[i - 1, 0] - 2 * x[i - 3, 1] for i in range(steps, 400)]]
    rows = frame(spark, data)
    cutter = Whole(5)
    windows = cutter.windows(rows, ["symbol"])
    sums, ends = linear.lagged_sums(rows, DESIGN, windows, steps, cutter, validation=True)
    scalers = linear.window_scalers(rows, DESIGN, windows, cutter)
    models = linear.sequence_fit(sums, ends.join(scalers, ["symbol", "fold"]), DESIGN, steps)
    sequences = linear.feature_sequences(rows, DESIGN, steps, by=["symbol"]).withColumn("fold", F.lit(0)).withColumn("k", F.col("_pos"))
    got = linear.sequence_forecast(models, sequences, DESIGN).filter("target = 'close'").orderBy("k").collect()
    np.testing.assert_allclose([r["yhat"] for r in got], data["close"][steps:], atol=1e-3)


def test_selection_matches_direct_correlation(spark):
    data = simulate(n=240)
    rng = np.random.default_rng(9)
    data["noise"] = rng.normal(size=240)
    data["flat"] = np.ones(240)
    design = Design(("close", "spread"), (*FEATURES, "noise", "flat"), HOUR, ("symbol",))
    folds = Folds(120, 60, 60)
    rows = frame(spark, data)
    windows = folds.windows(rows, ["symbol"])
    scores = window_scores(rows, design, windows, folds)
    got = {(r["fold"], r["feature"]): r["score"] for r in scores.collect()}
    for fold in (0, 1):
        n = 120 + 60 * fold
        y = (data["close"][:n] + data["spread"][:n]) / 2
        for f in (*FEATURES, "noise"):
            r2 = np.corrcoef(data[f][:n], y)[0, 1] ** 2
            np.testing.assert_allclose(got[fold, f], r2 / (1 - r2) * (n - 2), rtol=1e-6)
        assert got[fold, "flat"] is None
    chosen = select_features(scores, ["symbol", "fold"], 2).collect()
    assert len(chosen) == 2 and all(r["selected"] == list(FEATURES) for r in chosen)


@pytest.fixture(scope="module")
def result(spark):
    data = simulate()
    rows = frame(spark, data).unionByName(frame(spark, simulate(5, 700), "b"))
    return data, backtest(rows, DESIGN, Folds(300, 60, 60), top_k=2, var_limit=20, sequence_steps=3)


def test_backtest_folds_are_chronological(result):
    _, done = result
    got = done.predictions.filter("symbol = 'a'").groupBy("fold").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_distinct("ts").alias("n")).orderBy("fold").collect()
    assert [r["fold"] for r in got] == list(range(10)) and all(r["n"] == 60 for r in got)
    assert all(x["b"] < y["a"] for x, y in zip(got, got[1:]))
    short = done.predictions.filter("symbol = 'b'").groupBy("fold").agg(F.count_distinct("ts").alias("n")).orderBy("fold").collect()
    assert [r["n"] for r in short] == [60] * 6 + [40]


def test_backtest_arimax_equals_refit_per_fold(result):
    data, done = result
    rows = done.predictions.filter("symbol = 'a' AND model = 'arimax' AND target = 'close' AND fold = 4").orderBy("k").collect()
    upto = 300 + 4 * 60
    b, phi, theta, u, e = brute_arma(data, upto)
    x = np.column_stack([data[f] for f in FEATURES])
    want = [x[upto + k - 1] @ b + phi ** (k - 1) * (phi * u + theta * e) for k in range(1, 61)]
    np.testing.assert_allclose([r["predicted"] for r in rows], want, rtol=1e-5)


def test_backtest_metrics(result):
    _, done = result
    table = done.metrics(["symbol"], step_seconds=HOUR).collect()
    assert len(table) == (10 + 7) * 4 * 2
    for r in table:
        assert (r["mape"] is None) == ("spread" in r["target"]) and 0 <= r["dir_acc"] <= 1 and r["rmse"] >= r["mae"] - 1e-12
    arimax = [r["mae"] for r in table if r["model"] == "arimax" and r["target"] == "close"]
    assert np.mean(arimax) < 2.0


@pytest.mark.parametrize("m, step", [(300, 60), (250, 60), (50, 70), (61, 60)])
def test_sums_of_growing_windows(spark, m, step):
    """Windows end with a piece whether or not their length is a multiple of the step."""
    from barloom.models.gram import running_gram
    from barloom.models.windows import END, pick

    data = simulate(n=420)
    folds = Folds(m, 60, step)
    rows = frame(spark, data)
    windows = folds.windows(rows, ["symbol"])
    cut = folds.cut(rows, windows, ["symbol"])
    sums = running_gram(gram(vectors(cut, list(FEATURES), ["symbol", "piece"]), ["symbol", "piece"], 3), ["symbol"])
    got = pick(sums, folds.places(windows, ["symbol"]), ["symbol"]).toPandas()
    assert sorted(got["fold"].unique()) == [f for f in range(50) if m + f * step < 420]
    x = np.column_stack([np.ones(420), *[data[f] for f in FEATURES]])
    for (fold, slot), part in got.groupby(["fold", "slot"]):
        upto = int(part["at"].iloc[0])
        assert upto == m + fold * step if slot == END else upto <= m + fold * step
        np.testing.assert_allclose(matrix(part, 3), x[:upto].T @ x[:upto], rtol=1e-9)


def test_places_of_a_whole_window(spark):
    from barloom.models.gram import running_gram
    from barloom.models.windows import END, VALID, pick

    for n in (7, 130, 419):
        data = simulate(n=n)
        whole = Whole()
        rows = frame(spark, data)
        windows = whole.windows(rows, ["symbol"])
        cut = whole.cut(rows, windows, ["symbol"])
        sums = running_gram(gram(vectors(cut, list(FEATURES), ["symbol", "piece"]), ["symbol", "piece"], 3), ["symbol"])
        got = pick(sums, whole.places(windows, ["symbol"]), ["symbol"]).toPandas()
        x = np.column_stack([np.ones(n), *[data[f] for f in FEATURES]])
        at = {slot: int(part["at"].iloc[0]) for slot, part in got.groupby("slot")}
        for slot, part in got.groupby("slot"):
            np.testing.assert_allclose(matrix(part, 3), x[: at[slot]].T @ x[: at[slot]], rtol=1e-9)
        assert at[END] == n and 0 < at[VALID] < n and len(at) == 2 + min(25, int(min(n, 125) * 0.8))


def test_series_rows_are_numbered_from_one(spark):
    """Windows of training rows are cut by position, so rows dropped at the start must not leave a gap."""
    rows, design = series_table(to_spark(spark, random_bars(300)), ["rsi", "roc"], step_seconds=HOUR)
    got = {r["symbol"]: (r["low"], r["high"], r["n"]) for r in rows.groupBy("symbol").agg(F.min("_pos").alias("low"), F.max("_pos").alias("high"), F.count("*").alias("n")).collect()}
    assert got == {"a": (1, 267, 267), "b": (1, 267, 267)}
    cuts = Forecaster(rows, design, SHORT).additive_models().collect()
    assert {len(r["cuts"]) for r in cuts} == {25}
