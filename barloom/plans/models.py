"""Model queries: fits and forecasts of many series, and the walk-forward backtest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DAY, HOUR, LONG, SHORT
from barloom.models import backtest as bt
from barloom.models import stored
from barloom.models.design import OHLCV, features_then_fill, fill_then_features, series_table, training_table
from barloom.models.forecast import Forecaster
from barloom.models.gram import gram, matrix, solve, vectors
from barloom.models.windows import Folds
from barloom.operators import metrics
from barloom.models.linear import ARMA_LAGS, LONG_AR
from barloom.operators.indicators import INDICATORS
from barloom.sources import store
from barloom.session import work_path, written
from barloom.plans.catalog import DB, HB, HOURLY_SYMBOLS, HOURLY_TARGET, TARGETS, Tables, panel_sql, query
from barloom.plans.windows import INDICATOR_SELECT, SET_SQL, indicator_ctes

SERIES_FEATURES = ["open", "volume", *INDICATORS]
SEQUENCE_STEPS = SHORT.sequence_steps


@query("least_squares", f"WITH {DB} SELECT symbol, regr_intercept(close, volume) AS intercept, regr_slope(close, volume) AS slope, CAST(count(*) AS BIGINT) AS n FROM db GROUP BY symbol", doubles="intercept slope", digits=4)
def least_squares(t: Tables) -> DataFrame:
    """Straight lines for all symbols from one table of sums of products."""
    sums = gram(vectors(t.daily(), ["volume", "close"], ["symbol"]), ["symbol"], 3)

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        g = matrix(pdf, 3)
        b = solve(g[:2, :2], g[:2, 2])
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "intercept": [b[0]], "slope": [b[1]], "n": [round(g[0, 0])]})

    return sums.groupBy("symbol").applyInPandas(line, "symbol STRING, intercept DOUBLE, slope DOUBLE, n LONG")


def _series(t: Tables, features: list[str] = SERIES_FEATURES) -> Forecaster:
    rows, design = series_table(t.hourly(), features, step_seconds=HOUR)
    return Forecaster(rows, design, SHORT)


def _flat(models: DataFrame) -> DataFrame:
    return models.withColumn("coef", F.transform("coef", lambda x: F.round(x, 6)))


# Some indicators are sums of others, so coefficients are not unique; residuals are. The reference leaves such columns out.
_INDEPENDENT = [c for c in SERIES_FEATURES if c not in ("macd", "macd_hist", "bb_middle", "bb_lower", "bb_width")]


def _least_squares_sql(name: str, source: str, n: int) -> str:
    """CTEs that solve z[n + 1] ~ z[1..n] over the rows (symbol, target, z) of `source` by elimination: `name` (symbol, target, b)."""
    return f"""{name}_g AS (SELECT symbol, target, i, j, sum(z[i] * z[j]) AS v FROM {source}, range(1, {n + 1}) AS a(i), range(1, {n + 2}) AS c(j) GROUP BY ALL),
  {name}_r AS (SELECT symbol, target, i, list(v ORDER BY j) AS r FROM {name}_g GROUP BY ALL),
  {name}_e AS (SELECT symbol, target, 1 AS k, list(r ORDER BY i) AS m FROM {name}_r GROUP BY symbol, target
    UNION ALL SELECT symbol, target, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN r ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END)
    FROM {name}_e WHERE k <= {n}),
  {name} AS (SELECT symbol, target, list_transform(m, lambda r, i: r[{n + 1}] / r[i]) AS b FROM {name}_e WHERE k = {n + 1})"""


_U = "PARTITION BY symbol, target ORDER BY pos"
_ARMA_SQL = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 33 AS pos FROM ({SET_SQL})),
  y AS (SELECT symbol, CAST(pos AS BIGINT) AS pos, unnest({TARGETS}) AS target, unnest([close, greatest(high - close, 0), greatest(close - low, 0)]) AS y,
    [{", ".join(f"coalesce({c}, 0)" for c in _INDEPENDENT)}] AS x FROM s WHERE pos > 0),
  z1 AS (SELECT symbol, target, list_append(x, y) AS z FROM y WHERE pos > {ARMA_LAGS}), {_least_squares_sql("r1", "z1", len(_INDEPENDENT))},
  u AS (SELECT symbol, target, pos, y - list_dot_product(x, b) AS u FROM y JOIN r1 USING (symbol, target)),
  l AS (SELECT *, [{", ".join(f"lag(u, {k}) OVER ({_U})" for k in range(1, LONG_AR + 1))}] AS l FROM u),
  z2 AS (SELECT symbol, target, list_append(l, u) AS z FROM l WHERE pos > {ARMA_LAGS}), {_least_squares_sql("r2", "z2", LONG_AR)},
  e AS (SELECT symbol, target, pos, u, u - list_dot_product(l, b) AS e FROM l JOIN r2 USING (symbol, target) WHERE pos > {LONG_AR}),
  p AS (SELECT *, lag(u) OVER ({_U}) AS u1, lag(e) OVER ({_U}) AS e1 FROM e),
  z3 AS (SELECT symbol, target, [u1, e1, u] AS z FROM p WHERE pos > {ARMA_LAGS}), {_least_squares_sql("r3", "z3", 2)},
  f AS (SELECT symbol, target, greatest(least(b[1], 0.999e0), -0.999e0) AS phi, b FROM r3)
  SELECT symbol, target, any_value(phi) AS phi, CASE WHEN abs(any_value(b[1])) > 0.999e0 THEN sum(e1 * (u - phi * u1)) / sum(e1 * e1) ELSE any_value(b[2]) END AS theta,
    last(u ORDER BY pos) AS u_last, last(e ORDER BY pos) AS e_last, count(*) AS n, max(pos) AS train_rows
  FROM p JOIN f USING (symbol, target) WHERE pos > {ARMA_LAGS} GROUP BY symbol, target"""


@query("arimax_fit", _ARMA_SQL, doubles="phi theta u_last e_last", digits=4)
def arimax_fit(t: Tables) -> DataFrame:
    """What the fit on all features settles: the error process and where it stands; regression coefficients are not unique."""
    return _series(t).arimax_models().drop("fold", "coef")


@query("arimax_forecast")
def arimax_forecast(t: Tables) -> DataFrame:
    return _series(t).arimax()


@query("var_fit")
def var_fit(t: Tables) -> DataFrame:
    return _flat(_series(t).var_models())


@query("var_forecast")
def var_forecast(t: Tables) -> DataFrame:
    return _series(t).var()


@query("additive_fit")
def additive_fit(t: Tables) -> DataFrame:
    return _flat(_series(t).additive_models())


@query("additive_forecast")
def additive_forecast(t: Tables) -> DataFrame:
    return _series(t).additive()


@query("sequence_fit")
def sequence_fit(t: Tables) -> DataFrame:
    return _flat(_series(t).sequence_models(SHORT.predict_sequence_steps))


@query("sequence_regression")
def sequence_regression(t: Tables) -> DataFrame:
    return _series(t).sequence(SHORT.predict_sequence_steps)


# --- training with hold-out, stored models --------------------------------------------------------------------------


def _trained(t: Tables) -> tuple[DataFrame, stored.Trained]:
    rows, design = series_table(t.hourly(), SERIES_FEATURES, step_seconds=HOUR)
    rows = written(rows, "series")
    return rows, stored.train(rows, design, SHORT)


@query("holdout_evaluation")
def holdout_evaluation(t: Tables) -> DataFrame:
    """Errors of all models on the last fifth of each series; features are selected and models fitted on the rows before."""
    return _trained(t)[1].result.metrics(["symbol"], step_seconds=HOUR).drop("fold")


_MODEL_ROWS = "(SELECT DISTINCT event_type AS symbol FROM events) AS s, (VALUES ('arimax'), ('var'), ('additive'), ('sequence')) AS m(model), (VALUES ('close'), ('high_spread'), ('low_spread')) AS c(target)"


@query("model_store", f"SELECT symbol, model, target, CAST({SHORT.steps} AS BIGINT) AS n_steps, CAST({SHORT.steps} AS BIGINT) AS n_equal FROM {_MODEL_ROWS}")
def model_store(t: Tables) -> DataFrame:
    """Trained models saved and loaded again: steps that the loaded ones forecast just as the fitted ones do."""
    rows, trained = _trained(t)
    path = store.save_models(stored.packed(trained, SHORT, "v1"), work_path(t.spark, "models"))
    loaded = stored.StoredForecaster(rows, trained.design, SHORT, store.load_models(t.spark, path, horizon=SHORT.name))
    fresh = stored.FittedForecaster(rows, trained, SHORT, future=loaded.future())
    keys = ["symbol", "model", "target", "k"]
    both = fresh.all().select(*keys, F.col("yhat").alias("a")).join(loaded.all().select(*keys, F.col("yhat").alias("b")), keys, "left")
    return both.groupBy("symbol", "model", "target").agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum(F.col("a").eqNullSafe(F.col("b")).cast("long")).alias("n_equal")
    )


# --- the two orders of filling and indicators -----------------------------------------------------------------------

_KEPT = [*OHLCV, *INDICATORS]
_KEPT_COLS = [f"{s}_{f}" for s in HOURLY_SYMBOLS for f in _KEPT]


def _filled_sql(c: str) -> str:
    back, ahead = "ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    at = f"CASE WHEN {c} IS NOT NULL THEN pos END"
    left, right = f"last_value({c} IGNORE NULLS) OVER ({back})", f"first_value({c} IGNORE NULLS) OVER ({ahead})"
    left_at, right_at = f"last_value({at} IGNORE NULLS) OVER ({back})", f"first_value({at} IGNORE NULLS) OVER ({ahead})"
    return f"coalesce({c}, {left} + ({right} - {left}) / nullif({right_at} - {left_at}, 0) * (pos - {left_at}), {left}, {right}, 0) AS {c}"


def _missing_sql(cols: list[str]) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INT)" for c in cols)


@query(
    "features_then_fill",
    f"""WITH ind AS ({SET_SQL}), {panel_sql('ind', 'panel', HOURLY_SYMBOLS, _KEPT)},
    numbered AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM panel WHERE {_missing_sql(_KEPT_COLS)} <= {SHORT.max_missing_train.number})
    SELECT ts, CAST(pos AS BIGINT) AS pos, {", ".join(_filled_sql(c) for c in _KEPT_COLS)} FROM numbered""",
    doubles=" ".join(_KEPT_COLS),
)
def features_then_fill_query(t: Tables) -> DataFrame:
    """Indicators on each symbol's own bars, then one timeline without gaps."""
    out = features_then_fill(t.hourly(), HOURLY_SYMBOLS, max_missing=SHORT.max_missing_train, step_seconds=HOUR)
    return out.withColumnRenamed("_pos", "pos")


_CELLS = ["open", "high", "low", "close", "volume"]
_CELL_COLS = [f"{s}_{f}" for s in HOURLY_SYMBOLS for f in _CELLS]


@query(
    "fill_then_features",
    f"""WITH {HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, _CELLS)},
    numbered AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM panel WHERE {_missing_sql(_CELL_COLS)} <= 15),
    filled AS (SELECT ts, pos, {", ".join(_filled_sql(c) for c in _CELL_COLS)} FROM numbered),
    long AS ({" UNION ALL ".join(f"SELECT ts, '{s}' AS symbol, {', '.join(f'{s}_{c} AS {c}' for c in OHLCV)} FROM filled" for s in HOURLY_SYMBOLS)}),
    {indicator_ctes('long')}, ind AS ({INDICATOR_SELECT})
    SELECT filled.ts, CAST(pos AS BIGINT) AS pos, {", ".join(f"max(CASE WHEN symbol = '{s}' THEN ind.{f} END) AS {s}_{f}" for s in HOURLY_SYMBOLS for f in _KEPT)} FROM filled JOIN ind ON ind.ts = filled.ts GROUP BY filled.ts, pos""",
    doubles=" ".join(_KEPT_COLS),
)
def fill_then_features_query(t: Tables) -> DataFrame:
    """One timeline without gaps, then indicators on the filled bars."""
    out = fill_then_features(t.hourly(), HOURLY_SYMBOLS, max_missing=SHORT.max_missing_predict, step_seconds=HOUR)
    return out.withColumnRenamed("_pos", "pos")


def _training(t: Tables) -> tuple[DataFrame, object]:
    panel = features_then_fill(t.hourly(), HOURLY_SYMBOLS, max_missing=SHORT.max_missing_train, step_seconds=HOUR)
    return training_table(panel, HOURLY_TARGET, step_seconds=HOUR)


def _backtest(t: Tables) -> bt.Result:
    """The target asset against the features of all assets."""
    rows, design = _training(t)
    folds = Folds(SHORT.fold_min_train, SHORT.fold_test, SHORT.fold_step)
    return bt.backtest(rows, design, folds, top_k=SHORT.backtest_features, var_limit=SHORT.var_columns, sequence_steps=SEQUENCE_STEPS)


@query("backtest")
def backtest(t: Tables) -> DataFrame:
    return _backtest(t).metrics(step_seconds=HOUR)


@query("backtest_models_summary")
def backtest_models_summary(t: Tables) -> DataFrame:
    return metrics.backtest_summary(_backtest(t).metrics(step_seconds=HOUR))


@query("backtest_series")
def backtest_series(t: Tables) -> DataFrame:
    """Daily series, each one backtested on its own indicators, all in the same jobs."""
    rows, design = series_table(t.daily(), SERIES_FEATURES, step_seconds=DAY)
    folds = Folds(LONG.fold_min_train, LONG.fold_test, LONG.fold_step)
    result = bt.backtest(rows, design, folds, top_k=LONG.backtest_features, var_limit=LONG.var_columns, sequence_steps=LONG.sequence_steps)
    return result.metrics(["symbol"], step_seconds=DAY)
