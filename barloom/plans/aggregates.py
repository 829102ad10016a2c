"""Quality checks, error measures, feature scores and other aggregations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import HOUR, SHORT
from barloom.models import folds
from barloom.operators import clean, features, metrics, quality, views
from barloom.operators.quantiles import box_statistics
from barloom.plans.catalog import (
    CELLS, DB, DIRTY, EVAL_SQL, HB, HITS, HOURLY_SYMBOLS, MAE, MAPE, PRICES, RMSE, SCORE_KEYS, SCORED, SIMPLE_MODELS, SMAPE,
    TARGETS, THIN, Tables, panel_sql, query, scored,
)
from barloom.plans.rows import REASON

_GROUP = "GROUP BY symbol, model, target"


@query("freshness", f"""WITH {HB} SELECT max(ts) AS newest, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) <= 21600 AS freshness_ok FROM hb""")
def freshness(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return quality.freshness(t.hourly(), as_of=as_of, limit_seconds=SHORT.fresh_seconds)


@query("rows_per_symbol", f"WITH {HB} SELECT symbol, CAST(count(close) AS BIGINT) AS n, count(close) > 100 AS enough FROM hb GROUP BY symbol")
def rows_per_symbol(t: Tables) -> DataFrame:
    return quality.rows_per_symbol(t.hourly())


_ETL_SQL = f"""WITH {THIN}, line AS (SELECT ts, ts <= TIMESTAMP '2024-01-25 00:00:00' AS ok,
     1 - sum(CAST(open IS NOT NULL AS INT) + CAST(high IS NOT NULL AS INT) + CAST(low IS NOT NULL AS INT) + CAST(close IS NOT NULL AS INT) + 1) / 25 <= 0.2 AS complete FROM thin GROUP BY ts),
   counts AS (SELECT CAST(count(*) AS BIGINT) AS original_rows, CAST(count(*) FILTER (WHERE ok AND complete) AS BIGINT) AS after_cleaning_rows,
     CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS rows_out_of_range FROM line)
   SELECT *, CASE WHEN after_cleaning_rows = 0 THEN 0e0 ELSE greatest((original_rows - after_cleaning_rows) / original_rows, 0) END AS missing_rate, CAST(20 AS DOUBLE) AS missing_threshold_percent FROM counts"""


def _etl(t: Tables) -> DataFrame:
    gaps = clean.timeline_missing(t.thin(), CELLS)
    end = F.lit("2024-01-25").cast("timestamp_ntz")
    return quality.etl_quality(
        gaps, in_range=F.col("ts") <= end, complete=F.col("missing") / F.col("cells") <= SHORT.max_missing_etl.share,
        threshold=SHORT.max_missing_etl.share,
    )


@query("etl_quality", _ETL_SQL, doubles="missing_rate")
def etl_quality(t: Tables) -> DataFrame:
    return _etl(t)


@query("quality_gate", f"SELECT missing_rate, CASE WHEN coalesce(missing_rate, 1) <= 0.10 THEN 'ok_path' ELSE 'fail_path' END AS branch FROM ({_ETL_SQL})", doubles="missing_rate")
def quality_gate(t: Tables) -> DataFrame:
    return quality.gate(_etl(t)).select("missing_rate", "branch")


@query("quality_gate_strict", f"SELECT missing_rate, after_cleaning_rows, CASE WHEN coalesce(missing_rate, 1) <= 0.10 AND after_cleaning_rows > 0 THEN 'ok_path' ELSE 'fail_path' END AS branch FROM ({_ETL_SQL})", doubles="missing_rate")
def quality_gate_strict(t: Tables) -> DataFrame:
    return quality.gate(_etl(t), strict=True).select("missing_rate", "after_cleaning_rows", "branch")


def _good(test: str) -> str:
    cells = " + ".join(f"CAST(coalesce({test.format(c=c)}, false) AS INT)" for c in PRICES)
    return f"CAST(sum(CASE WHEN reason IS NULL THEN {cells} ELSE 0 END) AS BIGINT)"


@query("clean_report", f"""WITH {DIRTY}, r AS (SELECT *, {REASON} AS reason FROM dirty)
  SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS rows_after,
  {", ".join(f"CAST(count(*) FILTER (WHERE reason = '{x}') AS BIGINT) AS {x}" for x in ("all_missing", "infinite", "all_zero", "abnormal"))},
  {_good("{c} IS NULL")} AS missing_cells, {_good("isinf({c})")} AS infinite_cells, {_good("{c} = 0")} AS zero_cells FROM r""")
def clean_report(t: Tables) -> DataFrame:
    return clean.clean_report(t.dirty())


@query("mae_rmse", f"WITH {HITS} SELECT symbol, model, target, {MAE} AS mae, {RMSE} AS rmse FROM hits {_GROUP}", doubles="mae rmse")
def mae_rmse(t: Tables) -> DataFrame:
    return scored(t).groupBy(*SCORE_KEYS).agg(metrics.mae().alias("mae"), metrics.rmse().alias("rmse"))


@query("mape", f"WITH {HITS} SELECT symbol, model, target, {MAPE} AS mape FROM hits WHERE target = 'close' {_GROUP}", doubles="mape")
def mape(t: Tables) -> DataFrame:
    prices = scored(t).filter(~metrics.is_spread(F.col("target")))
    return prices.groupBy(*SCORE_KEYS).agg(metrics.mape().alias("mape"))


@query("smape", f"WITH {HITS} SELECT symbol, model, target, {SMAPE} AS smape FROM hits WHERE target <> 'close' {_GROUP}", doubles="smape")
def smape(t: Tables) -> DataFrame:
    spreads = scored(t).filter(metrics.is_spread(F.col("target")))
    return spreads.groupBy(*SCORE_KEYS).agg(metrics.smape().alias("smape"))


@query("direction_accuracy", f"WITH {HITS} SELECT symbol, model, target, avg(CAST(hit AS DOUBLE)) AS dir_acc FROM hits {_GROUP}", doubles="dir_acc")
def direction_accuracy(t: Tables) -> DataFrame:
    return metrics.direction_accuracy(scored(t, positions=True), by=SCORE_KEYS, step_seconds=HOUR)


@query("corr_actual_pred", f"WITH {SCORED} SELECT symbol, model, target, corr(actual, predicted) AS r FROM scored {_GROUP}", doubles="r")
def corr_actual_pred(t: Tables) -> DataFrame:
    return scored(t).groupBy(*SCORE_KEYS).agg(metrics.correlation(F.col("actual"), F.col("predicted")).alias("r"))


@query("evaluate", f"""WITH {HITS}, found AS (SELECT symbol, model, target, {EVAL_SQL} FROM hits {_GROUP})
  SELECT s.symbol, m.model, c.target, coalesce(n, 0) AS n, mae, rmse, mape, smape, dir_acc FROM (SELECT DISTINCT symbol FROM hb) AS s,
  (VALUES ('last'), ('season'), ('absent')) AS m(model), (VALUES ('close'), ('high_spread'), ('low_spread')) AS c(target)
  LEFT JOIN found ON found.symbol = s.symbol AND found.model = m.model AND found.target = c.target""", doubles="mae rmse mape smape dir_acc")
def evaluate(t: Tables) -> DataFrame:
    """A model that gave no forecast has a row of NULLs."""
    found = metrics.evaluate(scored(t, positions=True), by=SCORE_KEYS, step_seconds=HOUR)
    series = t.table("events").select(F.col("event_type").alias("symbol")).distinct()
    return metrics.with_failed(found, series, [*SIMPLE_MODELS, "absent"], TARGETS, ["symbol"])


# --- walk-forward folds of the simple predictions -------------------------------------------------------------------

M, S = SHORT.fold_min_train, SHORT.fold_step
LINE = f"""line AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM hb)),
tests AS (SELECT ts, pos, CAST((pos - 1 - {M}) // {S} AS INT) AS fold FROM line WHERE pos > {M}),
bounds AS (SELECT t.fold, (SELECT min(ts) FROM line) AS train_start, e.ts AS train_end, CAST(e.pos AS BIGINT) AS train_rows,
   min(t.ts) AS test_start, max(t.ts) AS test_end, CAST(count(*) AS BIGINT) AS test_rows
   FROM tests t JOIN line e ON e.pos = {M} + t.fold * {S} GROUP BY t.fold, e.ts, e.pos)"""
FOLD_HITS = SCORED + f""", {LINE}, moves AS (SELECT s.*, t.fold, lag(actual) OVER w AS a0, lag(predicted) OVER w AS p0
  FROM scored s JOIN tests t ON t.ts = s.ts WINDOW w AS (PARTITION BY t.fold, symbol, model, target ORDER BY s.ts)),
hits AS (SELECT *, actual - predicted AS e,
  (coalesce(CASE WHEN a0 = 0 THEN actual > 0 ELSE actual / a0 - 1 > 0 END, false)
   = coalesce(CASE WHEN p0 = 0 THEN predicted > 0 ELSE predicted / p0 - 1 > 0 END, false)) AS hit FROM moves),
per_fold AS (SELECT fold, symbol, model, target, {EVAL_SQL} FROM hits GROUP BY fold, symbol, model, target)"""


def fold_evaluation(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(fold bounds, errors of the simple models per fold, symbol, model and target)."""
    line = folds.timeline(t.hourly(), step_seconds=HOUR)
    size = {"min_train": M, "test": SHORT.fold_test, "step": S}
    tests = folds.with_test_folds(line, **size).select("ts", "fold")
    pairs = scored(t).join(tests, "ts")
    per_fold = metrics.evaluate(pairs, by=["fold", *SCORE_KEYS], step_seconds=HOUR)
    return folds.fold_bounds(line, **size), per_fold


@query("fold_metrics", f"WITH {FOLD_HITS} SELECT p.*, b.* EXCLUDE (fold) FROM per_fold p JOIN bounds b ON b.fold = p.fold", doubles="mae rmse mape smape dir_acc")
def fold_metrics(t: Tables) -> DataFrame:
    bounds, per_fold = fold_evaluation(t)
    return per_fold.join(bounds, "fold")


_MEANS = ", ".join(f"avg({m}) AS {m}_mean" for m in ("mae", "rmse", "mape", "smape", "dir_acc"))
_DEVS = ", ".join(f"stddev_samp({m}) AS {m}_std" for m in ("mae", "rmse", "mape", "smape"))


@query("backtest_summary", f"WITH {FOLD_HITS} SELECT symbol, model, target, CAST(count(mae) AS BIGINT) AS n_folds, {_MEANS}, {_DEVS} FROM per_fold GROUP BY symbol, model, target",
       doubles="mae_mean rmse_mean mape_mean smape_mean dir_acc_mean mae_std rmse_std mape_std smape_std")
def backtest_summary(t: Tables) -> DataFrame:
    return metrics.backtest_summary(fold_evaluation(t)[1], SCORE_KEYS)


@query("concat_folds", f"WITH {FOLD_HITS} SELECT fold, symbol, model, target, ts, actual, predicted FROM moves", doubles="actual predicted")
def concat_folds(t: Tables) -> DataFrame:
    """Test rows of all folds in one table; folds are a column, so appending them is no extra work."""
    line = folds.timeline(t.hourly(), step_seconds=HOUR)
    tests = folds.with_test_folds(line, min_train=M, test=SHORT.fold_test, step=S).select("ts", "fold")
    return scored(t).join(tests, "ts").select("fold", *SCORE_KEYS, "ts", "actual", "predicted")


@query("metric_trend", f"""WITH {FOLD_HITS}, l AS (SELECT fold, symbol, model, target, unnest(['mae', 'rmse', 'mape', 'smape', 'dir_acc']) AS metric, unnest([mae, rmse, mape, smape, dir_acc]) AS value FROM per_fold)
  SELECT fold, symbol, model, target, metric, value, CAST(row_number() OVER (PARTITION BY symbol, model, target, metric ORDER BY fold) - 1 AS INT) AS n FROM l WHERE value IS NOT NULL""", doubles="value")
def metric_trend(t: Tables) -> DataFrame:
    return views.metric_trend(metrics.long_metrics(fold_evaluation(t)[1], ["fold", *SCORE_KEYS]), [*SCORE_KEYS, "metric"])


@query("error_distribution", f"""WITH {SCORED}, e AS (SELECT *, actual - predicted AS err FROM scored),
  q AS (SELECT symbol, model, target, CAST(count(*) AS BIGINT) AS n, quantile_cont(err, 0.25) AS q1, quantile_cont(err, 0.5) AS median, quantile_cont(err, 0.75) AS q3 FROM e {_GROUP})
  SELECT symbol, model, target, n, q1, median, q3, min(err) FILTER (WHERE i) AS whisker_low, max(err) FILTER (WHERE i) AS whisker_high, CAST(count(*) FILTER (WHERE NOT i) AS BIGINT) AS outliers
  FROM (SELECT e.*, q.* EXCLUDE (symbol, model, target), err BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS i FROM e JOIN q USING (symbol, model, target)) GROUP BY ALL""",
       doubles="q1 median q3 whisker_low whisker_high")
def error_distribution(t: Tables) -> DataFrame:
    errors = scored(t).withColumn("err", F.col("actual") - F.col("predicted"))
    return box_statistics(errors, by=SCORE_KEYS, value="err")


# --- features -------------------------------------------------------------------------------------------------------

_FEATURES = [f"{s}_{f}" for s in HOURLY_SYMBOLS for f in CELLS if f"{s}_{f}" not in ("click_high", "click_low", "click_close")]
_FILLED = ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in _FEATURES)
_Y = "(coalesce(click_close, 0e0) + greatest(coalesce(click_high - click_close, 0e0), 0) + greatest(coalesce(click_close - click_low, 0e0), 0)) / 3"
_SCORES_SQL = f"""{HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, CELLS)}, filled AS (SELECT {_FILLED}, {_Y} AS y FROM panel),
scores AS ({" UNION ALL ".join(f"SELECT CAST({i} AS INT) AS pos, '{c}' AS feature, pow(corr({c}, y), 2) / (1 - pow(corr({c}, y), 2)) * (count(*) - 2) AS score FROM filled" for i, c in enumerate(_FEATURES))})"""


def _scores(t: Tables) -> DataFrame:
    panel = t.hourly_panel()
    high, low = F.col("click_high") - F.col("click_close"), F.col("click_close") - F.col("click_low")
    spread = {"high_spread": F.greatest(F.coalesce(high, F.lit(0.0)), F.lit(0.0)), "low_spread": F.greatest(F.coalesce(low, F.lit(0.0)), F.lit(0.0))}
    return features.feature_scores(panel.withColumns(spread).fillna(0.0), _FEATURES, ["click_close", "high_spread", "low_spread"])


@query("feature_scores", f"WITH {_SCORES_SQL} SELECT pos, feature, score FROM scores", doubles="score")
def feature_scores(t: Tables) -> DataFrame:
    return _scores(t)


@query("topk_features", f"WITH {_SCORES_SQL} SELECT pos, feature, score FROM scores ORDER BY score DESC, pos DESC LIMIT {SHORT.top_features}", doubles="score")
def topk_features(t: Tables) -> DataFrame:
    return features.top_features(_scores(t), SHORT.top_features)


_MINMAX = ", ".join(f"CASE WHEN x{c} = n{c} THEN {c} - n{c} ELSE ({c} - n{c}) / (x{c} - n{c}) END AS {c}" for c in CELLS)
_SPLIT = f"""{HB}, line AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM hb)),
   marked AS (SELECT hb.*, pos <= floor(n * 0.8e0) AS is_train FROM hb JOIN line ON line.ts = hb.ts)"""


@query("minmax_scale", f"""WITH {_SPLIT}, fit AS (SELECT symbol, {", ".join(f"min({c}) AS n{c}, max({c}) AS x{c}" for c in CELLS)} FROM marked WHERE is_train GROUP BY symbol)
   SELECT symbol, ts, {_MINMAX}, is_train FROM marked JOIN fit USING (symbol)""", doubles=" ".join(CELLS))
def minmax_scale(t: Tables) -> DataFrame:
    """Fitted on the training rows, applied to all."""
    marked = folds.chrono_split(t.hourly(), step_seconds=HOUR)
    fitted = features.fit_minmax(marked.filter("is_train"), CELLS, ["symbol"])
    return features.apply_minmax(marked, fitted, CELLS, ["symbol"]).select("symbol", "ts", *CELLS, "is_train")


@query("minmax_inverse", f"WITH {HB} SELECT symbol, ts, open, high, low, close, volume FROM hb", doubles=" ".join(CELLS))
def minmax_inverse(t: Tables) -> DataFrame:
    """Scaled and scaled back."""
    b = t.hourly()
    fitted = features.fit_minmax(b, CELLS, ["symbol"])
    there = features.apply_minmax(b, fitted, CELLS, ["symbol"])
    return features.apply_minmax(there, fitted, CELLS, ["symbol"], inverse=True)


@query("visible_high_low", f"WITH {DIRTY} SELECT symbol, max(high) FILTER (WHERE NOT isinf(high)) AS high, min(low) FILTER (WHERE NOT isinf(low)) AS low FROM dirty WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY symbol")
def visible_high_low(t: Tables) -> DataFrame:
    since, until = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25)
    start, end = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    return views.visible_high_low(t.dirty(since, until), start, end)


@query("latest_price", """SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS latest_price, max(ts) AS ts FROM events GROUP BY event_type""")
def latest_price(t: Tables) -> DataFrame:
    ticks = t.table("events")
    return ticks.groupBy(F.col("event_type").alias("symbol")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("latest_price"), F.max("ts").alias("ts")
    )


@query("drift_vol", f"""WITH {HB}, r AS (SELECT symbol, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM hb)
  SELECT symbol, avg(ret) AS drift, stddev_samp(ret) AS volatility FROM r GROUP BY symbol""", doubles="drift volatility")
def drift_vol(t: Tables) -> DataFrame:
    from barloom.operators.indicators import returns

    moved = returns(t.hourly(), step_seconds=HOUR, periods=(1,))
    return moved.groupBy("symbol").agg(F.avg("pct_1").alias("drift"), F.stddev_samp("pct_1").alias("volatility"))


@query("chrono_split", f"WITH {_SPLIT} SELECT symbol, ts, close, is_train FROM marked")
def chrono_split(t: Tables) -> DataFrame:
    return folds.chrono_split(t.hourly(), step_seconds=HOUR).select("symbol", "ts", "close", "is_train")


@query("walk_forward_folds", f"WITH {HB}, {LINE} SELECT * FROM bounds")
def walk_forward_folds(t: Tables) -> DataFrame:
    line = folds.timeline(t.hourly(), step_seconds=HOUR)
    return folds.fold_bounds(line, min_train=M, test=SHORT.fold_test, step=S)


@query("walk_forward_daily", f"""WITH {DB}, line AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM db)),
  tests AS (SELECT ts, pos, CAST((pos - 1 - 730) // 90 AS INT) AS fold FROM line WHERE pos > 730)
  SELECT t.fold, (SELECT min(ts) FROM line) AS train_start, e.ts AS train_end, CAST(e.pos AS BIGINT) AS train_rows, min(t.ts) AS test_start, max(t.ts) AS test_end, CAST(count(*) AS BIGINT) AS test_rows
  FROM tests t JOIN line e ON e.pos = 730 + t.fold * 90 GROUP BY t.fold, e.ts, e.pos""")
def walk_forward_daily(t: Tables) -> DataFrame:
    from barloom.config import DAY, LONG

    line = folds.timeline(t.daily(), step_seconds=DAY)
    return folds.fold_bounds(line, min_train=LONG.fold_min_train, test=LONG.fold_test, step=LONG.fold_step)
