"""Sorts, ranks, unions, scalar functions and chart tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DAY, HOUR, LONG, SHORT
from barloom.functions import scalar
from barloom.models.future import family, future_frame, future_regressors
from barloom.models.naive import naive_forecast
from barloom.models.panel import forecast_panel
from barloom.operators import indicators, toplists, views
from barloom.plans.catalog import (
    DAILY_SYMBOLS, DB, EVAL_SQL, HB, HITS, PRICES, SPREADS, TARGETS, THIN, Tables, query, scored, with_spreads,
)
from barloom.operators import metrics
from barloom.plans.windows import INDICATOR_SELECT, indicator_ctes
from barloom.sources.ticks import feed

_W = "PARTITION BY symbol ORDER BY ts"

# --- a forecast panel with a closed form ----------------------------------------------------------------------------

PANEL_MODELS = ["hold", "recent", "slope"]


def simple_panel(t: Tables) -> DataFrame:
    """(symbol, model, target, step, ts, yhat): the last value, the recent mean, and a straight line."""
    b = with_spreads(t.hourly())
    cells = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("v")) for c in TARGETS])
    long = b.select("symbol", "ts", F.inline(cells))
    keys = ["symbol", "target"]
    facts = long.groupBy(*keys).agg(
        F.max_by("v", "ts").alias("last"), F.min_by("v", "ts").alias("first"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("end")
    )
    recent = toplists.tail_rows(long, SHORT.recent_rows, by=keys).groupBy(*keys).agg(F.avg("v").alias("mean"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(SHORT.steps))).alias("step")
    grown = facts.join(recent, keys).select("*", steps)
    slope = F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1)
    values = {"hold": F.col("last"), "recent": F.col("mean"), "slope": F.col("last") + slope * F.col("step")}
    rows = F.array(*[F.struct(F.lit(m).alias("model"), v.alias("yhat")) for m, v in values.items()])
    return grown.select(
        "symbol", "target", "step", F.timestamp_add("SECOND", F.col("step") * HOUR, F.col("end")).alias("ts"), F.inline(rows)
    )


PANEL = f"""{HB}, {SPREADS}, long AS ({" UNION ALL ".join(f"SELECT symbol, ts, '{c}' AS target, {c} AS v FROM spreads" for c in TARGETS)}),
facts AS (SELECT symbol, target, last(v ORDER BY ts) AS last, first(v ORDER BY ts) AS first, count(*) AS n, max(ts) AS stop FROM long GROUP BY symbol, target),
recent AS (SELECT symbol, target, avg(v) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY symbol, target ORDER BY ts DESC) AS rn FROM long) WHERE rn <= 24 GROUP BY symbol, target),
panel AS (SELECT symbol, target, CAST(k AS INT) AS step, stop + k * INTERVAL 1 HOUR AS ts, m.model,
  CASE m.model WHEN 'hold' THEN last WHEN 'recent' THEN mean ELSE last + (last - first) / nullif(n - 1, 0) * k END AS yhat
  FROM facts JOIN recent USING (symbol, target), generate_series(1, 168) AS g(k), (VALUES ('hold'), ('recent'), ('slope')) AS m(model))"""


# --- sorts and limits -----------------------------------------------------------------------------------------------


@query("sort_time", f"WITH {HB} SELECT symbol, ts, close FROM hb")
def sort_time(t: Tables) -> DataFrame:
    return toplists.sort_time(t.hourly().select("symbol", "ts", "close"))


@query("tail_n", f"WITH {HB}, r AS (SELECT *, row_number() OVER ({_W} DESC) AS rn FROM hb) SELECT symbol, ts, close FROM r WHERE rn <= 24")
def tail_n(t: Tables) -> DataFrame:
    return toplists.tail_rows(t.hourly().select("symbol", "ts", "close"), SHORT.recent_rows)


@query("head_n", f"WITH {PANEL} SELECT symbol, model, target, step, yhat FROM panel WHERE step <= 12", doubles="yhat")
def head_n(t: Tables) -> DataFrame:
    rows = simple_panel(t).select("symbol", "model", "target", "step", "yhat")
    return toplists.head_rows(rows, 12, by=["symbol", "model", "target"], order="step")


@query("rank_forecasts", f"WITH {PANEL} SELECT symbol, model, target, yhat, CAST(rank() OVER (PARTITION BY symbol, target ORDER BY yhat) AS INT) AS place FROM panel WHERE step = 168", doubles="yhat")
def rank_forecasts(t: Tables) -> DataFrame:
    final = simple_panel(t).filter(F.col("step") == SHORT.steps).select("symbol", "model", "target", "yhat")
    return toplists.rank_forecasts(final, by=["symbol", "target"])


@query("model_selection", f"""WITH {HITS}, e AS (SELECT symbol, model, target, {EVAL_SQL} FROM hits GROUP BY symbol, model, target)
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, target ORDER BY mae, dir_acc DESC, model) AS rn FROM e) WHERE rn = 1""", doubles="mae rmse mape smape dir_acc")
def model_selection(t: Tables) -> DataFrame:
    return toplists.select_model(metrics.evaluate(scored(t, positions=True), by=["symbol", "model", "target"], step_seconds=HOUR), by=["symbol", "target"])


# --- unions ---------------------------------------------------------------------------------------------------------


@query("union_history_forecast", f"""WITH {PANEL} SELECT symbol, ts, close AS price, 'Historical' AS model, 'Historical' AS kind FROM hb
  UNION ALL SELECT symbol, ts, yhat, model, 'Predict' FROM panel WHERE target = 'close'""", doubles="price")
def union_history_forecast(t: Tables) -> DataFrame:
    forecast = simple_panel(t).filter(F.col("target") == "close")
    return toplists.sort_time(views.union_history_forecast(t.hourly(), forecast, ["symbol"]))


@query("merge_cutoff", f"""WITH {HB}, c AS (SELECT symbol, ts, open, high, low, close FROM hb), f AS (SELECT * FROM c WHERE ts >= TIMESTAMP '2024-01-25')
  SELECT c.*, 'history' AS source FROM c JOIN (SELECT symbol, min(ts) AS first FROM f GROUP BY symbol) g USING (symbol) WHERE ts <= first UNION ALL SELECT *, 'forecast' FROM f""")
def merge_cutoff(t: Tables) -> DataFrame:
    """The last days stand in for the forecast; the time they share with the history shows up twice."""
    forecast = t.hourly(since=dt.datetime(2024, 1, 25))
    last_cut = forecast.groupBy("symbol").agg(F.min("ts").alias("first")).agg(F.max("first")).first()[0]
    history = t.hourly(until=last_cut) if last_cut else t.hourly()
    return views.merge_cutoff(history, forecast, ["symbol"])


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("calendar_features", """SELECT event_id, ts, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter,
  CAST(year(ts) AS INT) AS year, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM events""")
def calendar_features(t: Tables) -> DataFrame:
    return scalar.with_calendar(t.table("events").select("event_id", "ts"), hours=True)


@query("parse_time_smart", "SELECT o_orderkey, o_orderdate AS ts FROM orders")
def parse_time_smart(t: Tables) -> DataFrame:
    """Epoch seconds as text: no value parses as a time, the median is below 1e11."""
    text = t.table("orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string").alias("t"))
    return scalar.parse_time_smart(text, "t", "ts").select("o_orderkey", "ts")


@query("to_utc", "SELECT event_id, ts - INTERVAL 7 HOUR AS utc, ts AS same FROM events")
def to_utc(t: Tables) -> DataFrame:
    """Wall clock of a zone seven hours ahead, and a time that is UTC already."""
    return t.table("events").select("event_id", scalar.to_utc_naive(F.col("ts"), "Asia/Bangkok").alias("utc"), scalar.to_utc_naive(F.col("ts")).alias("same"))


@query("format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS short, strftime(ts, '%Y-%m-%d') AS long, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def format_time(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.table("events").select(
        "event_id", scalar.time_label(ts, long=False).alias("short"), scalar.time_label(ts, long=True).alias("long"), scalar.iso_z(ts).alias("iso")
    )


@query("candle_change", f"WITH {HB} SELECT symbol, ts, open, close, close - open AS change, (close - open) / nullif(open, 0) * 100 AS change_percent, CASE WHEN close - open >= 0 THEN 'Up' ELSE 'Down' END AS color FROM hb", doubles="change change_percent")
def candle_change(t: Tables) -> DataFrame:
    return scalar.change_columns(t.hourly().select("symbol", "ts", "open", "close"))


@query("ohlc_envelope", f"WITH {HB}, p AS (SELECT symbol, ts, lag(close) OVER ({_W}) AS open, high, low, close FROM hb) SELECT symbol, ts, open, greatest(open, close, high) AS high, least(open, close, low) AS low, close FROM p")
def ohlc_envelope(t: Tables) -> DataFrame:
    shifted = indicators.previous_close_open(t.hourly(), step_seconds=HOUR).drop("volume")
    return scalar.with_envelope(shifted)


_TOP, _BOTTOM = "greatest(open, high, low, close)", "least(open, high, low, close)"


@query("ohlc_constrain", f"""WITH {THIN}, p AS (SELECT symbol, ts, lag(close) OVER ({_W}) AS open, high, low, close FROM thin) SELECT symbol, ts,
  CASE WHEN open IS NOT NULL THEN least(greatest(open, {_BOTTOM}), {_TOP}) END AS open, {_TOP} AS high, {_BOTTOM} AS low,
  CASE WHEN close IS NOT NULL THEN least(greatest(close, {_BOTTOM}), {_TOP}) END AS close FROM p""")
def ohlc_constrain(t: Tables) -> DataFrame:
    return scalar.with_ohlc_limits(indicators.previous_close_open(t.thin(), step_seconds=HOUR).drop("volume"))


@query("period_span", """WITH n AS (SELECT event_type AS symbol, max(ts) AS stop FROM events GROUP BY event_type)
  SELECT symbol, period, CAST(s AS INT) AS seconds, stop - s * INTERVAL 1 SECOND AS start FROM n,
  (VALUES ('1H', 3600), ('24H', 86400), ('1W', 604800), ('1M', 2592000), ('3M', 7776000), ('6M', 15552000), ('odd', 15552000)) AS p(period, s)""")
def period_span(t: Tables) -> DataFrame:
    newest = t.table("events").groupBy(F.col("event_type").alias("symbol")).agg(F.max("ts").alias("stop"))
    names = F.explode(F.array(*[F.lit(p) for p in ["1H", "24H", "1W", "1M", "3M", "6M", "odd"]])).alias("period")
    spans = newest.select("symbol", "stop", names).withColumn("seconds", scalar.period_seconds(F.col("period")))
    return spans.select("symbol", "period", "seconds", scalar.shift_seconds(F.col("stop"), -F.col("seconds")).alias("start"))


@query("map_ohlc_row", f"""WITH {DB} SELECT CASE WHEN symbol < '3' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%d') || 'T00:00:00' END AS "Date",
  open AS "Open", high AS "High", low AS "Low", close AS "Close" FROM db""")
def map_ohlc_row(t: Tables) -> DataFrame:
    """Rows that name their time `Date` (with a time part) or `time` (without one), prices either way."""
    upper = F.col("symbol") < "3"
    rows = t.daily().select(
        F.when(upper, scalar.iso_z(F.col("ts"))).alias("Date"),
        F.when(~upper, scalar.time_label(F.col("ts"), long=True)).alias("time"),
        *[F.col(c).alias(c.capitalize()) for c in PRICES],
    )
    return scalar.map_ohlc_row(rows)


@query("parse_iso", """SELECT event_id, date_trunc('second', ts) AS parsed, CAST(NULL AS TIMESTAMP) AS broken FROM events""")
def parse_iso(t: Tables) -> DataFrame:
    return t.table("events").select(
        "event_id", scalar.parse_iso(scalar.iso_z(F.col("ts"))).alias("parsed"), scalar.parse_iso(F.col("event_type")).alias("broken")
    )


@query("safe_float", r"""SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '"k": ([^}]*)', 1) AS DOUBLE), 51.0) AS k, CAST(51 AS DOUBLE) AS fallback FROM events""")
def safe_float(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", '"k": ([^}]*)', 1)
    return t.table("events").select("event_id", scalar.number_or(k, 51.0).alias("k"), scalar.number_or(F.col("event_type"), 51.0).alias("fallback"))


@query("round4", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / 7, 4) AS net FROM lineitem")
def round4(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.round(net, 4).alias("net"))


@query("clean_header", f"WITH {HB} SELECT symbol, ts, close FROM hb")
def clean_header(t: Tables) -> DataFrame:
    from barloom.functions.columns import clean_header as cleaned

    odd = t.hourly().select(F.col("symbol").alias(" symbol"), F.col("ts").alias("﻿ts"), F.col("close").alias("close "))
    return odd.toDF(*[cleaned(c) for c in odd.columns])


@query("pick_column", f"WITH {HB} SELECT symbol, ts, close AS picked FROM hb")
def pick_column(t: Tables) -> DataFrame:
    from barloom.functions.columns import pick_column as pick

    odd = t.hourly().select("symbol", "ts", "volume", F.col("close").alias("Last_Close"))
    return odd.select("symbol", "ts", F.col(pick(odd.columns, ["Close", "Price"], containing="close")).alias("picked"))


# --- chart tables ---------------------------------------------------------------------------------------------------

_CANDLE = """change, change / nullif(open, 0) * 100 AS change_percent, CASE WHEN change >= 0 THEN 'Up' ELSE 'Down' END AS color"""


@query("candle_table", f"""WITH {HB}, a AS (SELECT *, row_number() OVER ({_W}) AS rn FROM hb), b AS (SELECT *, lag(close) OVER ({_W}) AS o FROM a WHERE rn > 1),
  c AS (SELECT symbol AS model, ts, close, greatest(o, close, high) AS high, least(o, close, low) AS low, o AS open, close - o AS change FROM b WHERE o IS NOT NULL)
  SELECT model, ts, close, high, low, open, {_CANDLE}, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM c""", doubles="change change_percent")
def candle_table(t: Tables) -> DataFrame:
    forecast = t.hourly().withColumnRenamed("symbol", "model")
    return views.candle_table(forecast, long=False, step_seconds=HOUR)


@query("candle_table_daily", f"""WITH {DB}, a AS (SELECT *, row_number() OVER ({_W}) AS rn FROM db), r AS (SELECT * FROM a WHERE rn > 1),
  days AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM r GROUP BY symbol),
  f AS (SELECT d.symbol, d.ts, last_value(r.close IGNORE NULLS) OVER w AS close, last_value(r.high IGNORE NULLS) OVER w AS high, last_value(r.low IGNORE NULLS) OVER w AS low
    FROM days d LEFT JOIN r ON r.symbol = d.symbol AND r.ts = d.ts WINDOW w AS (PARTITION BY d.symbol ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, lag(close) OVER ({_W}) AS o FROM f),
  c AS (SELECT symbol AS model, ts, close, greatest(o, close, high) AS high, least(o, close, low) AS low, o AS open, close - o AS change FROM b WHERE o IS NOT NULL)
  SELECT model, ts, close, high, low, open, {_CANDLE}, strftime(ts, '%Y-%m-%d') AS label FROM c""", doubles="change change_percent", digits=4)
def candle_table_daily(t: Tables) -> DataFrame:
    forecast = t.daily().withColumnRenamed("symbol", "model")
    return views.candle_table(forecast, long=True, step_seconds=DAY)


_STARTS = "(VALUES ('1H', 3600), ('24H', 86400), ('1W', 604800)) AS p(period, s)"


@query("cut_from_start", f"""WITH {PANEL}, m AS (SELECT symbol, model, min(ts) AS start FROM panel WHERE target = 'close' GROUP BY symbol, model)
  SELECT p.period, x.symbol, x.model, x.ts, x.yhat FROM panel x JOIN m USING (symbol, model), {_STARTS} WHERE x.target = 'close' AND x.ts BETWEEN m.start AND m.start + p.s * INTERVAL 1 SECOND""", doubles="yhat")
def cut_from_start(t: Tables) -> DataFrame:
    rows = simple_panel(t).filter(F.col("target") == "close").select("symbol", "model", "ts", "yhat")
    return views.cut_from_start(rows, ["1H", "24H", "1W"], by=["symbol", "model"])


@query("cut_from_end", f"""WITH {DB}, d AS (SELECT symbol, CASE WHEN volume = 1 AND close < 60000 THEN NULL ELSE ts END AS ts, close FROM db), m AS (SELECT symbol, max(ts) AS top FROM d GROUP BY symbol),
  p AS (SELECT * FROM (VALUES ('24H', 1, false), ('1W', 7, false), ('1M', 30, true), ('6M', 180, true)) AS p(period, days, long)),
  l AS (SELECT symbol, period, long, CASE WHEN long THEN date_trunc('day', top) + INTERVAL 1 DAY ELSE top END AS stop, days FROM m, p)
  SELECT d.symbol, d.ts, d.close, l.period FROM d JOIN l ON l.symbol = d.symbol WHERE d.ts IS NULL
    OR (l.long AND date_trunc('day', d.ts) >= l.stop - l.days * INTERVAL 1 DAY AND date_trunc('day', d.ts) < l.stop) OR (NOT l.long AND d.ts BETWEEN l.stop - l.days * INTERVAL 1 DAY AND l.stop)""")
def cut_from_end(t: Tables) -> DataFrame:
    """Some small bars count as undated; they stay in every cut."""
    undated = (F.col("volume") == 1) & (F.col("close") < 60000)
    rows = t.daily().select("symbol", F.when(~undated, F.col("ts")).alias("ts"), "close")
    return views.cut_from_end(rows, ["24H", "1W", "1M", "6M"])


@query("range_from_now", f"""WITH {HB} SELECT '1W' AS period, symbol, ts, close FROM hb WHERE ts BETWEEN TIMESTAMP '2024-01-28 06:30:00' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-28 06:30:00'
  UNION ALL SELECT '1M', symbol, ts, close FROM hb WHERE CAST(ts AS DATE) BETWEEN DATE '2023-12-29' AND DATE '2024-01-28'""")
def range_from_now(t: Tables) -> DataFrame:
    as_of = dt.datetime(2024, 1, 28, 6, 30)
    now = F.lit(as_of).cast("timestamp_ntz")

    def cut(period: str) -> DataFrame:
        rows = t.hourly(*views.range_bounds(period, as_of)).select("symbol", "ts", "close")
        return views.range_until(rows, period, now).withColumn("period", F.lit(period))

    cuts = [cut(p) for p in ("1W", "1M")]
    return cuts[0].unionByName(cuts[1])


_TREND = "CASE WHEN {c} IS NULL THEN 'N/A' WHEN {c} > {n} THEN 'BULLISH' WHEN {c} < -{n} THEN 'BEARISH' ELSE 'NEUTRAL' END"
_AGAINST = f"""{PANEL}, a AS (SELECT symbol, target, model, yhat, last AS current, (yhat - last) / nullif(last, 0) * 100 AS change_percent FROM panel JOIN facts USING (symbol, target) WHERE step = 168)"""


def _current(t: Tables) -> DataFrame:
    last = toplists.last_values(with_spreads(t.hourly()), TARGETS)
    cells = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("current")) for c in TARGETS])
    return last.select("symbol", F.inline(cells))


@query("current_vs_forecast", f"WITH {_AGAINST} SELECT * FROM a", doubles="yhat current change_percent")
def current_vs_forecast(t: Tables) -> DataFrame:
    return views.current_vs_forecast(_current(t), simple_panel(t), ["symbol", "target"])


@query("trend_label", f"WITH {_AGAINST} SELECT symbol, target, model, {_TREND.format(c='change_percent', n='5')} AS trend FROM a")
def trend_label(t: Tables) -> DataFrame:
    against = views.current_vs_forecast(_current(t), simple_panel(t), ["symbol", "target"])
    return against.select("symbol", "target", "model", scalar.trend_label(F.col("change_percent"), LONG.trend_percent).alias("trend"))


@query("horizon_table", f"""WITH {PANEL}, h AS (SELECT symbol, model, target, max(yhat) FILTER (WHERE step = 24) AS h24, max(yhat) FILTER (WHERE step = 48) AS h48, max(yhat) FILTER (WHERE step = 72) AS h72, max(yhat) FILTER (WHERE step = 168) AS h168 FROM panel GROUP BY ALL),
  c AS (SELECT *, (h168 - h24) / nullif(h24, 0) * 100 AS change_percent FROM h) SELECT *, {_TREND.format(c='change_percent', n='2')} AS trend FROM c""", doubles="h24 h48 h72 h168 change_percent")
def horizon_table(t: Tables) -> DataFrame:
    return views.horizon_table(simple_panel(t), [24, 48, 72, 168], SHORT.trend_percent, ["symbol", "model", "target"])


@query("consensus", f"""WITH {PANEL}, c AS (SELECT symbol, target, avg(yhat) FILTER (WHERE step = 24) AS early, avg(yhat) FILTER (WHERE step = 168) AS late FROM panel GROUP BY symbol, target)
  SELECT *, (late - early) / nullif(early, 0) * 100 AS change_percent FROM c""", doubles="early late change_percent")
def consensus(t: Tables) -> DataFrame:
    return views.consensus(simple_panel(t), 24, 168, ["symbol", "target"])


@query("forecast_panel", f"""WITH {PANEL}, m AS (SELECT * FROM (VALUES ('hold'), ('recent'), ('slope'), ('absent')) AS m(model))
  SELECT f.symbol, m.model, f.target, CAST(k AS INT) AS step, p.yhat FROM facts f, m, generate_series(1, 168) AS g(k)
  LEFT JOIN panel p ON p.symbol = f.symbol AND p.target = f.target AND p.model = m.model AND p.step = k""", doubles="yhat")
def panel_grid(t: Tables) -> DataFrame:
    """A model that could not be fitted has NULL rows."""
    panel = simple_panel(t)
    series = t.table("events").select(F.col("event_type").alias("symbol")).distinct()
    return forecast_panel([panel], models=[*PANEL_MODELS, "absent"], targets=TARGETS, steps=SHORT.steps, series=series, by=["symbol"])


# --- closed-form forecasts ------------------------------------------------------------------------------------------


@query("naive_sma_atr", f"""WITH {DB}, feed AS (SELECT * FROM db WHERE ts >= (SELECT max(ts) FROM db) - INTERVAL 90 DAY),
  tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM (SELECT *, lag(close) OVER ({_W}) AS pc FROM feed)),
  l AS (SELECT symbol, last(open ORDER BY ts) AS lo, last(high ORDER BY ts) AS lh, last(low ORDER BY ts) AS ll, last(close ORDER BY ts) AS lc, max(ts) AS ts,
        avg(close) FILTER (WHERE rn <= 10) AS sma, CASE WHEN count(*) FILTER (WHERE rn <= 14) >= 2 THEN avg(tr) FILTER (WHERE rn <= 14) END AS atr FROM tr GROUP BY symbol),
  p AS (SELECT *, lc * (0.5e0 + 0.5e0 * coalesce(lc / nullif(sma, 0), 1)) AS c, 0.5e0 * coalesce(nullif(atr, 0), nullif(lh - ll, 0), abs(lc * 0.01e0)) AS reach FROM l),
  q AS (SELECT *, (c + lo) / 2 AS o FROM p)
  SELECT symbol, ts + INTERVAL 1 DAY AS ts, round(o, 4) AS open, round(greatest(o, c) + reach, 4) AS high, round(least(o, c) - reach, 4) AS low, round(c, 4) AS close, 'naive_sma_atr' AS model FROM q""")
def naive_sma_atr(t: Tables) -> DataFrame:
    recent = feed(t.daily(), symbols=DAILY_SYMBOLS, span_days=90)
    return naive_forecast(recent, horizon=1, step_seconds=DAY)


_PRICES = {"x_open": "open", "x_high": "high", "x_low": "low", "x_close": "close"}
_FUTURE = [*_PRICES, "volume", *indicators.INDICATORS]


def _family_sql(f: str) -> str:
    return f"'{family(f)}'"


_FUTURE_SQL = f"""{HB}, {indicator_ctes('hb')}, base AS (SELECT symbol, ts, {", ".join(f"{c} AS {x}" for x, c in _PRICES.items())}, volume, {", ".join(indicators.INDICATORS)} FROM ({INDICATOR_SELECT})),
 long AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT symbol, ts, '{f}' AS feature, {_family_sql(f)} AS family, {f} AS value FROM base" for f in _FUTURE)}) WHERE value IS NOT NULL),
 r AS (SELECT *, value / nullif(lag(value) OVER w, 0) - 1 AS ret, row_number() OVER (PARTITION BY symbol, feature ORDER BY ts DESC) AS rn FROM long WINDOW w AS (PARTITION BY symbol, feature ORDER BY ts)),
 facts AS (SELECT symbol, feature, family, last(value ORDER BY ts) AS last, count(*) AS n, coalesce(avg(ret), 0) AS drift, avg(value) FILTER (WHERE rn <= 24) AS recent FROM r GROUP BY ALL),
 ends AS (SELECT symbol, max(ts) AS stop FROM base GROUP BY symbol),
 future AS (SELECT symbol, feature, family, CAST(k AS INT) AS step, stop + k * INTERVAL 1 HOUR AS ts,
   CASE WHEN n <= 24 THEN last WHEN family IN ('price', 'average') THEN last * pow(1 + drift, k - 1)
        WHEN family = 'rsi' THEN 50 + (greatest(30, least(70, last + 0.05e0 * (50 - last))) - 50) * pow(0.95e0, k - 1)
        WHEN feature = 'volume_ratio' THEN 1 + (last - 1) * pow(0.95e0, k) WHEN family = 'oscillator' THEN last * pow(0.95e0, k) WHEN family = 'recent' THEN recent ELSE last END AS value
   FROM facts JOIN ends USING (symbol), generate_series(1, 168) AS g(k))"""


def _future(t: Tables) -> DataFrame:
    b = indicators.indicator_set(t.hourly(), step_seconds=HOUR)
    return future_regressors(b.withColumnsRenamed({c: x for x, c in _PRICES.items()}), _FUTURE, SHORT)


def _digits_sql(value: str) -> str:
    """Seven significant digits; prices of random data drift over many powers of ten."""
    return f"CAST(printf('%.6e', {value}) AS DOUBLE)"


def _digits(value: Column) -> Column:
    return F.format_string("%.6e", value).cast("double")


@query("future_regressors", f"WITH {_FUTURE_SQL} SELECT symbol, feature, family, step, ts, {_digits_sql('value')} AS value FROM future")
def future_query(t: Tables) -> DataFrame:
    """The paths of all columns of the panel."""
    return _future(t).select("symbol", "feature", "family", "step", "ts", _digits(F.col("value")).alias("value"))


@query("future_frame", f"""WITH {_FUTURE_SQL} SELECT symbol, step, ts, {", ".join(f"{_digits_sql(f'max(value) FILTER (WHERE feature = {chr(39)}{f}{chr(39)})')} AS {f}" for f in _FUTURE)},
  CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, CAST(year(ts) AS INT) AS year, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) >= 6 AS INT) AS is_weekend
  FROM future GROUP BY symbol, step, ts""")
def future_frame_query(t: Tables) -> DataFrame:
    """The regressors of every step side by side, with the calendar."""
    return future_frame(_future(t), _FUTURE).withColumns({f: _digits(F.col(f)) for f in _FUTURE})
