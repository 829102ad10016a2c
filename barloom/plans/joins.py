"""Joins on time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DAY, HOUR
from barloom.operators import align
from barloom.plans.catalog import (
    CELLS, DAILY_SYMBOLS, DB, HB, HOURLY_SYMBOLS, SCORED, TARGETS, Tables, panel_sql, query, scored, with_spreads,
)


@query("merge_outer", f"WITH {HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, CELLS)} SELECT * FROM panel")
def merge_outer(t: Tables) -> DataFrame:
    return t.hourly_panel()


@query("merge_outer_daily", f"WITH {DB}, {panel_sql('db', 'panel', DAILY_SYMBOLS, ['open', 'close'])} SELECT * FROM panel")
def merge_outer_daily(t: Tables) -> DataFrame:
    return align.wide_panel(t.daily(), DAILY_SYMBOLS, ["open", "close"])


@query("merge_frames", f"""WITH {HB}, c AS (SELECT ts, close AS click_close FROM hb WHERE symbol = 'click'),
   v AS (SELECT ts, close AS view_close, volume AS view_volume FROM hb WHERE symbol = 'view'),
   e AS (SELECT ts, close AS error_close FROM hb WHERE symbol = 'error'),
   p AS (SELECT ts, close AS purchase_close FROM hb WHERE symbol = 'purchase'), s AS (SELECT ts, close AS signup_close FROM hb WHERE symbol = 'signup')
   SELECT ts, click_close, view_close, view_volume, error_close, purchase_close, signup_close
   FROM c FULL JOIN v USING (ts) FULL JOIN e USING (ts) FULL JOIN p USING (ts) FULL JOIN s USING (ts)""")
def merge_frames(t: Tables) -> DataFrame:
    """Frames of single symbols merged on time."""
    b = t.hourly()

    def one(symbol: str, *cols: str) -> DataFrame:
        return b.filter(F.col("symbol") == symbol).select("ts", *[F.col(c).alias(f"{symbol}_{c}") for c in cols])

    return align.merge_frames([one("click", "close"), one("view", "close", "volume"), one("error", "close"), one("purchase", "close"), one("signup", "close")])


@query("align_actual_pred", f"""WITH {SCORED} SELECT symbol, model, target, ts, actual, predicted FROM scored""", doubles="actual predicted")
def align_actual_pred(t: Tables) -> DataFrame:
    b = with_spreads(t.hourly())
    cells = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("actual")) for c in TARGETS])
    actual = b.select("symbol", "ts", F.inline(cells))
    return align.align_actual(actual, scored(t).drop("actual"), ["symbol", "ts", "target"])


@query("calendar_reindex", f"""WITH {DB}, days AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM db GROUP BY symbol)
  SELECT d.symbol, d.ts, last_value(b.close IGNORE NULLS) OVER w AS close, last_value(b.high IGNORE NULLS) OVER w AS high
  FROM days d LEFT JOIN db b ON b.symbol = d.symbol AND b.ts = d.ts WINDOW w AS (PARTITION BY d.symbol ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def calendar_reindex(t: Tables) -> DataFrame:
    rows = t.daily().select("symbol", "ts", "close", "high")
    return align.calendar_reindex(rows, ["close", "high"], step_seconds=DAY)


@query("align_xy", f"""WITH {HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, ['close', 'volume'])}
  SELECT s.symbol, s.high_spread, p.* FROM panel p JOIN (SELECT symbol, ts, greatest(high - close, 0) AS high_spread FROM hb) s ON s.ts = p.ts""", doubles="high_spread")
def align_xy(t: Tables) -> DataFrame:
    y = with_spreads(t.hourly()).select("symbol", "ts", "high_spread")
    return y.join(t.hourly_panel(["close", "volume"]), "ts")


@query("nearest_row", f"""WITH {HB}, visible AS (SELECT * FROM hb WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'),
  p AS (SELECT event_id, event_type AS symbol, ts FROM events),
  l AS (SELECT p.*, b.ts AS bts, b.close AS bclose FROM p ASOF LEFT JOIN visible b ON p.symbol = b.symbol AND p.ts >= b.ts),
  r AS (SELECT p.event_id, b.ts AS ats, b.close AS aclose FROM p ASOF LEFT JOIN visible b ON p.symbol = b.symbol AND p.ts <= b.ts)
  SELECT l.event_id, l.symbol, l.ts, CASE WHEN ats IS NULL OR l.ts - bts <= ats - l.ts THEN bts ELSE ats END AS bar_ts,
         CASE WHEN ats IS NULL OR l.ts - bts <= ats - l.ts THEN bclose ELSE aclose END AS close
  FROM l JOIN r ON l.event_id = r.event_id""")
def nearest_row(t: Tables) -> DataFrame:
    """For every tick the nearest hourly bar in the visible range."""
    visible = t.hourly(since=dt.datetime(2024, 1, 5), until=dt.datetime(2024, 1, 25))
    probes = t.table("events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    out = align.nearest_rows(probes, visible, ["close"], step_seconds=HOUR)
    return out.select("event_id", "symbol", "ts", "bar_ts", "close")


@query("join_times", f"""WITH {HB} SELECT symbol, CAST(k AS INT) AS step, max(ts) + k * INTERVAL 1 HOUR AS ts FROM hb, generate_series(1, 168) AS g(k) GROUP BY symbol, k""")
def join_times(t: Tables) -> DataFrame:
    last = t.hourly().groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    return align.forecast_times(last, steps=168, step_seconds=HOUR, keys=["symbol"])
