"""Projections and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import HOUR, SHORT, Cells, Share
from barloom.functions.columns import columns_with, split_xy
from barloom.functions.scalar import missing_cells, numeric
from barloom.operators import align, clean
from barloom.operators.fill import fill_rows
from barloom.operators.views import rebuild_high_low
from barloom.plans.catalog import (
    CELLS, DIRTY, HB, HOURLY_SYMBOLS, PRICES, SCORED, SPREADS, TARGETS, THIN, Tables, panel_sql, query, scored, with_spreads,
)

_THIN_COLS = [f"{s}_{f}" for s in HOURLY_SYMBOLS for f in PRICES]
_THIN_PANEL = THIN + ", " + panel_sql("thin", "panel", HOURLY_SYMBOLS, PRICES)
_MISSING = " + ".join(f"CAST({c} IS NULL AS INT)" for c in _THIN_COLS)
_LISTED = ", ".join(_THIN_COLS)


@query("proj_ohlcv", f"""WITH {HB} SELECT ts, open AS click_open, high AS click_high, low AS click_low, close AS click_close, volume AS click_volume FROM hb WHERE symbol = 'click'""")
def proj_ohlcv(t: Tables) -> DataFrame:
    one = t.hourly().filter(F.col("symbol") == "click")
    return one.select("ts", *[F.col(c).alias(f"click_{c}") for c in CELLS])


@query("coerce_numeric", r"""SELECT event_id, TRY_CAST(regexp_extract(props, '"k": ([^}]*)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS word FROM events""")
def coerce_numeric(t: Tables) -> DataFrame:
    text = t.table("events").withColumn("_k", F.regexp_extract("props", '"k": ([^}]*)', 1))
    return text.select("event_id", numeric("_k").alias("k"), numeric("event_type").alias("word"))


@query("filter_end_date", f"WITH {HB} SELECT symbol, ts, close FROM hb WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'")
def filter_end_date(t: Tables) -> DataFrame:
    end = dt.datetime(2024, 1, 20)
    return clean.until(t.hourly(until=end), F.lit(end).cast("timestamp_ntz")).select("symbol", "ts", "close")


_GAPS = f"""{THIN}, gaps AS (SELECT ts, sum(CAST(open IS NOT NULL AS INT) + CAST(high IS NOT NULL AS INT) + CAST(low IS NOT NULL AS INT) + CAST(close IS NOT NULL AS INT) + 1) AS present,
   (SELECT count(DISTINCT symbol) FROM thin) * 5 AS cells FROM thin GROUP BY ts)"""


@query("filter_missing_ratio", f"WITH {_GAPS} SELECT symbol, ts, close, volume FROM thin WHERE ts IN (SELECT ts FROM gaps WHERE (cells - present) / cells <= 0.6)")
def filter_missing_ratio(t: Tables) -> DataFrame:
    return clean.filter_missing_long(t.thin(), CELLS, Share(0.6)).select("symbol", "ts", "close", "volume")


@query("filter_missing_count", f"WITH {_THIN_PANEL} SELECT ts, {_LISTED} FROM panel WHERE {_MISSING} <= 10")
def filter_missing_count(t: Tables) -> DataFrame:
    return clean.filter_missing(t.thin_panel(PRICES), _THIN_COLS, Cells(10))


@query("fallback_if_empty", f"WITH {HB} SELECT symbol, ts, close FROM hb WHERE volume < 0 OR NOT EXISTS (SELECT 1 FROM hb WHERE volume < 0)")
def fallback_if_empty(t: Tables) -> DataFrame:
    """No bar has a negative volume, so all of them stay."""
    return clean.filter_or_all(t.hourly(), F.col("volume") < 0).select("symbol", "ts", "close")


@query("filter_or_all", f"WITH {HB} SELECT symbol, ts, close FROM hb WHERE volume >= 4 OR NOT EXISTS (SELECT 1 FROM hb WHERE volume >= 4)")
def filter_or_all(t: Tables) -> DataFrame:
    return clean.filter_or_all(t.hourly(), F.col("volume") >= 4).select("symbol", "ts", "close")


@query("missing_count", f"WITH {_THIN_PANEL} SELECT ts, CAST({_MISSING} AS INT) AS _missing_cnt FROM panel")
def missing_count(t: Tables) -> DataFrame:
    return t.thin_panel(PRICES).select("ts", missing_cells(_THIN_COLS).alias("_missing_cnt"))


REASON = """CASE WHEN open IS NULL AND high IS NULL AND low IS NULL AND close IS NULL THEN 'all_missing'
  WHEN isinf(open) OR isinf(high) OR isinf(low) OR isinf(close) THEN 'infinite'
  WHEN open = 0 AND high = 0 AND low = 0 AND close = 0 THEN 'all_zero'
  WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR open > 100000 OR high > 100000 OR low > 100000 OR close > 100000 THEN 'abnormal' END"""


@query("clean_prices", f"WITH {DIRTY} SELECT symbol, ts, open, high, low, close, volume FROM dirty WHERE ({REASON}) IS NULL")
def clean_prices(t: Tables) -> DataFrame:
    return clean.clean_prices(t.dirty())


@query("inf_to_null", f"WITH {DIRTY} SELECT symbol, ts, open, high, low, CASE WHEN NOT isinf(close) THEN close END AS close, volume FROM dirty")
def inf_to_null(t: Tables) -> DataFrame:
    return clean.inf_to_null(t.dirty(), PRICES)


@query("dropna_subset", f"WITH {THIN} SELECT symbol, ts, high, close FROM thin WHERE high IS NOT NULL AND close IS NOT NULL")
def dropna_subset(t: Tables) -> DataFrame:
    return t.thin().select("symbol", "ts", "high", "close").dropna(subset=["high", "close"])


@query("fill_zero", f"WITH {_THIN_PANEL} SELECT ts, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _THIN_COLS) + " FROM panel")
def fill_zero(t: Tables) -> DataFrame:
    return t.thin_panel(PRICES).fillna(0.0)


@query("spread_targets", f"WITH {HB}, {SPREADS} SELECT symbol, ts, close, high_spread, low_spread FROM spreads", doubles="high_spread low_spread")
def spread_targets(t: Tables) -> DataFrame:
    return with_spreads(t.hourly()).select("symbol", "ts", *TARGETS)


@query("rebuild_high_low", f"""WITH {SCORED}, w AS (SELECT symbol, model, ts, max(CASE WHEN target = 'close' THEN predicted END) AS close,
   max(CASE WHEN target = 'high_spread' THEN predicted END) AS hs, max(CASE WHEN target = 'low_spread' THEN predicted END) AS ls FROM scored GROUP BY ALL)
   SELECT symbol, model, ts, close, close + greatest(hs, 0) AS high, close - greatest(ls, 0) AS low FROM w""", doubles="close high low")
def rebuild(t: Tables) -> DataFrame:
    return rebuild_high_low(scored(t).withColumnRenamed("predicted", "yhat"), ["symbol", "model", "ts"])


@query("split_xy", f"""WITH {HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, CELLS)} SELECT ts, click_close, """ + ", ".join(f"{s}_{f}" for s in HOURLY_SYMBOLS for f in CELLS if f"{s}_{f}" not in ("click_close", "click_high", "click_low")) + " FROM panel")
def split_columns(t: Tables) -> DataFrame:
    """Target and features of the target asset: its own close, high and low are no features."""
    panel = t.hourly_panel()
    features, targets = split_xy(panel.columns, ["click_close"], exclude=["ts", "click_high", "click_low"])
    return panel.select("ts", *targets, *features)


@query("cols_by_pattern", f"""WITH {HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, CELLS)} SELECT ts, {", ".join(f"{s}_close" for s in HOURLY_SYMBOLS)} FROM panel""")
def cols_by_pattern(t: Tables) -> DataFrame:
    """The columns whose name holds close, sma, rsi or macd, up to the limit of the autoregression."""
    panel = t.hourly_panel()
    return panel.select("ts", *columns_with(panel.columns, limit=SHORT.var_columns))


@query("first_n_cols", f"""WITH {HB}, {panel_sql('hb', 'panel', HOURLY_SYMBOLS, CELLS)} SELECT ts, {", ".join([f"{s}_{f}" for s in HOURLY_SYMBOLS for f in CELLS][:10])} FROM panel""")
def first_n_cols(t: Tables) -> DataFrame:
    panel = t.hourly_panel()
    return panel.select("ts", *[c for c in panel.columns if c != "ts"][:10])


@query("split_symbol_feature", f"""WITH {HB} SELECT ts, symbol, feature, value FROM (
   SELECT p.ts, s.symbol, unnest(['open', 'high', 'low', 'close']) AS feature, unnest([b.open, b.high, b.low, b.close]) AS value
   FROM (SELECT DISTINCT ts FROM hb) p CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in HOURLY_SYMBOLS)}) AS s(symbol)
   LEFT JOIN hb b ON b.ts = p.ts AND b.symbol = s.symbol)""")
def split_symbol_feature(t: Tables) -> DataFrame:
    panel = t.hourly_panel(PRICES)
    return align.melt_panel(panel, [c for c in panel.columns if c != "ts"])


@query("reindex_cols", f"""WITH {THIN}, {panel_sql('thin', 'panel', HOURLY_SYMBOLS, ['close'])} SELECT ts,
   coalesce(last_value(view_close IGNORE NULLS) OVER b, first_value(view_close IGNORE NULLS) OVER a, 0.0) AS view_close, CAST(0 AS DOUBLE) AS absent_close,
   coalesce(last_value(click_close IGNORE NULLS) OVER b, first_value(click_close IGNORE NULLS) OVER a, 0.0) AS click_close
   FROM panel WINDOW b AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def reindex_cols(t: Tables) -> DataFrame:
    wanted = ["view_close", "absent_close", "click_close"]
    shaped = align.reindex_columns(t.thin_panel(), ["ts"], wanted)
    return fill_rows(shaped, wanted, step_seconds=HOUR).fillna(0.0)
