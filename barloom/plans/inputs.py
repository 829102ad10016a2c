"""Source and sink queries. File formats are written by Spark to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import iso_z
from barloom.operators import quality
from barloom.plans.catalog import CELLS, DB, HB, HOURLY, HOURLY_SYMBOLS, PRICES, SPREADS, Tables, query, with_spreads
from barloom.session import work_path
from barloom.sources import sinks, store
from barloom.sources.files import rows_from_specs, scan_csv_any, scan_csv_fixed
from barloom.sources.ticks import bars, feed, recent_bars, require_rows

_ALL = "symbol, ts, open, high, low, close, volume"


@query("src_ohlcv", f"WITH {HB} SELECT {_ALL} FROM hb WHERE symbol IN ('click', 'view') AND ts >= (SELECT max(ts) FROM hb WHERE symbol IN ('click', 'view')) - INTERVAL 7 DAY")
def src_ohlcv(t: Tables) -> DataFrame:
    recent = recent_bars(t.table("events"), **HOURLY, symbols=["click", "view", "absent"], span_days=7)
    return require_rows(recent, "the wanted symbols")


@query("bars_hourly", f"WITH {HB} SELECT {_ALL} FROM hb")
def bars_hourly(t: Tables) -> DataFrame:
    return t.hourly()


@query("bars_daily", f"WITH {DB} SELECT {_ALL} FROM db")
def bars_daily(t: Tables) -> DataFrame:
    return t.daily()


@query("bars_minute", f"WITH {HB.replace(chr(39) + 'hour' + chr(39), chr(39) + 'minute' + chr(39))} SELECT {_ALL} FROM hb")
def bars_minute(t: Tables) -> DataFrame:
    return bars(
        t.table("events"), symbol="event_type", ts="ts", price="value", tick_order=["ts", "event_id"], unit="MINUTE"
    )


@query("bars_by_supplier", """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('day', l_shipdate) AS ts,
   first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(l_extendedprice) AS high,
   min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close,
   CAST(count(*) AS DOUBLE) AS volume FROM lineitem GROUP BY l_suppkey, date_trunc('day', l_shipdate)""")
def bars_by_supplier(t: Tables) -> DataFrame:
    """Daily bars of many symbols: suppliers as symbols, line prices as ticks."""
    ticks = t.table("lineitem").withColumn("symbol", F.col("l_suppkey").cast("string"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return bars(ticks, symbol="symbol", ts="l_shipdate", price="l_extendedprice", tick_order=order, unit="DAY")


@query("scan_parquet", f"WITH {HB} SELECT symbol, ts, close FROM hb WHERE ts >= TIMESTAMP '2024-01-10'")
def scan_parquet(t: Tables) -> DataFrame:
    path = sinks.sink_parquet(t.hourly(), work_path(t.spark, "bars"))
    stored = t.spark.read.parquet(path)
    return stored.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("symbol", "ts", "close")


@query("sink_parquet", f"WITH {DB} SELECT {_ALL} FROM db")
def sink_parquet(t: Tables) -> DataFrame:
    path = sinks.sink_parquet(t.daily(), work_path(t.spark, "panel"), partition_by=["symbol"])
    return t.spark.read.parquet(path).select("symbol", "ts", *CELLS)


@query("scan_csv_any", f"WITH {HB} SELECT ts, close AS value FROM hb")
def scan_csv_any_query(t: Tables) -> DataFrame:
    """A CSV with blanks and a byte order mark in its header and junk in some cells of another column."""
    odd = t.hourly().select(F.col("ts").cast("string").alias(" ﻿Datetime "), F.col("symbol").alias("note"), F.col("close").cast("string").alias("Adj Close "))
    return scan_csv_any(t.spark, sinks.sink_csv(odd, work_path(t.spark, "any")))


@query("scan_csv_epoch", f"WITH {HB} SELECT ts, close AS value FROM hb")
def scan_csv_epoch(t: Tables) -> DataFrame:
    """The same with epoch milliseconds as text and a column name that only contains `close`."""
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    odd = t.hourly().select(millis.alias("time"), F.col("symbol").alias("note"), F.col("close").alias("my_Close_px"))
    return scan_csv_any(t.spark, sinks.sink_csv(odd, work_path(t.spark, "epoch")))


@query("scan_csv_fixed", f"WITH {DB} SELECT ts, close, high, low FROM db")
def scan_csv_fixed_query(t: Tables) -> DataFrame:
    """A forecast CSV whose header names are wrong."""
    named = t.daily().select(F.col("ts").alias("x"), F.col("close").alias("GC=F_close"), F.col("high").alias("GC=F_high"), F.col("low").alias("y"))
    return scan_csv_fixed(t.spark, sinks.sink_csv(named, work_path(t.spark, "fixed")))


_ROW_TYPE = "STRUCT<Date: STRING, Open: DOUBLE, Close: DOUBLE>"


@query("scan_json_rows", f"""WITH {HB} SELECT symbol || ' ' || strftime(ts, '%Y-%m-%d') AS name,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "Date", open AS "Open", close AS "Close" FROM hb""")
def scan_json_rows(t: Tables) -> DataFrame:
    """One chart document per symbol and day; its rows sit at the top, in a layer, or in a file of their own."""
    row = F.struct(iso_z(F.col("ts")).alias("Date"), F.col("open").alias("Open"), F.col("close").alias("Close"))
    day = F.to_date("ts")
    docs = t.hourly().groupBy("symbol", day.alias("day")).agg(F.array_sort(F.collect_list(row)).alias("values"))
    docs = docs.withColumn("name", F.concat_ws(" ", "symbol", F.col("day").cast("string")))
    inner = F.to_json(F.struct("values"))
    top = F.concat(F.lit('{"mark": "line", "data": '), inner, F.lit("}"))
    layer = F.concat(F.lit('{"layer": [{"mark": "rule"}, {"data": '), inner, F.lit("}]}"))
    linked = F.concat(F.lit('{"data": {"url": "'), F.col("name"), F.lit('"}}'))
    kind = F.when(F.col("symbol") < "e", top).when(F.col("symbol") < "q", layer).otherwise(linked)
    specs = docs.select("name", kind.alias("text"))
    listed = F.when(F.col("symbol") == "view", F.to_json("values")).otherwise(
        F.concat(F.lit('{"data": '), F.to_json("values"), F.lit("}"))
    )
    files = docs.filter(F.col("symbol") >= "q").select(F.col("name").alias("url"), listed.alias("text"))
    return rows_from_specs(specs, files, _ROW_TYPE)


@query("sink_csv", f"WITH {HB}, {SPREADS} SELECT 'last' AS model, symbol, ts, close AS yhat FROM spreads UNION ALL SELECT 'spread', symbol, ts, high_spread FROM spreads", doubles="yhat")
def sink_csv(t: Tables) -> DataFrame:
    """Forecasts per model; the model without values gets no file."""
    models = {"last": F.col("close"), "spread": F.col("high_spread"), "empty": F.lit(None).cast("double")}
    cells = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("yhat")) for m, c in models.items()])
    path = sinks.sink_forecasts(with_spreads(t.hourly()).select("symbol", "ts", F.inline(cells)), work_path(t.spark, "forecasts"))
    return t.spark.read.option("header", True).schema("symbol STRING, ts TIMESTAMP_NTZ, yhat DOUBLE, model STRING").csv(path)


@query("sink_by_symbol", f'WITH {HB} SELECT symbol, ts AS "Date", open AS "Open", high AS "High", low AS "Low", close AS "Close" FROM hb')
def sink_by_symbol(t: Tables) -> DataFrame:
    path = sinks.sink_by_symbol(t.hourly(), work_path(t.spark, "by-symbol"))
    schema = "Date TIMESTAMP_NTZ, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, symbol STRING"
    return t.spark.read.option("header", True).schema(schema).csv(path)


@query("sink_json_metrics", f"""WITH {HB} SELECT (SELECT bool_and(n > 100) FROM (SELECT count(close) AS n FROM hb GROUP BY symbol)) AS missing_rate_ok""")
def sink_json_metrics(t: Tables) -> DataFrame:
    path = sinks.sink_json(quality.rows_ok(t.hourly()), work_path(t.spark, "metrics"))
    return t.spark.read.schema("missing_rate_ok BOOLEAN").json(path)


_HISTORY = ["1H", "24H", "1W"]


@query("sink_json_history", f"""WITH {HB} SELECT p.period, symbol, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, open, high, low, close
  FROM hb, (VALUES ('1H'), ('24H'), ('1W')) AS p(period) WHERE ts >= (SELECT max(ts) FROM hb) - INTERVAL 729 DAY""")
def sink_json_history(t: Tables) -> DataFrame:
    """History documents of the last 729 days for the three hourly periods, written and parsed again."""
    documents = sinks.history_documents(feed(t.hourly(), symbols=HOURLY_SYMBOLS, span_days=729))
    path = sinks.sink_history(documents, work_path(t.spark, "history"))
    rows = "STRUCT<data: ARRAY<STRUCT<time: STRING, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE>>>"
    text = t.spark.read.option("wholetext", True).schema("value STRING, symbol STRING").text(path)
    parsed = text.select("symbol", F.inline(F.from_json("value", rows)["data"]))
    return parsed.select(F.explode(F.array(*[F.lit(p) for p in _HISTORY])).alias("period"), "symbol", "time", *PRICES)


_LABELLED = "(VALUES ('short', 'arimax'), ('short', 'var'), ('short', 'additive'), ('long', 'arimax'), ('long', 'var'), ('long', 'additive')) AS m(horizon, model)"
_ADDRESSES = {("24H", "Bayesian VAR"): "m.horizon = 'short' AND m.model = 'var'", ("6M", "all"): "m.horizon = 'long'", ("1H", "long_prophet"): "m.horizon = 'long' AND m.model = 'additive'", ("1m", "SARIMAX"): "m.horizon = 'long' AND m.model = 'arimax'"}


@query("model_locate", f"""WITH {HB}, tops AS (SELECT symbol, max(high) AS top FROM hb GROUP BY symbol)
  {" UNION ALL ".join(f"SELECT '{p}' AS period, '{n}' AS label, m.horizon, m.model, symbol, top FROM tops, {_LABELLED} WHERE {where}" for (p, n), where in _ADDRESSES.items())}""")
def model_locate(t: Tables) -> DataFrame:
    """Forecast sets of two horizons and three models, addressed by period and label: an alias, all, a label with its horizon."""
    tops = t.hourly().groupBy("symbol").agg(F.max("high").alias("top"))
    labels = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model")) for h in ("short", "long") for m in ("arimax", "var", "additive")]))
    table = tops.withColumn("_l", labels).select("symbol", "top", "_l.*")
    path = store.save_models(table, work_path(t.spark, "labelled"))
    found = [store.locate(t.spark, path, period=p, label=n).withColumns({"period": F.lit(p), "label": F.lit(n)}) for p, n in _ADDRESSES]
    stacked = found[0]
    for f in found[1:]:
        stacked = stacked.unionByName(f)
    return stacked.select("period", "label", "horizon", "model", "symbol", "top")
