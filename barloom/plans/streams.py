"""Streaming queries, drained over what the tick table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.plans.catalog import HB, Tables, query
from barloom.streaming import bars as live


def _ticks(t: Tables) -> DataFrame:
    return live.tick_stream(t.spark, t.folder, "events.parquet", t.table("events").schema)


@query("stream_bars", f"WITH {HB} SELECT symbol, ts, open, high, low, close, volume FROM hb WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_bars(t: Tables) -> DataFrame:
    """Hourly bars whose end lies behind the watermark."""
    out = live.stream_bars(_ticks(t), symbol="event_type", price="value", tick_id="event_id", unit="HOUR")
    return t.spark.read.parquet(live.run_to_table(out, "live-bars"))


@query("stream_latest", "SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS latest_price, max(ts) AS ts FROM events GROUP BY event_type")
def stream_latest(t: Tables) -> DataFrame:
    out = live.stream_latest(_ticks(t), symbol="event_type", price="value", tick_id="event_id")
    return live.read_latest(t.spark, live.run_latest(out, "latest"))
