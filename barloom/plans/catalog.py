"""The registry of queries, the tables they read and the reference SQL they are checked with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import HOUR
from barloom.functions.scalar import high_spread, low_spread
from barloom.operators.align import wide_panel
from barloom.operators.blocks import POS, number_rows, over_blocks
from barloom.session import prepare
from barloom.sources.ticks import bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOURLY_SYMBOLS = ["click", "error", "purchase", "signup", "view"]
DAILY_SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
HOURLY_TARGET = "click"
DAILY_TARGET = "1-URGENT"
HOURLY = {"symbol": "event_type", "ts": "ts", "price": "value", "tick_order": ["ts", "event_id"], "unit": "HOUR"}
PRICES = ["open", "high", "low", "close"]
CELLS = [*PRICES, "volume"]


class Tables:
    """The given tables, and the bars built from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def hourly(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Hourly bars: event type as symbol, event value as price."""
        return bars(self.table("events"), **HOURLY, since=since, until=until)

    def daily(self) -> DataFrame:
        """Daily bars: order priority as symbol, order total as price."""
        return bars(
            self.table("orders"), symbol="o_orderpriority", ts="o_orderdate", price="o_totalprice",
            tick_order=["o_orderdate", "o_orderkey"], unit="DAY",
        )

    def thin(self, at_least: int = 3) -> DataFrame:
        """Hourly bars whose prices count as missing where a bar holds too few ticks."""
        enough = F.col("volume") >= at_least
        return self.hourly().withColumns({c: F.when(enough, F.col(c)) for c in PRICES})

    def dirty(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Hourly bars with bad cells, depending on the tick count of the bar."""
        v = F.col("volume")
        b = self.hourly(since, until)
        base = {c: F.when(v == 1, None).when(v == 2, 0.0).otherwise(F.col(c)) for c in PRICES}
        base["close"] = F.when(v == 3, float("inf")).otherwise(base["close"])
        base["low"] = F.when(v == 4, -F.col("low")).otherwise(base["low"])
        base["high"] = F.when(v == 5, F.col("high") * 1e6).otherwise(base["high"])
        return b.withColumns(base)

    def hourly_panel(self, features: list[str] | None = None) -> DataFrame:
        return wide_panel(self.hourly(), HOURLY_SYMBOLS, features or CELLS)

    def thin_panel(self, features: list[str] | None = None) -> DataFrame:
        return wide_panel(self.thin(), HOURLY_SYMBOLS, features or ["close"])


# --- SQL building blocks: the same tables for the checking engine ---------------------------------------------------

HB = """hb AS (
  SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts,
         first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high, min(e.value) AS low,
         last(e.value ORDER BY e.ts, e.event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events e GROUP BY e.event_type, date_trunc('hour', e.ts))"""
DB = """db AS (
  SELECT o.o_orderpriority AS symbol, date_trunc('day', o.o_orderdate) AS ts,
         first(o.o_totalprice ORDER BY o.o_orderdate, o.o_orderkey) AS open, max(o.o_totalprice) AS high,
         min(o.o_totalprice) AS low, last(o.o_totalprice ORDER BY o.o_orderdate, o.o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders o GROUP BY o.o_orderpriority, date_trunc('day', o.o_orderdate))"""
THIN = HB + """, thin AS (SELECT symbol, ts, {}, volume FROM hb)""".format(
    ", ".join(f"CASE WHEN volume >= 3 THEN {c} END AS {c}" for c in PRICES)
)
DIRTY = HB + """, dirty AS (
  SELECT symbol, ts,
    CASE WHEN volume = 1 THEN NULL WHEN volume = 2 THEN 0.0 ELSE open END AS open,
    CASE WHEN volume = 5 THEN high * 1e6 WHEN volume = 1 THEN NULL WHEN volume = 2 THEN 0.0 ELSE high END AS high,
    CASE WHEN volume = 4 THEN -low WHEN volume = 1 THEN NULL WHEN volume = 2 THEN 0.0 ELSE low END AS low,
    CASE WHEN volume = 3 THEN CAST('inf' AS DOUBLE) WHEN volume = 1 THEN NULL WHEN volume = 2 THEN 0.0 ELSE close END AS close,
    volume
  FROM hb)"""


def panel_sql(source: str, name: str, symbols: list[str], features: list[str]) -> str:
    cells = ", ".join(
        f"""max(CASE WHEN symbol = '{s}' THEN {f} END) AS "{s}_{f}" """ for s in symbols for f in features
    )
    return f"{name} AS (SELECT ts, {cells} FROM {source} GROUP BY ts)"


def query(name: str, sql: str | None = None, *, doubles: str = "", digits: int = 6) -> Callable:
    """Register a query; the `doubles` columns are rounded on both sides before they are compared."""
    names = doubles.split()

    def register(fn: Callable[[Tables], DataFrame]) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names}) if names else out

        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            replace = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in names)
            ORACLES[name] = f"SELECT * REPLACE ({replace}) FROM ({sql}) AS answer" if names else sql
        return run

    return register


# --- predictions with a closed form, so that errors can be checked before any model exists --------------------------

TARGETS = ["close", "high_spread", "low_spread"]
SIMPLE_MODELS = {"last": 1, "season": 24}


def with_spreads(df: DataFrame) -> DataFrame:
    return df.withColumns({"high_spread": high_spread(), "low_spread": low_spread()})


def scored(t: Tables, *, positions: bool = False) -> DataFrame:
    """(symbol, model, target, ts, actual, predicted): each value predicted by the one 1 and 24 rows before.

    Only the first rows of a series lack a prediction, so positions stay consecutive and can be kept.
    """

    def build(d: DataFrame, w) -> DataFrame:
        pairs = [
            F.struct(
                F.lit(m).alias("model"), F.lit(c).alias("target"), F.col(c).alias("actual"),
                F.lag(c, k).over(w).alias("predicted"),
            )
            for m, k in SIMPLE_MODELS.items()
            for c in TARGETS
        ]
        return d.withColumn("pairs", F.array(*pairs))

    numbered = number_rows(with_spreads(t.hourly()), by=["symbol"], step_seconds=HOUR)
    rows = over_blocks(numbered, build, step_seconds=HOUR, halo=max(SIMPLE_MODELS.values()))
    pairs = rows.select("symbol", "ts", POS, F.inline("pairs")).dropna(subset=["actual", "predicted"])
    return pairs if positions else pairs.drop(POS)


SPREADS = """spreads AS (SELECT *, greatest(high - close, 0) AS high_spread, greatest(close - low, 0) AS low_spread FROM hb)"""
SCORED = HB + ", " + SPREADS + ", scored AS (" + " UNION ALL ".join(
    f"SELECT * FROM (SELECT symbol, ts, '{m}' AS model, '{c}' AS target, {c} AS actual,"
    f" lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS predicted FROM spreads) AS x{m}{c} WHERE predicted IS NOT NULL"
    for m, k in SIMPLE_MODELS.items()
    for c in TARGETS
) + ")"
HITS = SCORED + """, moves AS (SELECT *, lag(actual) OVER w AS a0, lag(predicted) OVER w AS p0 FROM scored
  WINDOW w AS (PARTITION BY symbol, model, target ORDER BY ts)),
hits AS (SELECT *, actual - predicted AS e,
  (coalesce(CASE WHEN a0 = 0 THEN actual > 0 ELSE actual / a0 - 1 > 0 END, false)
   = coalesce(CASE WHEN p0 = 0 THEN predicted > 0 ELSE predicted / p0 - 1 > 0 END, false)) AS hit FROM moves)"""
MAE = "avg(abs(e))"
RMSE = "sqrt(avg(e * e))"
MAPE = "avg(abs(e) / greatest(abs(actual), 2.220446049250313e-16))"
SMAPE = "100 * avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0.0 ELSE 2 * abs(e) / (abs(actual) + abs(predicted)) END)"
SCORE_KEYS = ["symbol", "model", "target"]
EVAL_SQL = f"""CAST(count(*) AS BIGINT) AS n, {MAE} AS mae, {RMSE} AS rmse,
  CASE WHEN target NOT LIKE '%spread%' THEN {MAPE} END AS mape,
  CASE WHEN target LIKE '%spread%' THEN {SMAPE} END AS smape, avg(CAST(hit AS DOUBLE)) AS dir_acc"""
