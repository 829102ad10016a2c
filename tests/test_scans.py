"""Bounds reach the scan, facts are joined without a hot task."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.config import HOUR
from barloom.operators import facts, views
from barloom.plans.catalog import Tables
from barloom.sources.ticks import bars, recent_bars, within

T0 = dt.datetime(2024, 1, 3, 5, 30)


def ticks(spark, zoned: bool = False):
    rows = [(i, "ab"[i % 2], T0 + dt.timedelta(minutes=7 * i), float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id BIGINT, s STRING, t TIMESTAMP_NTZ, v DOUBLE")
    return df.withColumn("t", F.col("t").cast("timestamp")) if zoned else df


@pytest.mark.parametrize("unit", ["MINUTE", "HOUR", "DAY"])
@pytest.mark.parametrize("zoned", [False, True])
def test_bounds_on_ticks_keep_whole_bars(spark, unit, zoned):
    how = {"symbol": "s", "ts": "t", "price": "v", "tick_order": ["t", "id"], "unit": unit}
    df = ticks(spark, zoned)
    for since, until in ((T0 + dt.timedelta(hours=30), T0 + dt.timedelta(hours=70)), (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 5)), (None, T0), (T0, None)):
        everything = bars(df, **how)
        a = everything.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else everything
        a = a.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz")) if until else a
        assert sorted(a.collect()) == sorted(bars(df, **how, since=since, until=until).collect())


def test_recent_bars_without_ticks(spark):
    got = recent_bars(ticks(spark), symbol="s", ts="t", price="v", tick_order=["t", "id"], unit="HOUR", symbols=["z"], span_days=2)
    assert got.count() == 0


def test_plans_push_bounds_to_the_scan(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    t = Tables(spark, tables)
    bound = within(t.table("events"), "ts", "HOUR", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6))
    queries = {"bars": bound}
    from barloom.plans import load

    for name in ("src_ohlcv", "filter_end_date", "visible_high_low", "range_from_now", "merge_cutoff"):
        queries[name] = load().QUERIES[name](spark, tables)
    for name, df in queries.items():
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in x and "events.parquet" in x]
        assert scans and all("(ts," in x.split("PushedFilters")[1] for x in scans), (name, scans)


def test_range_bounds_hold_what_the_range_keeps(spark):
    as_of = dt.datetime(2024, 1, 28, 6, 30)
    rows = spark.range(0, 9000).select((F.lit("2023-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    for period in ("1H", "24H", "1W", "1M", "6M", "unknown"):
        kept = views.range_until(rows, period, F.lit(as_of).cast("timestamp_ntz"))
        low, high = views.range_bounds(period, as_of)
        assert kept.filter(~F.col("ts").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))).count() == 0


def test_facts_beyond_the_limit_are_salted(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("symbol"), "id")
    table = rows.groupBy("symbol").agg(F.max("id").alias("top"))
    wanted = sorted(rows.join(table, "symbol").collect())
    salted = facts.join_facts(rows, table, ["symbol"], limit=0, salts=8)
    assert sorted(salted.collect()) == wanted == sorted(facts.join_facts(rows, table, ["symbol"]).collect())
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString() and salted.columns == ["symbol", "id", "top"]


def test_nearest_rows_with_all_probes_in_one_hour(spark, monkeypatch):
    """Probes before, inside and after sparse bars, thousands of them in one gap, broadcast and salted alike."""
    from barloom.operators import align

    times = sorted({T0 + dt.timedelta(hours=h) for h in (0, 1, 2, 70, 71, 500, 5000)})
    bars_ = spark.createDataFrame([(s, t, float(k)) for s in "ab" for k, t in enumerate(times)], "symbol STRING, ts TIMESTAMP_NTZ, close DOUBLE")
    probes = [("a", T0 + dt.timedelta(hours=300, seconds=k % 3600)) for k in range(4000)]
    probes += [("b", T0 + dt.timedelta(hours=h, minutes=30)) for h in (-900, -1, 0, 1, 35, 70, 285, 2750, 4999, 9000)] + [("a", None), ("none", T0)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(probes)], "id INT, symbol STRING, ts TIMESTAMP_NTZ")
    want = {}
    for i, (s, t) in enumerate(probes):
        want[i] = None if t is None or s == "none" else min(times, key=lambda x: (abs(x - t), x))
    for limit in (100_000, 0):
        monkeypatch.setattr(align, "BROADCAST_FACTS", limit)
        got = align.nearest_rows(table, bars_, ["close"], step_seconds=HOUR)
        assert got.columns == ["id", "symbol", "ts", "bar_ts", "close"]
        assert {r["id"]: r["bar_ts"] for r in got.collect()} == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
