"""Small frames and their pandas twins."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HOUR = 3600
START = dt.datetime(2024, 1, 1)


def times(n: int, step_seconds: int = HOUR, start: dt.datetime = START) -> list[dt.datetime]:
    return [start + dt.timedelta(seconds=step_seconds * i) for i in range(n)]


def clean(x):
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else x


def series(spark: SparkSession, values: dict[str, list], column: str = "close") -> DataFrame:
    rows = [(s, t, clean(v)) for s, vs in values.items() for t, v in zip(times(len(vs)), vs)]
    return spark.createDataFrame(rows, f"symbol STRING, ts TIMESTAMP_NTZ, {column} DOUBLE")


def random_bars(n: int, symbols=("a", "b"), seed: int = 7, drop: float = 0.0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(size=n))
        open_ = close + rng.normal(size=n)
        frame = pd.DataFrame(
            {
                "symbol": s, "ts": times(n), "open": open_, "high": np.maximum(open_, close) + rng.random(n),
                "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(1, 50, n).astype(float),
            }
        )
        out.append(frame[rng.random(n) >= drop])
    return pd.concat(out, ignore_index=True)


def to_spark(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    schema = "symbol STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
    rows = [tuple(clean(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    rows = [(r[0], pd.Timestamp(r[1]).to_pydatetime(), *r[2:]) for r in rows]
    return spark.createDataFrame(rows, schema)


def column(df: DataFrame, name: str, symbol: str | None = None, order: str = "ts") -> list:
    part = df if symbol is None else df.filter(df.symbol == symbol)
    return [r[name] for r in part.orderBy(order).collect()]


def same(got: list, want, tol: float = 1e-9) -> None:
    want = [None if w is None or (isinstance(w, float) and np.isnan(w)) else float(w) for w in want]
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        if w is None or g is None:
            assert g is None and w is None, (i, g, w)
        else:
            assert abs(g - w) <= tol * max(1.0, abs(w)), (i, g, w)
