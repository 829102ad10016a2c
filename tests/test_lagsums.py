"""Sums kept by lag difference against sums over the lagged rows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.models import lagsums, linear
from barloom.models.windows import END, VALID, Folds, Whole
from helpers import HOUR
from test_models import DESIGN, FEATURES, frame, simulate

COLUMNS = ("close", "spread", *FEATURES)


def direct(data: dict, rows: int, lags: int) -> np.ndarray:
    x = np.column_stack([data[c] for c in COLUMNS])[:rows]
    z = np.column_stack([np.ones(max(rows - lags, 0)), *[x[lags - k : rows - k] for k in range(lags, -1, -1)]]) if rows > lags else np.zeros((0, 1 + (lags + 1) * 4))
    return z.T @ z


@pytest.mark.parametrize("cutter", [Folds(40, 10, 7), Whole(5), Whole(1)])
def test_every_window_and_every_number_of_lags(spark, cutter):
    data = {"a": simulate(1, 101), "b": simulate(2, 73), "c": simulate(3, 6)}
    rows = None
    for symbol, d in data.items():
        part = frame(spark, d, symbol)
        rows = part if rows is None else rows.unionByName(part)
    windows = cutter.windows(rows, ["symbol"])
    sums, state = lagsums.lagged_sums(rows, DESIGN, windows, 8, cutter, validation=True)
    sums, state = sums.toPandas(), state.toPandas()
    assert len(state) == windows.count()
    for _, one in state.iterrows():
        mine = sums[(sums["symbol"] == one["symbol"]) & (sums["fold"] == one["fold"])]
        for slot in (END, VALID):
            at = int(mine[mine["slot"] == slot]["at"].iloc[0])
            for lags in (1, 3, 8):
                got = lagsums.window_gram(mine, state[(state["symbol"] == one["symbol"]) & (state["fold"] == one["fold"])], lags, slot)
                np.testing.assert_allclose(got, direct(data[one["symbol"]], at, lags), rtol=1e-9, atol=1e-7)


def test_numbers_per_piece_grow_with_the_lags_and_not_with_their_square(spark):
    rows = frame(spark, simulate()).withColumn("piece", F.floor(F.col("_pos") / 100).cast("long"))
    numbers = {}
    for lags in (5, 10, 20):
        one = lagsums.piece_sums(rows, COLUMNS, lags, by=["symbol"]).filter("piece = 3")
        numbers[lags] = one.agg(F.sum(F.size("values"))).first()[0]
    assert numbers == {lags: (lags + 1) * (len(COLUMNS) + 1) ** 2 for lags in numbers}


def test_blocks_shorter_than_a_piece(spark):
    rows = frame(spark, simulate(n=150)).withColumn("piece", F.floor(F.col("_pos") / 60).cast("long"))
    got = [lagsums.running(lagsums.piece_sums(rows, COLUMNS, 7, by=["symbol"], block=b), ["symbol"]).orderBy("piece", "d").collect() for b in (16, 4096)]
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]] and len(got[0]) == 3 * 8
    np.testing.assert_allclose([r["values"] for r in got[0]], [r["values"] for r in got[1]], rtol=1e-10)


def test_running_sums_of_split_pieces(spark):
    parts = [("a", p, d, [float(p + d), 1.0]) for p in range(4) for d in range(2) for _ in range(2)] + [("b", 2, 0, [5.0, 5.0])]
    table = spark.createDataFrame(parts, "symbol STRING, piece BIGINT, d INT, values ARRAY<DOUBLE>").repartition(7)
    got = {(r["symbol"], r["piece"], r["d"]): r["values"] for r in lagsums.running(table, ["symbol"]).collect()}
    want = {("a", p, d): [2.0 * sum(q + d for q in range(p + 1)), 2.0 * (p + 1)] for p in range(4) for d in range(2)} | {("b", 2, 0): [5.0, 5.0]}
    assert got == want


def test_one_ridge_path_equals_single_solutions():
    rng = np.random.default_rng(3)
    x, y = np.column_stack([np.ones(200), rng.normal(3, 2, (200, 5))]), rng.normal(size=(200, 2))
    z = np.column_stack([x, y])
    path = linear._ridge_path(z.T @ z, 6)
    for ridge in linear.RIDGES:
        penalty = ridge * np.diag(np.r_[0, (x[:, 1:] ** 2).sum(axis=0)])
        np.testing.assert_allclose(path(ridge), np.linalg.solve(x.T @ x + penalty, x.T @ y), rtol=1e-8)
