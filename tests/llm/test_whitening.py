from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.llm import whitening

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, id INT, v INT, n INT, i INT"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def test_equal_to_dense_solver(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20)) * np.geomspace(1, 0.05, 20)[:, None]
    data = (rng.normal(size=(400, 20)) @ mix * 0.2).astype(np.float32)
    data = np.vstack([data, np.tile(data[3], (150, 1))])
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    odd = [(1000, None), (1001, [None, *data[0, 1:].tolist()]), (1002, [math.nan, *data[0, 1:].tolist()]), (1003, [math.inf, *data[0, 1:].tolist()])]
    got = whitening.whitened(vectors_of(spark, rows + odd)).collect()
    x = np.floor(1024 * data.astype(float)) + 100_000
    n = len(x)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = (x - x.mean(axis=0)) @ u[:, :8] / np.sqrt(e[:8])
    assert len(got) == n * 8 and {r["n"] for r in got} == {n}
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, [int(c) for c in x.sum(axis=0)])) for row in x]
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        i, k = r["vec_id"], r["component"] - 1
        sign.setdefault(k, np.sign(r["whitened"] * want[i, k]))
        assert abs(r["whitened"] - sign[k] * want[i, k]) < 1e-8 and r["deviation"] == exact[i]
        assert abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-10 and r["identity_error"] < 1e-9


def test_counts_follow_the_spectrum():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 30):
        a = rng.normal(size=(d, d))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in [*rng.normal(size=10) * 3, 0.0]:
            assert whitening.above(a, shift) == (e > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 2, 2, 1, 1, 1, 1, 0.5], [1e6, 1, 1 - 1e-9, 1e-3, 0, 0, 0, 0, 0], [3], [2, 1], [0, 0], [1 + 1e-14, 1, 1 - 1e-14, 0.3]])
def test_close_equal_and_vanishing_eigenvalues(spectrum):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    values, units = whitening.leading(v)
    k = min(8, len(spectrum))
    assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-12 * max(spectrum[0], 1))
    assert np.allclose(units @ units.T, np.eye(k), atol=1e-10)
    assert np.abs(v @ units.T - units.T * values).max() <= 1e-12 * max(spectrum[0], 1)


def test_small_tables(spark):
    assert whitening.whitened(vectors_of(spark, [])).collect() == []
    assert whitening.whitened(vectors_of(spark, [(1, None), (2, [None])])).collect() == []
    one = whitening.whitened(vectors_of(spark, [(1, [0.5, 0.25, 0.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(k, 0, None, None, None) for k in (1, 2, 3)]
    line = whitening.whitened(vectors_of(spark, [(k, [k / 4, 0.0]) for k in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] is None for r in line)


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**40 * (k % 3)), float(k)]) for k in range(300)]
    got = whitening.whitened(vectors_of(spark, rows)).filter("component = 1").collect()
    x = [[1024 * int(a) + 100_000 for a in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((300 * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (exact if exact < 2**63 else None)


def test_ragged_vectors_are_refused(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()
