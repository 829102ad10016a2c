from __future__ import annotations

import random

import numpy as np
from brute import ODD, held_out
from pyspark.sql import functions as F

from barloom.llm import registry, toxicity


def test_pairs_count_beyond_their_sum():
    """Only both words together are toxic, which no sum of single weights can tell."""
    rng = np.random.default_rng(3)
    flags = rng.random((4000, 6)) < 0.4
    y = (flags[:, 0] & flags[:, 1]).astype(float)
    bias, w, v = toxicity.fit([np.flatnonzero(f) for f in flags], y, np.ones(len(y)), 6)
    machine = toxicity.Machine(bias, np.arange(6), w, v)
    wrong = ((machine.margins(flags.astype(float)) > 0) != (y > 0)).mean()
    assert wrong < 0.01 and v[0] @ v[1] > 0.5


def test_margin_equals_the_double_sum():
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(0.3, np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)))
    x = (rng.random((7, 9)) < 0.5).astype(float)
    for row, got in zip(x, machine.margins(x)):
        on = np.flatnonzero(row)
        want = 0.3 + machine.linear[on].sum() + sum(machine.factors[i] @ machine.factors[j] for i in on for j in on if i < j)
        assert abs(got - want) < 1e-9


def test_odd_texts_and_empty_tables(spark):
    rng = random.Random(43)
    docs = [(i, " ".join(rng.choice(["good", "day", "fine", "tree"]) for _ in range(8)) + (" idiot" if i % 3 == 0 else "")) for i in range(60)]
    frame = spark.createDataFrame([*docs, *((100 + i, t) for i, t in enumerate(ODD)), (None, "idiot"), (0, docs[0][1])], "id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 1), (None, 1)], "id BIGINT, label INT")
    machine = toxicity.learn(frame, labels)
    rows = toxicity.scored(frame, machine).collect()
    assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["id"]: r["score"] for r in rows}
    assert min(got[i] for i in range(0, 60, 3)) > max(got[i] for i in range(60) if i % 3)
    assert got[100] == got[101] == got[102]
    assert toxicity.scored(frame.limit(0), machine).count() == 0
    nothing = toxicity.learn(frame, labels.limit(0))
    assert nothing is None and {r["score"] for r in toxicity.scored(frame, nothing).collect()} == {0.0}


def test_held_out_accuracy(spark, tables):
    folder = tables.replace("sf0.001", "sf0.01")
    labels = registry.table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("toxic"))
    rows = registry.QUERIES["op1_factorization_machine"](spark, folder).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9
