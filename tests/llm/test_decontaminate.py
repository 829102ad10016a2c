from __future__ import annotations

import random
from itertools import combinations

from brute import ODD, leaks

from barloom.llm import decontaminate


def test_equal_to_all_alignments(spark):
    rng = random.Random(31)
    word = lambda: f"v{rng.randrange(40)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(14)] + [(99, ""), (98, None), (0, "other text " * 6)]
    docs = []
    for i in range(60):
        ws = [word() for _ in range(rng.randrange(60))]
        if i % 2:
            passage = (rng.choice(items[:14])[1]).split()
            for _ in range(rng.randrange(5)):
                passage[rng.randrange(len(passage))] = "changed"
            cut = rng.randrange(len(passage))
            ws = ws + (passage if i % 4 == 1 else passage[cut:]) + ws
        docs.append((i, ", ".join(w.upper() if rng.random() < 0.3 else w for w in ws)))
    docs += [(100 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(i, t, "h", 1) for i, t in docs], "doc_id BIGINT, text STRING, _id STRING, _row INT")
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id BIGINT, text STRING, start STRING")
    want = leaks(docs, items)
    got = decontaminate.leaks(frame, bench)
    assert {(r["id"], r["item"]) for r in got.collect()} == want and len(want) > 10
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})


def test_every_allowed_substitution_is_found(spark):
    docs, items = [], []
    for n in range(1, 14):
        item = [f"q{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for size in range(n - -(-n * 80 // 100) + 1):
            for places in combinations(range(n), size):
                docs.append((len(docs) * 100 + n, " ".join("other" if k in places else w for k, w in enumerate(item))))
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = decontaminate.leaks(frame, bench).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in docs) and all(r["id"] % 100 == r["item"] for r in got)


def test_joined_seeds_repeats_nulls_and_empty_tables(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "clean")], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(5, text), (5, text), (None, text)], "item_id BIGINT, text STRING")
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
        assert sorted(map(repr, ((r["id"], r["item"]) for r in decontaminate.leaks(frame, bench).collect()))) == sorted(map(repr, [(None, None), (None, 5), (1, None), (1, 5)]))
        assert decontaminate.clean(frame, bench).collect() == [(2, "clean")]
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0 and decontaminate.clean(frame, bench.limit(0)).count() == 4
    plan = decontaminate.leaks(frame, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
