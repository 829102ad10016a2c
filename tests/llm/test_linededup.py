from __future__ import annotations

import random

import pyarrow as pa
from brute import ODD, line_dedup

from barloom.llm import linededup

LINES = [f"this is line number {k} of the set" for k in range(12)] + ["short", "", "  This is LINE number 3 of the set\t", "exactly twenty chars", "nineteen characters"]


def test_equal_to_plain_python(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(8)))) for i in range(120)]
    docs += [(200 + i, t) for i, t in enumerate(ODD)] + [(None, LINES[0]), (119, LINES[1]), (119, LINES[1])]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id BIGINT, text STRING, _row STRING, _keep STRING")
    got = linededup.deduped(frame)
    assert got.columns == frame.columns
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted((repr(i), t) for i, t, _, _ in line_dedup(docs))


def test_a_line_that_all_documents_share(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the very same line in all documents\nown ' || id AS text")
    got = linededup.marked(docs, "_keep")
    assert got.filter("_keep IS NULL").select("doc_id").collect() == [(2999,)]
    assert linededup.deduped(docs.limit(0)).count() == 0


def test_stream_does_not_depend_on_batches_or_partitions():
    rng = random.Random(7)
    rows = sorted(((rng.randrange(9), -rng.randrange(12)) for _ in range(80)))
    rows = [(k, -d) for k, d in rows]

    def table(part):
        n = len(part)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part]), pa.array([0] * n), pa.array([r[1] for r in part]), pa.array([0] * n), pa.array([[1]] * n, pa.list_(pa.int32()))],
            ["h1", "h2", "doc", "row", "at"],
        )

    want = sorted((k, d) for k, d in rows if sum(x == k for x, _ in rows) >= 3 and d != max(y for x, y in rows if x == k))
    for _ in range(60):
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randrange(4)))})
        size, out = rng.randrange(1, 20), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = rows[a:b]
            for got in linededup.stream(iter([table(part[i : i + size]) for i in range(0, len(part), size)]), 3):
                out += got.to_pylist()
        dropped = [(r["h1"], r["doc"]) for r in out if not r["open"]]
        for key in {r["h1"] for r in out if r["open"]}:
            mine = [r for r in out if r["open"] and r["h1"] == key]
            best = max(r["doc"] for r in mine)
            if sum(r["n"] for r in mine) >= 3:
                dropped += [(key, r["doc"]) for r in mine if r["doc"] != best and r["at"]]
        assert sorted(dropped) == want, (cuts, size)


def test_lines_that_a_polynomial_hash_confuses(spark):
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    rows = [(1, a), (2, a), (3, a.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, _doc INT")
    assert sorted(r[:2] for r in linededup.deduped(docs).collect()) == rows
