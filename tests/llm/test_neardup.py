from __future__ import annotations

import random
import tracemalloc

import numpy as np
from brute import ODD, near_duplicates, shingles

from barloom.llm import neardup
from barloom.llm.components import components


def copies(rng: random.Random, base: list[str], n: int, changes: int) -> list[str]:
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(changes + 1)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10_000)}"
        out.append(" ".join(ws))
    return out


def test_equal_to_all_pairs(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (120, 400, 60, 4)]
    texts = [t for b, c in zip(base, (3, 10, 1, 0)) for t in copies(rng, b, 40, c)]
    texts += [*ODD, ODD[-1], "same few words", "same few words", "Same  FEW words"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, id INT, n INT")
    for percent in (80, 85):
        want = near_duplicates(list(enumerate(texts)), percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, percent=percent).collect()}
        assert got == want
    stay = neardup.without_copies(docs, percent=85)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted({c for _, c in want.values()})


def test_members_that_the_leader_does_not_link(spark):
    """A crowd of copies far from the leader, linked in a chain among themselves only."""
    base = [f"b{k}" for k in range(200)]
    chain = [" ".join(base[:k] + [f"x{j}" for j in range(k)] + base[k:]) for k in range(0, 80, 3)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id BIGINT, text STRING")
    want = near_duplicates(list(enumerate(chain)), 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(chain)


def test_blocks_find_the_links_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    texts = dict(enumerate(copies(rng, base, 90, 6) + copies(rng, base[:130], 30, 4)))
    sets = {i: np.unique(np.array([hash(s) & (2**63 - 1) for s in shingles(t)], np.uint64)) for i, t in texts.items()}
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id BIGINT, items BINARY")
    members = spark.createDataFrame([(b, i, len(s), i) for i, s in sets.items() for b in {i % 2, (i + 1) % 2}], "band BIGINT, id BIGINT, n BIGINT, comp BIGINT")
    links = neardup.within_groups(members, table, 85)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    want = near_duplicates(list(texts.items()), 85)
    assert {i: root.get(i, i) for i in texts} == {i: c for i, (_, c) in want.items()}


def plain_super_minhash(items: np.ndarray, slots: int) -> list[int]:
    """One element after the other, with its whole permutation."""
    out = [2**64 - 1] * slots
    steps = neardup.texts.constants(slots, 21)
    for x in items:
        p = list(range(slots))
        for j in range(slots):
            r = int(neardup.texts.mix(np.array([x ^ steps[j]], np.uint64))[0])
            k = j + (((r & 0xFFFFFFFF) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], (j << 32) | (r >> 32))
    return out


def test_signatures_equal_the_sequential_definition_and_estimate_similarity():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 40, 300)] + [np.empty(0, np.uint64)]
    got = neardup.super_minhash(sets, 16)
    for s, row in zip(sets, got):
        assert row.tolist() == plain_super_minhash(s, 16)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = neardup.super_minhash([x[:50], x[10:]])
        errors.append((a == b).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(2 / 9 / neardup.SLOTS)


def test_components_equal_union_find(spark):
    rng = random.Random(17)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rng.shuffle(pairs)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(None, None, True), (3, None, False), (4, 4, True)}
    assert {r["doc_id"] for r in neardup.without_copies(docs).collect()} == {None, 4}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_a_polynomial_hash_confuses(spark):
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, a), (3, other), (4, f"{a} x y z w"), (5, f"{other} x y z w")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, _stays INT")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == near_duplicates(rows, 85)
    assert sorted(r["doc_id"] for r in neardup.without_copies(docs).collect()) == [1, 3, 4, 5]


def test_signatures_lay_out_a_bounded_part_at_once(monkeypatch):
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in [0, 1, 3, *[300] * 600, 0, 5000]]
    tracemalloc.start()
    try:
        got = neardup.super_minhash(sets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 << 20
    monkeypatch.setattr(neardup, "PART", 1 << 40)
    assert (got == neardup.super_minhash(sets)).all()
