from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from brute import BLANK, ODD, random_text, words

from barloom.llm import texts


def batch(values):
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(range(len(values)))], ["text", "k"])


def test_chunks_hold_every_row_once():
    rng = random.Random(1)
    values = [*ODD, *(random_text(rng) for _ in range(50))]
    for limit in (1, 100, 1 << 20):
        got = []
        for c in texts.chunks(iter([batch(values), batch([])]), "text", limit):
            for i in range(len(c.offsets) - 1):
                got.append((bytes(c.data[c.offsets[i] : c.offsets[i + 1]]).decode(), c.column("k")[i].as_py()))
        assert got == [(v or "", k) for k, v in enumerate(values)]


def test_words_hashes_and_windows_equal_plain_ones():
    rng = random.Random(2)
    values = [*ODD, *(random_text(rng) for _ in range(60))]
    seen: dict[str, int] = {}
    grams: dict[tuple, int] = {}
    for c in texts.chunks(iter([batch(values)]), "text", 500):
        found = texts.words(c.data, c.offsets, texts.is_blank())
        hashes = texts.Rolling(c.data, lower=False).parts(found.starts, found.ends)
        window, begin = texts.windows(hashes, found.first, 3)
        for i, k in enumerate(c.column("k").to_pylist()):
            mine = [bytes(c.data[s:e]).decode() for s, e in zip(found.starts[found.first[i] : found.first[i + 1]], found.ends[found.first[i] : found.first[i + 1]])]
            assert mine == words(values[k]), BLANK
            for w, h in zip(mine, hashes[found.first[i] : found.first[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
            own = window[begin[i] : begin[i + 1]].tolist()
            assert len(own) == max(len(mine) - 2, 0)
            for p, h in enumerate(own):
                assert grams.setdefault(tuple(mine[p : p + 3]), h) == h
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def test_lower_case_and_two_hashes():
    data = np.frombuffer(b"Word wORD w", np.uint8)
    a, b = (texts.Rolling(data, lower=True, which=k).parts(np.array([0, 5, 10]), np.array([4, 9, 11])) for k in (0, 1))
    assert a[0] == a[1] != a[2] and b[0] == b[1] and (a != b).all()


def test_long_texts_leave_no_tables_behind():
    short, long = (np.frombuffer(b"one two " * k + b"end", np.uint8) for k in (3, 1 << 19))
    at = lambda d: texts.Rolling(d, lower=True).parts(np.array([0, 4, len(d) - 3, len(d)]), np.array([3, 7, len(d), len(d)]))
    want = at(short).tolist()
    tracemalloc.start()
    try:
        got = at(long).tolist()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert got == want and held < 1 << 20
