from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from barloom.llm import prefix_trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, conv INT, i INT, p INT, depth INT"


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    new = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(new[c]) == len(path))
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), sum(len(p) == len(path) + 1 for p in below), len(childless), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


def got(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    found = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table))).collect()
    return sorted((tuple(r) for r in found), key=lambda r: r[:2])


def test_equal_to_plain_trie(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(95, 230), 1000, 1003, -5, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 9])):
            rows.append((c, t * 2 if t else rng.choice([None, 0]), rng.choice(["user", "bot"]), rng.choice(["a", "bb", "é", None, ""])))
    rows += [(None, 1, "user", "a"), (5, 1, None, None)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 40)
    rows = [(100 + k, t, "user", f"t{t}") for k in range(40) for t in range(3)]  # one group of copies
    rows += [(c, t, "user", f"t{t}") for c in (300, 555) for t in range(300)]  # deep, over many range partitions
    assert got(spark, rows) == plain(rows)


def test_roles_and_texts_are_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "1", ":c"), (4, 0, "", "1:c")]
    assert got(spark, rows) == plain(rows)


def test_turnless_and_empty(spark):
    assert got(spark, []) == []
    rows = [(c, 0, "user", "x") for c in range(1, 30)]  # no host: whoever takes over a turn or more is turnless
    assert got(spark, rows) == plain(rows)


def test_repeated_turns(spark):
    rows = [(7, 1, "user", "x")] * 5 + [(7, None, "user", "y")] * 2 + [(8, 1, "user", "x")] * 9
    assert got(spark, rows) == plain(rows)
