"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text gets a marker before its first character and one for each space; it is cut where a marker follows something else, which
no piece crosses. Each cut part is encoded once per task (a bounded memory of parts) by `Lattice`: all parts of a batch walk
the double array together, one character a step, and a best-score pass over the positions picks the pieces. A character
that no piece covers costs the lowest score less a penalty and becomes its UTF-8 bytes. Decoding turns bytes and markers
back; a text that itself holds the marker character comes back with spaces there, and `round_trip` says so row by row.

The vocabulary file is a parameter (`model`); its scores are taken as log scores. Null and empty texts have no pieces and decode
to an empty text. Repeated rows are encoded alike. An empty table gives an empty result. Only id and text are carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.registry import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # kinds of pieces that encoding uses
PENALTY = 10.0
MEMORY = 400_000  # parts remembered by a task, at about 200 bytes
LONGEST_PART = 256  # longer parts are encoded, but not remembered


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces in order of id, with log scores and kinds."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def load(raw: bytes) -> Vocabulary:
        """Read a model file: field 1 of the message repeats (1: piece, 2: score, 3: kind)."""
        rows = [dict(_fields(value)) for number, value in _fields(raw) if number == 1]
        return Vocabulary(
            [bytes(r[1]).decode() for r in rows], np.array([np.frombuffer(r.get(2, b"\0\0\0\0"), "<f4")[0] for r in rows], np.float64),
            np.array([r.get(3, NORMAL) for r in rows]),
        )


class DoubleArray:
    """A trie as two arrays: the child of state s by character code c is t = base[s] + c if check[t] == s.

    `value[t]` is the piece that ends in state t, -1 for none. Codes are ranks of the characters that occur, from 1.
    """

    def __init__(self, words: dict[str, int]) -> None:
        letters = sorted({c for w in words for c in w})
        self.codes = {c: k + 1 for k, c in enumerate(letters)}
        size = 4 * (sum(map(len, words)) + len(letters) + 2)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        children: dict[str, list[str]] = {}
        for w in words:
            for k in range(len(w)):
                children.setdefault(w[:k], []).append(w[k])
        free = np.ones(size, bool)
        free[0] = False
        self.check[0] = 0
        lowest = 1
        pending = [("", 0)]
        while pending:
            prefix, state = pending.pop()
            self.value[state] = words.get(prefix, -1)
            kids = sorted(self.codes[c] for c in set(children.get(prefix, ())))
            if not kids:
                continue
            while not free[lowest]:
                lowest += 1
            base = max(lowest - kids[0], 0)
            offsets = np.array(kids)
            while not free[base + offsets].all():
                base += 1 if len(kids) < 8 else 7
            self.base[state] = base
            free[base + offsets] = False
            self.check[base + offsets] = state
            names = {self.codes[c]: c for c in set(children[prefix])}
            pending += [(prefix + names[k], base + k) for k in kids]
        last = int(np.flatnonzero(~free)[-1]) + len(letters) + 2
        self.base, self.check, self.value = self.base[:last].copy(), self.check[:last].copy(), self.value[:last].copy()
        self.depth = max(map(len, words), default=0)


@dataclass
class Lattice:
    """Best segmentations of many short parts at once."""

    vocabulary: Vocabulary
    trie: DoubleArray = field(init=False)

    def __post_init__(self) -> None:
        v = self.vocabulary
        normal = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == NORMAL}
        self.trie = DoubleArray(normal)
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.bytes = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.spells = int((v.kinds == BYTE).sum()) == 256
        used = v.scores[v.kinds == NORMAL]
        self.miss = float(used.min() if len(used) else 0.0) - PENALTY
        self.table = np.zeros(0x110000, np.int32)
        for c, k in self.trie.codes.items():
            self.table[ord(c)] = k

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Piece ids of each part; ties go to the longer last piece."""
        if not parts:
            return []
        sizes = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        codes = self.table[points]
        start = np.concatenate([[0], np.cumsum(sizes)])
        stop = np.repeat(start[1:], sizes)
        n = len(points)
        trie = self.trie
        begins, ends, ids = [], [], []
        place, state = np.arange(n), np.zeros(n, np.int64)
        for depth in range(trie.depth):
            inside = place + depth < stop[place]
            place, state = place[inside], state[inside]
            code = codes[place + depth]
            child = trie.base[state] + code
            good = (code > 0) & (trie.check[np.minimum(child, len(trie.check) - 1)] == state) & (child < len(trie.check))
            place, state = place[good], child[good]
            hit = trie.value[state] >= 0
            begins.append(place[hit])
            ends.append(place[hit] + depth + 1)
            ids.append(trie.value[state[hit]])
            if not len(place):
                break
        begin, end, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, ends, ids))
        single = np.zeros(n, bool)
        single[begin[end - begin == 1]] = True
        bare = np.flatnonzero(~single)
        begin, end = np.concatenate([begin, bare]), np.concatenate([end, bare + 1])
        piece = np.concatenate([piece, np.full(len(bare), -1)])
        score = np.where(piece >= 0, self.vocabulary.scores[np.maximum(piece, 0)], self.miss)
        within = np.arange(n) - np.repeat(start[:-1], sizes)
        # edges in order of their end within the part, so that one numpy step settles that position of all parts
        step = within[end - 1] + 1
        order = np.lexsort((begin, end, step))
        begin, end, piece, score, step = begin[order], end[order], piece[order], score[order], step[order]
        owner = np.repeat(np.arange(len(parts)), sizes)
        node = lambda at, part: at + part  # noqa: E731  each part has one node more than characters
        best = np.zeros(n + len(parts))
        how = np.full(n + len(parts), -1)
        cuts = np.searchsorted(step, np.arange(1, sizes.max() + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            part = owner[begin[a:b]]
            total = best[node(begin[a:b], part)] + score[a:b]
            target = node(end[a:b], part)
            first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            top = np.maximum.reduceat(total, first)
            groups = np.diff(np.append(first, b - a))
            win = np.flatnonzero(total == np.repeat(top, groups))
            win = win[np.append(True, target[win][1:] != target[win][:-1])]  # the earliest start among equals
            best[target[first]] = top
            how[target[win]] = a + win
        # walk all paths back together, then put their edges in order
        part, at = np.arange(len(parts)), start[1:].copy()
        who, edges = [], []
        while len(part):
            edge = how[node(at, part)]
            who.append(part)
            edges.append(edge)
            at = begin[edge]
            going = at > start[part]
            part, at = part[going], at[going]
        owner, edge = np.concatenate(who), np.concatenate(edges)
        order = np.lexsort((begin[edge], owner))
        owner, edge = owner[order], edge[order]
        ids, sizes = self._spelled(piece[edge], points[begin[edge]])
        ends = np.cumsum(sizes)
        last = np.searchsorted(owner, np.arange(len(parts)), side="right") - 1
        cut = np.concatenate([[0], ends[last]])
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _spelled(self, piece: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with each -1 replaced by the byte pieces of its character, and how many ids each entry became."""
        bare = piece < 0
        sizes = np.where(bare & self.spells, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        begin = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), self.unknown, np.int32)
        out[begin[~bare]] = piece[~bare]
        if self.spells and bare.any():
            raw = np.frombuffer(point[bare].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            size = sizes[bare]
            out[np.repeat(begin[bare] - (np.cumsum(size) - size), size) + np.arange(len(raw))] = self.bytes[raw]
        return out, sizes


#: A run of markers with what follows up to the next marker, or what stands before the first one.
_PARTS = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Whole texts to ids and back, with a memory of parts. A line break, which no piece holds, also ends a part."""

    def __init__(self, raw: bytes) -> None:
        self.vocabulary = Vocabulary.load(raw)
        self.lattice = Lattice(self.vocabulary)
        apart = [c for c in "\n\t" if c not in self.lattice.trie.codes]
        self.parts = re.compile(rf"[{''.join(apart)}]|{MARK}+[^{MARK}{''.join(apart)}]*|[^{MARK}{''.join(apart)}]+") if apart else _PARTS
        self.memory: dict[str, bytes] = {}
        v = self.vocabulary
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b"" for p, k in zip(v.pieces, v.kinds)
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.memory.get, c)) for c in cut]
        new = list({p for c, f in zip(cut, found) for p, ids in zip(c, f) if ids is None})
        fresh: dict[str, bytes] = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            fresh |= {p: ids.tobytes() for p, ids in zip(part, self.lattice.encode(part))}
        if len(self.memory) + len(new) > MEMORY:
            self.memory = {}
        self.memory |= {p: ids for p, ids in fresh.items() if len(p) <= LONGEST_PART} if len(fresh) <= MEMORY else {}
        for f, c in zip(found, cut):
            for k in [k for k, ids in enumerate(f) if ids is None]:
                f[k] = fresh[c[k]]
        return [np.frombuffer(b"".join(f), np.int32) for f in found]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes and markers back; the first marker is the one that encoding put there."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def encoded(docs: DataFrame, model: str = MODEL, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, ids (piece ids), decoded (the text from the ids), round_trip (whether that is the text)."""
    raw = Path(model).read_bytes()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, texts, ids, decoded in coded(batches, raw):
            flags = [t == d for t, d in zip(texts, decoded)]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([first, lists, pa.array(decoded, pa.string()), pa.array(flags)], ["id", "ids", "decoded", "round_trip"])

    fields = f"id {source.schema['id'].dataType.simpleString()}, ids ARRAY<INT>, decoded STRING, round_trip BOOLEAN"
    return source.mapInArrow(run, fields).withColumnRenamed("id", id_column)


def coded(batches: Iterator[pa.RecordBatch], raw: bytes) -> Iterator[tuple[pa.Array, list[str], list[np.ndarray], list[str]]]:
    """Ids of rows, texts, piece ids and decoded texts, 64 rows at a time."""
    codec = Codec(raw)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = codec.encode(texts)
            yield part.column("id"), texts, ids, [codec.decode(i) for i in ids]


def digests(docs: DataFrame, model: str = MODEL, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_sha256 (little-endian 32-bit ids), decoded_sha256, round_trip.

    `with_ids` adds piece_ids, the ids themselves as little-endian 32-bit numbers (empty for null and empty texts).
    """
    raw = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Vocabulary.load(raw).kinds
        for first, texts, ids, decoded in coded(batches, raw):
            packed = [i.astype("<i4").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    first, pa.array([len(i) for i in ids], pa.int64()), pa.array([int((kinds[i] == BYTE).sum()) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array([t == d for t, d in zip(texts, decoded)]), *([pa.array(packed, pa.binary())] if with_ids else []),
                ],
                ["id", "n_pieces", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip", *(["piece_ids"] if with_ids else [])],
            )

    fields = "id BIGINT, n_pieces BIGINT, n_bytes BIGINT, ids_sha256 STRING, decoded_sha256 STRING, round_trip BOOLEAN" + ", piece_ids BINARY" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, fields).withColumnRenamed("id", "doc_id")


@query("op2_unigram_pieces")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every whole document, and whether decoding gives the text back."""
    return digests(table(spark, folder, "documents"))
