"""Whole texts as UTF-8 bytes in numpy arrays: words, their hashes, windows of words.

The functions work on chunks of about 1 MB of text, taken straight from Arrow buffers, without a Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
U64 = np.uint64


@dataclass
class Chunk:
    """Some rows of a batch: their texts as one byte array, text i at data[offsets[i]:offsets[i + 1]] (null: empty)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """Cut batches into chunks of about `limit` bytes of text (in lower case if `lower`); a longer text is a chunk of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
        column = pc.utf8_lower(column) if lower else column
        buffers = column.buffers()
        at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        first = 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(at, at[first] + limit, side="right")) - 1, first + 1)
            yield Chunk(batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers that look random."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


#: Odd bases of the two independent hashes.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers of `base`. The table for ordinary chunks is kept; that of a longer text goes with it."""
    return _kept_powers(base)[:n] if n <= CHUNK_BYTES + 1 else _new_powers(n, base)


@lru_cache(maxsize=4)
def _kept_powers(base: int) -> np.ndarray:
    return _new_powers(CHUNK_BYTES + 1, base)


def _new_powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U64, out=out)


@lru_cache(maxsize=8)
def byte_values(lower: bool, which: int) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z get those of a-z if `lower`."""
    values = constants(256, 77 + which)
    if lower:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=8)
def is_blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(BLANKS)] = True
    return out


@lru_cache(maxsize=8)
def is_not_letter() -> np.ndarray:
    """True for bytes that are neither a-z, A-Z nor part of a character beyond ASCII."""
    out = np.ones(256, bool)
    out[65:91] = out[97:123] = out[128:] = False
    return out


@dataclass
class Words:
    """Words of a chunk in order; those of text i are first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> Words:
    """Longest runs of bytes that are not in `apart`, a table of 256 flags; no word spans two texts."""
    inside = ~apart[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    before = edges[edges > 0] - 1
    end[before] = inside[before]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


#: Parts of more bytes are digested. Shorter ones have polynomial hashes, whose structured collisions begin at 512 bytes.
LONG = 64


class Rolling:
    """Hashes of any parts of a byte array; equal bytes have equal hashes in every process.

    Short parts come from one table of prefix sums, parts of more than LONG bytes from a BLAKE2b digest of 128 bits: a polynomial
    modulo 2^64 has equal values for long strings that alternate by certain rules, whatever its base. `which` selects one of two hash
    functions; for parts beyond LONG these are the halves of the digest.
    """

    def __init__(self, data: np.ndarray, lower: bool, which: int = 0) -> None:
        n, base = len(data), BASES[which]
        self.sums = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.multiply(byte_values(lower, which)[data], _powers(n, base), out=self.sums[1:])
            np.cumsum(self.sums[1:], out=self.sums[1:])
        self.back = _powers(n + 1, pow(base, -1, 1 << 64))
        self.data, self.lower, self.which = data, lower, which

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            out[long] = digests(self.data, starts[long], ends[long], self.lower)[:, self.which]
        return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """BLAKE2b digests of parts, as two 64-bit numbers each; A-Z count as a-z if `lower`."""
    raw = data.tobytes()
    raw = raw.lower() if lower else raw
    found = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(found, "<u8").reshape(-1, 2) if found else np.empty((0, 2), U64)


def free_name(wanted: str, *frames: object) -> str:
    """A name for a helper column that none of the tables has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words and where those of each text begin; a text with fewer words has none."""
    n = len(hashes)
    sizes = np.maximum(np.diff(first) - (width - 1), 0)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    if begin[-1] == 0:
        return np.empty(0, U64), begin
    factors = constants(width, 5)
    total = np.zeros(n - width + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += hashes[k : n - width + 1 + k] * factors[k]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = first[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
    return mix(total[place]), begin


def code_points(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a character."""
    return (data & 0xC0) != 0x80


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of flags in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
