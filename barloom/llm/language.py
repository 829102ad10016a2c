"""Language ID by hyperdimensional profiles.

Every letter of every script has a random vector of +-1 of its own. A letter n-gram is the product of its letters' vectors, each rotated by its place; a
document is the sum of its n-grams' vectors; a language's prototype is the sum of the unit vectors of its training documents.
The language whose prototype has the largest cosine with the document wins (ties: the first in order of name).

Texts with no letter, null and empty texts are `und` with score 0, as is everything where nothing was learned. Repeated rows
are predicted alike. An empty table gives an empty result. Extra columns pass through `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import texts
from barloom.llm.registry import query, table

SIZE = 1024
GRAM = 3
LETTER_BITS = 21  # of a code point
UNKNOWN = "und"
TRAIN_PER_LANGUAGE = 8000  # expected bound of the training documents of one language
MIN_SCORE = 0.05
GRAMS = 4096  # n-grams whose vectors are laid out at once


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The lower-case letter of each code point below 65,536, 0 for what is no letter."""
    return np.array([letter_code(c) for c in range(1 << 16)], np.uint32)


def letter_code(c: int) -> int:
    return ord(chr(c).lower()[0]) if chr(c).isalpha() else 0


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A random vector of +-1 for each letter, drawn from a hash of its code point; 0 is the gap between words."""
    draws = texts.mix(letters.astype(np.uint64)[:, None] ^ texts.constants(SIZE // 64, 11)[None, :])
    bits = np.unpackbits(np.ascontiguousarray(draws).view(np.uint8), axis=1)
    return 2 * bits.astype(np.int8) - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors of n-grams, given as numbers with LETTER_BITS bits for each letter."""
    letters = np.stack([codes >> LETTER_BITS * k & ((1 << LETTER_BITS) - 1) for k in range(GRAM)])
    known, at = np.unique(letters, return_inverse=True)
    table_, at, out = letter_vectors(known), at.reshape(letters.shape), np.ones((len(codes), SIZE), np.int8)
    for k in range(GRAM):
        out *= np.roll(table_, k, axis=1)[at[k]]
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letters = letter_codes()[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letters[points == c] = letter_code(int(c))
    return letters


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document vector of each text of a chunk, and whether it has a letter."""
    points = np.concatenate([[0], np.cumsum(texts.code_points(data))])[offsets]
    letters = _letters(data)
    codes, counts, sizes = [], [], []
    for a, b in zip(points[:-1], points[1:]):
        c = np.concatenate([[0], letters[a:b], [0]]).astype(np.int64)
        c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]  # one gap, however wide
        grams = sum(c[k : len(c) - GRAM + 1 + k] << LETTER_BITS * (GRAM - 1 - k) for k in range(GRAM)) if c.any() else c[:0]
        found, n = np.unique(grams[grams > 0], return_counts=True)
        codes.append(found)
        counts.append(n)
        sizes.append(len(found))
    owner, n = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(counts)
    all_codes, at = np.unique(np.concatenate(codes), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, n, at = owner[order], n[order], at[order]
    out = np.zeros((len(sizes), SIZE), np.float32)
    for k in range(0, len(all_codes), GRAMS):
        part = slice(*np.searchsorted(at, [k, k + GRAMS]))
        block = np.zeros((len(sizes), len(all_codes[k : k + GRAMS])), np.float32)
        block[owner[part], at[part] - k] = n[part]
        out += block @ gram_vectors(all_codes[k : k + GRAMS]).astype(np.float32)
    return out, np.array(sizes) > 0


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass
class Profiles:
    """Names of the languages in order, one unit vector each."""

    names: list[str]
    matrix: np.ndarray


def learn(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Profiles:
    """Prototypes from rows with a language; above `per_language` rows a language is sampled by a hash of the text.

    The driver receives SIZE numbers for each language.
    """
    known = docs.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles([], np.zeros((0, SIZE), np.float32))
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(int(1e6 * min(1, per_language / n))))])
    taken = known.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for chunk in texts.chunks(batches, "text"):
            found = unit(vectors(chunk.data, chunk.offsets)[0]).astype(np.float64)
            langs = np.array(chunk.column("lang").to_pylist(), object)
            for name in set(langs):
                total[name] = total.get(name, 0) + found[langs == name].sum(axis=0)
        for name, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * SIZE), pa.array(range(SIZE), pa.int32()), pa.array(x)], ["lang", "k", "x"])

    rows = taken.mapInArrow(add_up, "lang STRING, k INT, x DOUBLE").groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in rows})
    matrix = np.zeros((len(names), SIZE))
    for r in rows:
        matrix[names.index(r["lang"]), r["k"]] = r["x"]
    return Profiles(names, unit(matrix).astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, *, text_column: str = "text") -> DataFrame:
    """The rows with `lang_pred` and `score`, the cosine cut off below 0; memory is bounded by about 1 MB of text or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, text_column):
            found, letters = vectors(chunk.data, chunk.offsets)
            if profiles.names:
                cosine = unit(found) @ profiles.matrix.T
                best = cosine.argmax(axis=1)
                score = np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                names = [profiles.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            else:
                score, names = np.zeros(len(found)), [UNKNOWN] * len(found)
            rest = [chunk.rows.column(i) for i in range(chunk.rows.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score)], [*chunk.rows.schema.names, "lang_pred", "score"])

    fields = docs.drop("lang_pred", "score")
    return fields.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields.schema)}, lang_pred STRING, score DOUBLE")


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


def classified(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all; a null id is learned from."""
    profiles = learn(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, profiles)


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a language, all columns as they came; texts without letters or unlike every prototype are rejected."""
    clash = {c: f"_{c}_in" for c in ("lang_pred", "score") if c in docs.columns}
    rows = classified(docs.withColumnsRenamed(clash)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return rows.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


@query("op10_language_profiles")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    rows = predict(docs.select("doc_id", "text"), profiles)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
