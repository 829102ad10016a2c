from __future__ import annotations

import numpy as np
from brute import ODD, held_out
from pyspark.sql import functions as F

from barloom.llm import language, registry


def plain_vector(text: str) -> np.ndarray:
    """Letter by letter, without tables."""
    classes = [0]
    for c in text:
        k = ord(c.lower()[0]) if c.isalpha() else 0
        if k or classes[-1]:
            classes.append(k)
    classes += [0] if classes[-1] else []
    vectors = {k: language.letter_vectors(np.array([k]))[0].astype(np.int64) for k in classes}
    total = np.zeros(language.SIZE)
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        if a or b or c:
            total += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return total


def test_vectors_equal_plain_python():
    texts = [t for t in ODD if t and any(c.isalpha() for c in t) and len(t) < 4000] + ["The quick, brown fox.", "Straße İstanbul 𝒜b", "한국어 문장 하나", "漢字 𠀀𠀁 कखग"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got, letters = language.vectors(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert letters.all()
    for t, v in zip(texts, got):
        assert np.array_equal(v, plain_vector(t)), t


def test_letters_of_all_scripts_have_vectors_of_their_own():
    """Letters that agree modulo small numbers, and two languages that share a script of many letters."""
    points = [ord(c) for c in "azабвαβ"] + list(range(0xAC00, 0xAC00 + 11_172, 37)) + list(range(0x4E00, 0x4E00 + 20_991, 37))
    v = language.letter_vectors(np.array(points)).astype(np.float32)
    close = np.abs(v @ v.T / language.SIZE)
    np.fill_diagonal(close, 0)
    assert close.max() < 0.25 and np.abs(v.mean(axis=0)).max() < 0.2


def test_scripts_of_many_letters(spark):
    rng = np.random.default_rng(5)
    words = {name: ["".join(chr(0xAC00 + 37 * int(k) + shift) for k in rng.integers(0, 300, 4)) for _ in range(80)] for name, shift in (("x", 0), ("y", 37))}
    rows = [(i, " ".join(rng.choice(words[name], 30)), name) for i in range(400) for name in ("xy"[i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    got = language.classified(docs).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.99 * len(got)


def test_texts_without_letters_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(i, t, "en") for i, t in enumerate(["hello there world", None, "", "12 % 3", "\n"])] + [(None, "hallo welt und so", "de"), (9, "zz", None)],
        "doc_id BIGINT, text STRING, lang STRING",
    ).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.classified(docs).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[1]["score"] == 0.0
    assert got[None]["lang_pred"] == "de"
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {0, None} and kept.filter("score <> 'clash'").count() == 0
    assert language.classified(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.classified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark, tables):
    folder = tables.replace("sf0.001", "sf0.01")
    docs = registry.table(spark, folder, "documents").select("doc_id", "lang")
    rows = registry.QUERIES["op10_language_profiles"](spark, folder).join(docs, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
