from __future__ import annotations

import random

from brute import ODD, measures, random_text

from barloom.llm import quality


def test_measures_equal_plain_python(spark):
    rng = random.Random(3)
    texts = [t for t in ODD if len(t or "") < 4000] + [random_text(rng, 6, 6) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, n_words INT")
    got = {r["doc_id"]: r.asDict() for r in quality.measure(docs).collect()}
    for i, t in enumerate(texts):
        want = measures(t)
        assert {k: got[i][k] for k in want} == want, repr(t)


def test_long_text_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000), (1, "word " * 50_000), (None, "a b")], "doc_id BIGINT, text STRING")
    got = sorted(r["n_repeat_words"] for r in quality.measure(docs).collect())
    assert got == [0, 50_000, 50_000]
    assert quality.ledger(quality.measure(docs.limit(0))).count() == 0
    assert [r["n_failed"] for r in quality.ablation(quality.ledger(quality.measure(docs.limit(0))), "v1").collect()] == [0] * 5


def test_policies_and_ablation_follow_the_bits(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven"), (2, "short"), (3, "a b c d e " * 5), (4, "x" * 400)], "doc_id BIGINT, text STRING"
    )
    rows = quality.ledger(quality.measure(docs))
    kept = {r["doc_id"] for r in rows.filter(quality.decide(rows, "v1")).collect()}
    assert kept == {1}
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(rows, "v1").collect()}
    assert found["few_words"] == (2, 1) and found["repeated_windows"] == (1, 1) and found["long_words"] == (1, 0)
    assert quality.mask(quality.RULES) == 63 and list(quality.rules()) == quality.RULES


def test_lines_and_words_that_a_polynomial_hash_confuses(spark):
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = a.translate(str.maketrans("ab", "ba"))
    text = "\n".join([a, other, f"{a} w x y z", f"{other} w x y z"])
    docs = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    row = quality.measure(docs).first().asDict()
    assert {k: row[k] for k in measures(text)} == measures(text) and row["n_dup_lines"] == 0
