"""The pipeline against plain Python stages, and the queries that have SQL against it."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from brute import leaks, line_dedup, near_duplicates

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry_module  # noqa: E402
import corpus_pipeline  # noqa: E402
from barloom.llm import language, pieces, registry  # noqa: E402
from compare import TABLES, compare  # noqa: E402

registry.load()


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name, tables):
    message = compare(spark, con, name, tables)
    assert ": ok" in message and "TYPES" not in message, message


def test_all_queries_are_registered():
    names = set(entry_module.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def corpus() -> tuple[list, list]:
    rng = random.Random(47)
    items = [(k, " ".join(f"bench{k}x{j}" for j in range(15))) for k in range(3)]
    sentence = lambda n: " ".join(rng.choice(["the", "tree", "stands", "near", "water", "and", "grows", "slowly", "every", "year"]) + str(rng.randrange(30)) for _ in range(n))
    shared = [sentence(12) for _ in range(3)]
    texts = []
    for i in range(24):
        lines = [sentence(20), *rng.sample(shared, rng.randrange(3)), sentence(15)]
        if i % 6 == 0:
            lines.append(items[i % 3][1])
        texts.append("\n".join(lines))
    texts += [texts[1], texts[2] + " more", None, "", "12 34 %%"]
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], items


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs, items = corpus()
    folder = str(tmp_path)
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    stay = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    stay = [(i, t) for i, t, _, _ in line_dedup(stay)]
    groups = near_duplicates(stay, 80)
    stay = [(i, t) for i, t in stay if groups[i][1] == i]
    bad = {i for i, _ in leaks(stay, items)}
    stay = {i: t for i, t in stay if i not in bad}
    assert bad and set(got) == set(stay)
    assert all(got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and got[i]["round_trip"] for i, t in stay.items())
    codec = pieces.Codec(Path(pieces.MODEL).read_bytes())
    assert all(codec.decode(np.frombuffer(got[i]["piece_ids"], "<i4")) == t for i, t in stay.items())
    assert all(hashlib.sha256(r["piece_ids"]).hexdigest() == r["ids_sha256"] and len(r["piece_ids"]) == 4 * r["n_pieces"] for r in got.values())


def test_stages_keep_the_columns_and_bear_empty_tables(spark, tables):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, tables)
        assert done.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == docs.columns
    assert language.MIN_SCORE < 0.1
