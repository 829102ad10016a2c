from __future__ import annotations

import random

from pyspark.sql import functions as F

from barloom.llm import chat

PARTS = "conv_id BIGINT, turn INT, role STRING, parts ARRAY<STRUCT<type: STRING, text: STRING, ref: STRING, units: DOUBLE>>"


def test_any_text_comes_back(spark):
    rng = random.Random(37)
    rows = [(c, t, rng.choice(["user", "assistant", "a<b", None]), "".join(rng.choice("\\<>()/turn \n>é") for _ in range(rng.randrange(30)))) for c in range(30) for t in range(rng.randrange(5))]
    rows += [(50, 0, "assistant", None), (50, 0, "assistant", None), (None, 1, "user", "</turn>\n<turn assistant>\n"), (51, 0, "user", "long " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id BIGINT, turn INT, role STRING, text STRING").withColumn("formatted", F.lit("clash"))
    done = chat.formatted(frame.withColumn("parts", chat.text_part(F.col("text"))))
    spans = F.transform(chat.loss_spans(F.col("formatted")), lambda s: chat.unescaped(F.substr("formatted", s["start"] + 1, s["length"])))
    got = {r["conv"]: r for r in done.select("conv", chat.parsed(F.col("formatted")).alias("turns"), spans.alias("loss")).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert sorted((x["role"], x["content"]) for x in got[c]["turns"]) == sorted((r, t.replace("\\", "\\\\").replace("<", "\\(").replace(">", "\\)")) for _, r, t in turns)
        assert sorted(got[c]["loss"]) == sorted(t for _, r, t in turns if r == "assistant")


def test_parts_become_placeholders_with_attachments(spark):
    rows = [(1, 0, "user", [("text", "see <this>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 2.5), ("text", "now two", None, None), ("scan", None, None, 1.0)]),
            (1, 1, "assistant", None), (2, 0, "user", [])]
    got = {r["conv"]: r for r in chat.formatted(spark.createDataFrame(rows, PARTS)).collect()}
    assert got[1]["formatted"] == "<turn user>\nsee \\(this\\)<image 1><audio 2>now two<scan 3></turn>\n<turn assistant>\n</turn>\n"
    assert [(a["turn"], a["attachment"]["place"], a["attachment"]["kind"], a["attachment"]["ref"], a["attachment"]["tokens"]) for a in got[1]["attachments"]] == [
        (0, 1, "image", "a.png", 576), (0, 2, "audio", "b.wav", 2 + 25 * 3), (0, 3, "scan", None, 8 + 512)]
    assert got[1]["n_tokens"] == 2 + 2 + 576 + 77 + 520 and got[2]["n_tokens"] == 0
    assert chat.formatted(spark.createDataFrame([], PARTS)).count() == 0


def test_no_python_in_the_plan(spark, tables):
    from barloom.llm import registry

    plan = registry.QUERIES["op8_content_parts"](spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
