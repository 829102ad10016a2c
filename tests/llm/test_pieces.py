from __future__ import annotations

import random
from pathlib import Path

import pytest
import sentencepiece
import sentencepiece.sentencepiece_model_pb2 as model_pb2
from brute import ODD, random_text, viterbi

from barloom.llm import pieces

RAW = Path(pieces.MODEL).read_bytes()


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(RAW)


def texts() -> list[str]:
    rng = random.Random(19)
    return [t or "" for t in ODD] + [random_text(rng) for _ in range(20)] + ["the then with  two   spaces ", "Ünïcode ñandú 東京"]


def test_scores_equal_a_plain_viterbi(codec):
    v = codec.vocabulary
    normal = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == pieces.NORMAL}
    for t in texts():
        if len(t) > 1000:
            continue
        ids = codec.encode([t])[0]
        fallback = sum(1 for c in (pieces.MARK + t.replace(" ", pieces.MARK) if t else "") if c not in normal)
        score = sum(v.scores[i] for i in ids if v.kinds[i] == pieces.NORMAL) + fallback * codec.lattice.miss
        want = viterbi(pieces.MARK + t.replace(" ", pieces.MARK), normal, codec.lattice.miss) if t else 0
        assert abs(score - want) <= 1e-6 * abs(want), t


def test_ids_equal_the_best_path_of_the_public_library(codec):
    proto = model_pb2.ModelProto()
    proto.ParseFromString(RAW)
    proto.trainer_spec.model_type = 1  # unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in ["the then with", "Released under the License", "naïve 東京 x", "a\nb"]:
        assert codec.encode([t])[0].tolist() == library.nbest_encode_as_ids(t, 8)[0], t


def test_decoding_gives_the_text_back(codec):
    all_texts = texts()
    for t, ids in zip(all_texts, codec.encode(all_texts)):
        assert codec.decode(ids) == t
    assert codec.decode(codec.encode(["a▁b"])[0]) == "a b"


def test_the_double_array_holds_exactly_its_words():
    rng = random.Random(23)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))): k for k in range(200)}
    trie = pieces.DoubleArray(words)

    def find(w: str) -> int:
        state = 0
        for c in w:
            t = trie.base[state] + trie.codes.get(c, 0)
            if c not in trie.codes or trie.check[t] != state:
                return -1
            state = t
        return int(trie.value[state])

    assert all(find(w) == k for w, k in words.items())
    assert all(find("".join(rng.choice("abcéd") for _ in range(4))) in (-1, *words.values()) for _ in range(200))
    assert find("zz") == -1 and find("") == -1


def test_memory_of_parts_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    fresh = pieces.Codec(RAW)
    rng = random.Random(29)
    for _ in range(5):
        t = [random_text(rng) for _ in range(3)]
        assert [a.tolist() for a in fresh.encode(t)] == [a.tolist() for a in codec.encode(t)]


def test_operator(spark):
    docs = spark.createDataFrame([(1, "the text", 3), (1, "the text", 3), (None, None, 4), (2, "", 5)], "doc_id BIGINT, text STRING, ids INT")
    rows = pieces.encoded(docs).collect()
    assert all(r["round_trip"] for r in rows) and sorted(len(r["ids"]) for r in rows)[:2] == [0, 0]
    assert rows[0]["ids"] == rows[1]["ids"] and pieces.digests(docs.limit(0)).count() == 0
