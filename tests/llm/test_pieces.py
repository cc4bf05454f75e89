import random

import numpy as np
import public_tokenizers
import pytest

from llm import pieces as pc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return pc.Pieces(MODEL)


def plain_viterbi(codec, stretch):
    """Best score of a stretch, trying every piece everywhere."""
    score = {codec.text[i].encode(): s for i, s in zip(codec.ids, codec.score)}
    best = [0.0] + [-np.inf] * len(stretch)
    for a in range(len(stretch)):
        if stretch[a] & 0xC0 == 0x80:
            continue
        for b in range(a + 1, min(len(stretch), a + 48) + 1):
            if stretch[a:b] in score:
                best[b] = max(best[b], best[a] + score[stretch[a:b]])
        end = a + 1
        while end < len(stretch) and stretch[end] & 0xC0 == 0x80:
            end += 1
        if stretch[a:end] not in score:
            best[end] = max(best[end], best[a] + codec.worst)
    return best[-1]


def score_of(codec, ids, stretch):
    total, at, i = 0.0, 0, 0
    while i < len(ids):
        if codec.kind[ids[i]] == 6:
            end = at + 1
            while end < len(stretch) and stretch[end] & 0xC0 == 0x80:
                end += 1
            assert [codec.byte_id[b] for b in stretch[at:end]] == ids[i : i + end - at]
            total, i, at = total + codec.worst, i + end - at, end
        else:
            total += codec.score[np.searchsorted(codec.ids, ids[i])]
            at += len(codec.text[ids[i]].encode())
            i += 1
    assert at == len(stretch)
    return total


def test_best_segmentation(codec):
    r = random.Random(2)
    bits = ["the", "ing", "a", "é", "日", "😀", "zx", "▁", "1", "Ab", "\n", "."]
    words = [("▁" * r.randrange(1, 4) + "".join(r.choice(bits) for _ in range(r.randrange(0, 9)))).encode() for _ in range(300)]
    for w, ids in zip(words, codec.segment(words)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert score_of(codec, ids, w) == plain_viterbi(codec, w)


def test_trie_finds_all_pieces(codec):
    for k in range(0, len(codec.ids), 97):
        state = np.zeros(1, np.int64)
        for b in codec.text[codec.ids[k]].encode():
            state = codec.trie.step(state, np.array([b]))
        assert codec.trie.value[state[0]] == k
    assert codec.trie.step(np.zeros(1, np.int64), np.array([255]))[0] == -1


def test_round_trip(spark):
    rows = [(1, "Hello  wörld \n\t x"), (2, " lead and trail "), (3, ""), (4, None), (5, "   "), (6, "日本語 😀 \x00"), (1, "again"),
            (7, "word " * 20_000), (8, "y" * 5_000), (9, "x▁y"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = pc.encode_texts(df, MODEL).collect()
    assert len(got) == len(rows) and all(r.decodes for r in got)
    assert {len(r.ids) for r in got if r.doc_id in (3, 4)} == {0}
    assert pc.encode_texts(df.where("false"), MODEL).collect() == []
