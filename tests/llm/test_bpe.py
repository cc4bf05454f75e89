import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import bpe, queries
from llm.lexicon import Lexicon, compiled

BYTE = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "foo", "Bär", " ", "  ", "   ", "\n", "\n\n", "\r\n", "<|endoftext|>", "<|endof", "’s", "'s", "don't", "12345", "!?",
        "　", "\xa0", "\x1c", "\x1f", "\x85", "​", "﻿", " ", "日本語", "x" * 90, "\t", " y", "é", "é", "İ", "\0", "\x7f",
        "٣", "²", "😀", "👩‍👩‍👧", "�", "ǅ", "ª", "the", " the", " The", "word."]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) + (" " if r.random() < 0.3 else "") for _ in range(r.randrange(0, 200))) for _ in range(n)]


def lexicon_of(tmp_path, words):
    path = tmp_path / "lexicon.bin"
    path.write_bytes(compiled(words))
    return Lexicon(str(path))


def test_transducer_has_its_words_and_shares_suffixes(tmp_path):
    r = random.Random(1)
    words = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 9))) for _ in range(3000)}
    held = [(w, [len(w), *w][: r.randrange(0, 5)]) for w in words]
    lexicon = lexicon_of(tmp_path, held)
    got = [np.frombuffer(x, "<u4").tolist() for x in lexicon.found([w for w, _ in held])]
    assert got == [ids for _, ids in held]
    others = [w + b"a" for w in words if w + b"a" not in words] + [w[:-1] for w in words if w[:-1] not in words] + [b"", b"zz"]
    assert set(lexicon.found(others)) == {None}
    # no two states have the same future: as many states as the trie has distinct right languages
    languages = set()
    for w in words | {b""}:
        for k in range(len(w) + 1):
            languages.add(frozenset(x[k:] for x in words if x.startswith(w[:k])))
    assert len(lexicon.end) - 1 == len(languages)


def test_empty_transducer(tmp_path):
    lexicon = lexicon_of(tmp_path, [])
    assert lexicon.found([b"a", b""]) == [None, None] and lexicon.found([]) == []


def test_file_is_mapped(tmp_path):
    lexicon = lexicon_of(tmp_path, [(b"ab", [1, 2]), (b"b", [3])])
    assert isinstance(lexicon.ids, np.memmap) and not lexicon.ids.flags.writeable
    (tmp_path / "other").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError):
        Lexicon(str(tmp_path / "other"))


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_ids_are_the_librarys(tmp_path, with_lexicon):
    some = [*texts(3, 400), "", " ", "  ", "x" * 30_000, " " * 3000, "é" * 3000, "a  b   c    ", "\n \n  a", "ab" * 20_000, "<|endoftext|>" * 50]
    library = Tokenizer.from_file(BYTE)
    path = None
    if with_lexicon:
        plain = bpe.Encoder(BYTE)
        words = {w for t in texts(9, 200) for w in plain.words(t)}
        path = str(tmp_path / "lexicon.bin")
        (tmp_path / "lexicon.bin").write_bytes(compiled((w.encode(), np.frombuffer(plain.unseen(w), "<u4").tolist()) for w in words))
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(BYTE, path).encode(some)]
    assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert all("".join(bpe.Encoder(BYTE).words(t)) == t for t in some)
    # every character that the own pattern is used on falls into the class that the library sees
    for c in map(chr, range(1, 0x3000)):
        for t in (f"a{c}b 1{c}2", f" {c} {c}{c}\n", f"{c}'s  {c}"):
            if bpe._PLAIN.fullmatch(t):
                assert bpe._WORDS.findall(t) == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def frame(spark):
    rows = [(i * 3 - 7, t, "x", 1) for i, t in enumerate(texts(4, 60))]
    rows += [(500, None, "", 0), (501, "", "", 0), (502, "word " * 20_000, "", 0), (502, "twice", "", 0), (None, "no id", "", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, n int").repartition(4)


def test_documents_round_trip(spark):
    rows, df = frame(spark)
    library = Tokenizer.from_file(BYTE)
    encoded = bpe.encode_documents(df, BYTE)
    got = bpe.decode_documents(encoded, BYTE).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows]
    want = [(i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in want]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(df.where("false"), BYTE).collect() == []


def test_decoding_of_any_ids(spark):
    library = Tokenizer.from_file(BYTE)
    r = random.Random(8)
    some = [[r.randrange(50257) for _ in range(r.randrange(0, 40))] for _ in range(200)]
    got = bpe.decode_documents(spark.createDataFrame(list(enumerate(some)), "doc_id int, ids array<int>"), BYTE).collect()
    assert [x.decoded for x in sorted(got)] == [library.decode(ids, skip_special_tokens=False) for ids in some]
    odd = spark.createDataFrame([(1, None), (2, [64, None, 99_999_999, -1, 65])], "doc_id int, ids array<int>")
    assert [x.decoded for x in sorted(bpe.decode_documents(odd, BYTE).collect())] == [None, library.decode([64, 65])]


def test_counts_and_rare_words(spark):
    rows, df = frame(spark)
    want = {}
    for _, t, *_ in rows:
        for w in bpe.Encoder(BYTE).words(t or ""):
            want[w.encode()] = want.get(w.encode(), 0) + 1
    got = {bytes(r.word): r.n for r in bpe.word_counts(df, BYTE).collect()}
    assert got == {w: n for w, n in want.items() if len(w) <= bpe.LONGEST}


def test_query_against_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(BYTE)
    want = []
    for r in queries.documents(spark, sf_dir).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op12_bpe_transducer(spark, sf_dir).collect())) == sorted(want)
