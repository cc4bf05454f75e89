import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import packing, token_counts, token_files
from llm.tokens import stretch_counts, word_ids

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "foo", "Bär", " ", "  ", "\n", "\n\n", "<|endoftext|>", "’s", "'s", "don't", "12345", "!?", "　", "\xa0", "\x1c",
        "日本語", "x" * 90, "\t", " y", "é", "İ", "\0"]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) + (" " if r.random() < 0.4 else "") for _ in range(r.randrange(0, 300))) for _ in range(n)]


def ids_of(path, some):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_word_ids_are_the_librarys():
    some = [*texts(1, 120), "", " "]
    some += [f"a{c}b {c}{c.upper()}'s {c}1 ~{c}" for c in map(chr, range(0x21, 0x250))]
    some += ["ÀÉÎÕÜ straße ŒUVRE naïve x̂é É' l’été", "<|endoftext|>é <| é|> <|startoftext|>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in word_ids(WORD, (t.encode() for t in some))]
    assert got == ids_of(WORD, some)


@pytest.mark.parametrize("chunk, overlap", [(40, 8), (100, 30), (64, 2), (1 << 16, 512)])
def test_spliced_counts_are_the_librarys(chunk, overlap):
    def encode(part):
        return next(stretch_counts(BYTE, [part]))

    some = [*texts(2, 60), "x" * 5000, " " * 3000, "é" * 3000, "a b" * 2000, "<|endoftext|>" * 200]
    got = [token_counts.spliced_count(t.encode(), encode, chunk, overlap) for t in some]
    assert got == list(map(len, ids_of(BYTE, some)))


def rows_of(spark):
    some = texts(3, 80)
    rows = [(i * 3 - 7, t, i, 1) for i, t in enumerate(some)]
    rows += [(5000, None, 0, 0), (5001, "", 0, 0), (5002, "word " * 30_000, 0, 0), (5002, "twice", 0, 0), (None, "no id", 0, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start long, length int").repartition(5)


def test_token_counts(spark):
    rows, df = rows_of(spark)
    got = token_counts.token_counts(df, BYTE, chunk=2000, overlap=50).collect()
    want = [(i, len((t or "").encode()), len(x), len(x) > 512) for (i, t, *_), x in zip(rows, ids_of(BYTE, [r[1] or "" for r in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(df.where("false"), BYTE).collect() == []


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows, df = rows_of(spark)
    packed = packing.harmonic_pack(packing.document_pieces(df, WORD, with_ids=True))
    got = packed.collect()
    want = sorted((str(i), np.array(x + [1], "<u4").tobytes()) for (i, *_), x in zip(rows, ids_of(WORD, [r[1] or "" for r in rows])))
    docs, at = [], {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        assert len(r.ids) == 4 * r.length
        at.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    for (i, n), parts in at.items():
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        docs.append((i, b"".join(p.ids for p in parts)))
        assert len(docs[-1][1]) == 4 * n
    assert sorted(docs) == want
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append(r)
    for parts in used.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    whole = {r.sequence_id: (r.ids, r.n_tokens) for r in packing.sequences(packed).collect()}
    assert set(whole) == set(used)
    for k, (ids, n) in whole.items():
        assert np.array(ids[:n], "<u4").tobytes() == b"".join(p.ids for p in used[k])
        assert len(ids) == (n if n & (n - 1) == 0 else packing.CAPACITY)
    assert packing.harmonic_pack(packing.document_pieces(df.where("false"), WORD)).collect() == []


def test_packed_documents_have_their_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    monkeypatch.setattr(packing, "IDS_BYTES", 3000)
    rows, df = rows_of(spark)
    got = packing.packed_documents(df, WORD).collect()
    whole = {r.sequence_id: r.sequence for r in got if r.sequence is not None}
    assert set(whole) == {r.sequence_id for r in got} and len(whole) == sum(r.offset == 0 for r in got)
    docs, filled = {}, dict.fromkeys(whole, 0)
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        part = np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
        docs[str(r.doc_id), r.doc_tokens] = docs.get((str(r.doc_id), r.doc_tokens), b"") + part
        filled[r.sequence_id] += r.length
    want = [(str(i), np.array(x + [1], "<u4").tobytes()) for (i, *_), x in zip(rows, ids_of(WORD, [r[1] or "" for r in rows]))]
    assert sorted((i, ids) for (i, _), ids in docs.items()) == sorted(want)
    for k, n in filled.items():
        assert len(whole[k]) == (n if n & (n - 1) == 0 else packing.CAPACITY) and not any(whole[k][n:])
    assert packing.packed_documents(df.where("false"), WORD, with_sequences=False).collect() == []


def test_repeated_rows_fill_no_sequence_over_capacity(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    long, short = "word " * 2047, "a b c"  # one takes a whole sequence, the others share one
    rows = [(7, long)] * 300 + [(8, short)] * 6000 + [(None, short)] * 3000 + [(i, "x " * (i % 900)) for i in range(100, 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.packed_documents(df, WORD, with_sequences=False).toPandas()
    assert len(got[got.start == 0]) == len(rows)
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= packing.CAPACITY
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (ends == ordered.offset).all()
    assert len(filled) <= 1.02 * filled.sum() / packing.CAPACITY + 10
    groups = packing._fill(packing.document_pieces(df, WORD).withColumn("piece", F.monotonically_increasing_id()), {64: 90, 2: 7, 1: 7}, 2048)
    assert groups.where("class = 64").groupBy("group").count().agg(F.max("count")).head()[0] < 200


def test_pieces_of_both_widths():
    length = np.array([2, 3, 1])
    column = pa.array([np.array([1, 2], "<u2").tobytes(), np.array([3, 70_000, 5], "<u4").tobytes(), np.array([6], "<u2").tobytes()])
    assert packing._values(column, length).tolist() == [1, 2, 3, 70_000, 5, 6]
    assert packing._values(column.slice(1, 2), length[1:]).tolist() == [3, 70_000, 5, 6]


def test_padding_is_little():
    r = random.Random(1)
    waste = total = 0
    for _ in range(3000):
        n = int(r.lognormvariate(6.5, 1)) + 1
        for x in packing.piece_lengths(n):
            j = packing.CAPACITY // x
            waste += packing.CAPACITY / j - x if j < packing.CLASSES else 1
        total += n
    assert waste / total < 0.01


def test_token_files(spark, tmp_path):
    rows, df = rows_of(spark)
    shards = token_files.write_token_files(df, WORD, str(tmp_path / "files"), shard_rows=20)
    got = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read_token_files(shards).collect()))
    order = sorted(zip(rows, ids_of(WORD, [r[1] or "" for r in rows])), key=lambda x: (-1 if x[0][0] is None else x[0][0], x[0][1] or ""))
    start, want = 0, []
    for (i, *_), x in order:
        want.append((start, -1 if i is None else i, np.array(x + [1], "<u4").tobytes()))
        start += len(x) + 1
    assert got == want
    tasks = token_files.read_token_files(shards).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 0.7 * shards.count() > 1
    first = sorted(shards.collect(), key=lambda r: r.shard)[0]
    three = token_files.read_records(first.path, [2, 0])
    assert [k for k, _ in three] == [want[2][1], want[0][1]] and three[0][1].tobytes() == want[2][2]
    assert not [p for p in (tmp_path / "files").iterdir() if not p.name.endswith((".rec", ".rec.idx"))]
    assert token_files.read_token_files(token_files.write_token_files(df.where("false"), WORD, str(tmp_path / "none"))).collect() == []


def test_damage_is_seen():
    data = token_files.record(9, np.array([1, 70_000], "<u4").tobytes())
    assert token_files.parse(data)[1].tolist() == [1, 70_000]
    for i in range(len(data)):
        with pytest.raises(ValueError):
            token_files.parse(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
