"""Byte-level BPE encoding and decoding with a transducer of the frequent words.

Words are the pieces into which the tokenizer splits a text before it merges anything. Texts of
Latin letters and common signs are split by the tokenizer's pattern with these letters written out,
all others by the library. All words of the corpus are counted; those that are at least one in
``RARE`` of all words, no more than ``RARE`` by that, are encoded on the driver and compiled into a
minimal acyclic transducer (``lexicon``). Its file lies in the shared folder, Spark hands every
executor a copy, and Python workers map it. In a word that it lacks, pairs are merged by rank,
leftmost first; long words from a heap over linked symbols, so that time stays near linear.

Special strings inside a text become their own ids, as the library does by default. Nothing is
truncated or padded. Decoding joins the tokens' bytes; what is not UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from llm.lexicon import Lexicon, compiled
from llm.shared import ship, stored
from llm.token_files import new_folder
from llm.tokens import byte_letters

RARE = 250_000
LONGEST = 64  # bytes of a word of the lexicon
GROUP_BYTES = 1 << 22  # texts encoded together
ROWS = 1 << 10  # texts taken out of an Arrow batch at a time
FLUSH = 1 << 17  # distinct words counted before they are handed on
MEMO_BYTES = 3 << 23  # of merged words that a Python worker remembers
PAIR = 24  # bits of an id in a pair
SHORT = 40  # symbols of a word merged without a heap

# fixed values: the split pattern of byte-level BPE, on ASCII and Latin letters
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
# all other characters that it may be used on: neither letters nor numbers
_PLAIN = re.compile(f"[ -~\t\n\r{_LETTERS}\xa1\xab\xbb\xbf\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]*")


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file; any other kind of file is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], said["pre_tokenizer"] or {}
        added = said["added_tokens"]
        plain = (
            model["type"] == "BPE" and said["normalizer"] is None and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and (said["decoder"] or {}).get("type") == "ByteLevel"
        )
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.path = path
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in added}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.as_bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.as_bytes[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.special.items():
            self.as_bytes[i] = token.encode()
        of_bytes = {self.as_bytes[i]: i for i in model["vocab"].values()}
        self.single = [of_bytes.get(bytes([b]), -1) for b in range(256)]
        # a pair of ids as one number finds its rank; the rank finds the id made
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = (model["vocab"][t] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[a << PAIR | b] = len(self.made)
            self.made.append(of_bytes[self.as_bytes[a] + self.as_bytes[b]])
        none = len(self.made)
        self.whole = min(self.single) >= 0
        self.pairs = [self.ranks.get(a << PAIR | b, none) for a in self.single for b in self.single] if self.whole else []
        # longer strings first, as the library finds them
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece after all merges, lowest rank first, then leftmost."""
        ids = list(map(self.single.__getitem__, piece))
        if not self.whole:
            ids = [i for i in ids if i >= 0]
        if len(ids) > SHORT:
            return self._merged_by_heap(ids)
        rank_of, made, none = self.ranks.get, self.made, len(self.made)
        if self.whole:
            pairs = self.pairs
            ranks = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        else:
            ranks = [rank_of(a << PAIR | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            new = ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << PAIR | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << PAIR | new, none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same in near linear time: a heap of pairs over linked symbols."""
        rank_of, made, n = self.ranks.get, self.made, len(ids)
        keys = [a << PAIR | b for a, b in zip(ids, ids[1:])]
        heap = [(rank_of(k), i, k) for i, k in enumerate(keys) if k in self.ranks]
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i, key = heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << PAIR | ids[j] != key:
                continue  # one of the two has been merged since
            new = ids[i] = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := rank_of(key := new << PAIR | ids[k])) is not None:
                    heappush(heap, (found, i, key))
            if (h := before[i]) >= 0 and (found := rank_of(key := ids[h] << PAIR | new)) is not None:
                heappush(heap, (found, h, key))
        return [i for i in ids if i >= 0]


class Encoder:
    def __init__(self, path: str, lexicon: str | None = None):
        self.vocabulary = _vocabulary(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.memo: dict[str, bytes] = {}
        self.room = MEMO_BYTES

    def words(self, text: str) -> list[str]:
        return words_of(text, self.vocabulary)

    def unseen(self, word: str) -> bytes:
        """Ids of a word, as little-endian 32-bit integers, by merging."""
        if word in self.vocabulary.special:
            return np.array([self.vocabulary.special[word]], "<u4").tobytes()
        raw = word.encode("utf-8", "replace")
        ids = array("I", self.vocabulary.merged(raw)).tobytes()
        cost = len(raw) + len(ids) + 160  # with the objects around them
        if len(raw) <= LONGEST and cost <= self.room:
            self.memo[word] = ids
            self.room -= cost
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        for group in grouped(texts):
            split = [self.words(t) for t in group]
            known: dict[str, bytes] = {}
            rest = list(set().union(*split))
            if self.lexicon:
                found = self.lexicon.found([w.encode("utf-8", "replace") for w in rest])
                known = {w: ids for w, ids in zip(rest, found) if ids is not None}
                rest = [w for w, ids in zip(rest, found) if ids is None]
            memo = self.memo.get
            for w in rest:
                known[w] = memo(w) or self.unseen(w)
            yield from [b"".join(map(known.__getitem__, words)) for words in split]


def words_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """The words of a text; together they are the text. Special strings are words."""
    if any(s in text for s in vocabulary.special):
        out, at = [], 0
        for m in vocabulary.cut.finditer(text):
            out += [*split_plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + split_plain(text[at:])
    return split_plain(text)


_library = []


def split_plain(text: str) -> list[str]:
    """The words of a text without special strings."""
    if _PLAIN.fullmatch(text):
        return _WORDS.findall(text)
    if not _library:
        from tokenizers.pre_tokenizers import ByteLevel

        _library.append(ByteLevel(add_prefix_space=False).pre_tokenize_str)
    return [text[a:b] for _, (a, b) in _library[0](text)]


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``GROUP_BYTES``."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= GROUP_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts, words of up to ``LONGEST`` bytes; null texts have none.

    Tasks count ahead in bounded tables, so that a frequent word leaves a task a few times only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def given() -> pa.RecordBatch:
            held = [(raw, n) for w, n in seen.items() if len(raw := w.encode("utf-8", "replace")) <= LONGEST]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())], ["word", "n"]
            )

        vocabulary = _vocabulary(tokenizer)
        for b in batches:
            for part in slices(b):
                for t in part.column(0).to_pylist():
                    seen.update(words_of(t or "", vocabulary))
                if len(seen) > FLUSH:
                    yield given()
                    seen.clear()
        yield given()

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", rare: int = RARE) -> str:
    """The place of a lexicon file of the words that are at least one in ``rare`` of all words."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs, tokenizer, text))
    total = counts.agg(F.sum("n")).head()[0] or 0
    # no more than ``rare`` words can be this frequent
    words = [bytes(r["word"]) for r in counts.where(F.col("n") * rare >= total).select("word").collect()]
    encoder = Encoder(tokenizer)
    held = [(w, np.frombuffer(encoder.unseen(w.decode("utf-8", "replace")), "<u4").tolist()) for w in words]
    return _written(spark, compiled(held))


def _written(spark: SparkSession, content: bytes) -> str:
    """A new file in the shared folder, known to Spark as a file for executors; its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark)}/{name}")
    out = place.getFileSystem(conf).create(place)
    try:
        out.write(content)
    finally:
        out.close()
    spark.sparkContext.addFile(place.getFileSystem(conf).makeQualified(place).toString())
    return name


_open: dict[tuple[str, str], Encoder] = {}


def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    if (tokenizer, lexicon) not in _open:
        _open.clear()  # one lexicon at a time
        _open[tokenizer, lexicon] = Encoder(tokenizer, SparkFiles.get(lexicon))
    return _open[tokenizer, lexicon]


def encode_documents(
    docs: DataFrame, tokenizer: str, lexicon: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, ids)`` of every row: the ids as array<int>, as the library gives them.

    ``lexicon`` is a name that :func:`compile_lexicon` gave; without one it is compiled from
    ``docs``. Null text counts as empty, without ids. Rows that share a doc_id or have none are
    encoded one by one; no rows give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    lexicon = lexicon or compile_lexicon(docs, tokenizer, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = _encoder(tokenizer, lexicon)
            for part in slices(b):
                ids = list(encoder.encode([t or "" for t in part.column(1).to_pylist()]))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"]
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(tokenizer: str) -> Vocabulary:
    if tokenizer not in _vocabularies:
        _vocabularies[tokenizer] = Vocabulary(tokenizer)
    return _vocabularies[tokenizer]


def decode_documents(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``, special tokens included; null for null.

    Null ids inside an array and ids that the file does not know say nothing.
    """
    ship(encoded.sparkSession)
    names = [*encoded.columns, "decoded"]
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _vocabulary(tokenizer).as_bytes
        size = len(table)

        def known(one: list[int | None] | None) -> str | None:
            if one is None:
                return None
            return b"".join(table[i] for i in one if i is not None and 0 <= i < size).decode("utf-8", "replace")

        def decoded(column: pa.ListArray) -> list[str | None]:
            flat = column.flatten()
            if column.null_count or flat.null_count or (len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= size)):
                return [known(one) for one in column.to_pylist()]
            each, ends = flat.to_numpy(), column.offsets.to_numpy()
            raw = (b"".join(map(table.__getitem__, each[i:k].tolist())) for i, k in zip(ends - ends[0], ends[1:] - ends[0]))
            return [r.decode("utf-8", "replace") for r in raw]

        for b in batches:
            for part in slices(b):
                texts = decoded(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    if "decoded" in encoded.columns:
        raise ValueError("a column is already called decoded")
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
