"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a ``.model`` file; its scores are used as they
stand. A text gets a leading space if it has any character, and spaces become the marker U+2581. The best
segmentation maximises the sum of scores. A character that no piece covers is encoded as its
UTF-8 bytes (byte fallback), at a score ``UNKNOWN`` below the worst piece. Decoding joins pieces
and bytes, turns markers into spaces and drops the leading one, so every text comes back.

Pieces hold a marker only at their start (longer runs of markers are pieces of markers alone),
so the best segmentation of a text is that of its stretches, each a run of markers and the
characters up to the next one. Distinct stretches are segmented together, all at once for each
place, and the common ones are remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import ship

MARK = "▁".encode()
UNKNOWN = 10.0  # as the library's unigram model has it
MEMO = 400_000
LONGEST = 64
BATCH = 20_000  # stretches segmented together

_STRETCH = re.compile(b"(?:" + MARK + b")*(?:(?!" + MARK + b").)*", re.S)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every id; kinds: 1 normal, 2 unknown, 3 control, 6 byte."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            part = dict(_fields(value))
            out.append((part[1].decode(), struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0], part.get(3, 1)))
    return out


class DoubleArray:
    """A trie of byte strings in two arrays: ``base[s] + byte`` is the next state if ``check`` there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for i, key in enumerate(keys):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][b]
            value[node] = i
        base, check, final, taken = {}, {0: 0}, {}, {0}
        place, single, spread = {0: 0}, 1, 1
        for node in range(len(children)):  # parents come before their children
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:  # into the first gap
                while single in taken or single <= codes[0]:
                    single += 1
                at = single - codes[0]
            else:  # on from the last place that took several
                at = spread
                while any(at + c in taken for c in codes):
                    at += 1
                spread = at
            base[place[node]] = at
            for b in codes:
                child = children[node][b]
                place[child] = at + b
                taken.add(at + b)
                check[at + b], final[at + b] = place[node], value[child]
        size = max(taken) + 257
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        for array, held in ((self.base, base), (self.check, check), (self.value, final)):
            array[list(held)] = list(held.values())
        self.depth = max(map(len, keys))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        there = self.base[state] + byte
        there = np.minimum(there, len(self.check) - 1)
        return np.where((state >= 0) & (self.check[there] == state) & (there > 0), there, -1)


class _Known(dict):
    """Remembered words, and behind them those of the texts at hand."""

    rest: dict[bytes, bytes] = {}

    def __missing__(self, key):
        return self.rest[key]


class Pieces:
    """Encoder and decoder of a model file."""

    def __init__(self, path: str):
        model = read_model(path)
        self.text = [p for p, _, _ in model]
        self.kind = [k for _, _, k in model]
        normal = [i for i, k in enumerate(self.kind) if k == 1]
        self.ids = np.array(normal)
        self.trie = DoubleArray([self.text[i].encode() for i in normal])
        self.score = np.array([model[i][1] for i in normal])
        self.worst = float(self.score.min()) - UNKNOWN
        self.byte_id = {int(_BYTE.fullmatch(self.text[i])[1], 16): i for i, k in enumerate(self.kind) if k == 6}
        self.as_bytes = [
            bytes([int(_BYTE.fullmatch(p)[1], 16)]) if k == 6 else p.encode() if k == 1 else b""
            for p, k in zip(self.text, self.kind, strict=True)
        ]
        self.known: dict[bytes, _Known] = {}

    def segment(self, stretches: list[bytes]) -> list[bytes]:
        """Best ids of each stretch (little-endian 32-bit), all stretches place by place.

        Ties go to the piece that begins first, the longest last piece.
        """
        longest = max(map(len, stretches))
        n = len(stretches)
        data = np.zeros((n, longest + self.trie.depth), np.uint8)
        for i, s in enumerate(stretches):
            data[i, : len(s)] = np.frombuffer(s, np.uint8)
        size = np.fromiter(map(len, stretches), np.int64, n)
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        origin = np.zeros((n, longest + 1), np.int32)
        piece = np.full((n, longest + 1), -1, np.int32)
        starts = (data & 0xC0) != 0x80
        for at in range(longest):
            rows = np.flatnonzero((size > at) & starts[:, at])
            if len(rows) == 0:
                continue
            own = best[rows, at]
            lead = data[rows, at]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(int) + (lead >= 0xF0)
            stop = np.minimum(at + char, size[rows])
            alone = np.zeros(len(rows), bool)  # a piece is this character alone
            state, live, k = np.zeros(len(rows), np.int64), np.arange(len(rows)), at
            while len(live) and k < longest:
                state = self.trie.step(state, data[rows[live], k].astype(np.int64))
                k += 1
                ok = (state >= 0) & (size[rows[live]] >= k)
                live, state = live[ok], state[ok]
                value = self.trie.value[state]
                hit = value >= 0
                who = live[hit]
                alone[who] |= stop[who] == k
                total = own[who] + self.score[value[hit]]
                better = total > best[rows[who], k]
                who, v = who[better], value[hit][better]
                best[rows[who], k], origin[rows[who], k], piece[rows[who], k] = total[better], at, v
            bare = np.flatnonzero(~alone)
            total = own[bare] + self.worst
            better = total > best[rows[bare], stop[bare]]
            who = bare[better]
            best[rows[who], stop[who]], origin[rows[who], stop[who]] = total[better], at
            piece[rows[who], stop[who]] = -1
        out = []
        for i, s in enumerate(stretches):
            ids, at = [], len(s)
            while at > 0:
                p, o = piece[i, at], origin[i, at]
                ids.extend([int(self.ids[p])] if p >= 0 else [self.byte_id[b] for b in reversed(s[o:at])])
                at = int(o)
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def learn(self, words: set[bytes], prefix: bytes) -> dict[bytes, bytes]:
        """A mapping from all ``words`` to the ids of each with ``prefix`` before it."""
        known = self.known.setdefault(prefix, _Known())
        known.rest = {}
        missing = sorted(words - known.keys(), key=len)
        i = 0
        while i < len(missing):
            # words of about one length, and no more cells than a few megabytes
            cells = BATCH * LONGEST // max(LONGEST, len(missing[min(i + BATCH, len(missing)) - 1]))
            part = missing[i : i + max(1, min(BATCH, cells))]
            for w, ids in zip(part, self.segment([prefix + w for w in part]), strict=True):
                (known if len(w) <= LONGEST and len(known) < MEMO else known.rest)[w] = ids
            i += len(part)
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        # where every space stands alone, words are what lies between them
        plain = ["  " not in t and "▁" not in t and not t.startswith(" ") for t in texts]
        split = [
            t.encode().split(b" ") if one else _STRETCH.findall((" " + t).replace(" ", "▁").encode())[:-1]
            for t, one in zip(texts, plain, strict=True)
        ]
        words = self.learn(set().union(*(s for s, one in zip(split, plain, strict=True) if one)), MARK)
        runs = self.learn(set().union(*(s for s, one in zip(split, plain, strict=True) if not one)), b"")
        return [
            b"".join(map((words if one else runs).__getitem__, s)) if t else b""
            for t, s, one in zip(texts, split, plain, strict=True)
        ]

    def decode(self, ids: bytes) -> str:
        """The text of ids; control and unknown ids say nothing."""
        data = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace").replace("▁", " ")
        return text[1:] if text.startswith(" ") else text


_open: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def _grouped(texts: list[str], size: int = 1 << 19) -> Iterator[list[str]]:
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decodes)``: ids as little-endian 32-bit integers, and whether they give the text back.

    A text that itself holds U+2581 comes back with spaces there, as in the original scheme, and
    counts as given back if it equals the text with those replaced. Null text counts as empty,
    without ids. Rows are encoded one by one; no rows give no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces_of(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [x for group in _grouped(texts) for x in codec.encode(group)]
            same = [codec.decode(x) == t.replace("▁", " ") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["doc_id", "ids", "decodes"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decodes boolean")
