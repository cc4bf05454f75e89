"""Token ids by the tokenizers library, each distinct stretch of text encoded once.

Both tokenizers used here split a text before they merge anything, and they always split
where a white-space character follows one that is none:

* one drops white space and never looks across it (NFC does not compose across ASCII
  white space either), so its words can be encoded apart;
* the byte-level one lets a piece begin with one space but never has white space after
  another character, and only looks ahead at the end of white space. So a text may be cut
  before ASCII white space that follows a character that is not white space.

Special strings contain no white space and stay inside a stretch. A stretch is split into
its pieces as the tokenizer's file says, and the library's model merges each piece; both
steps are remembered in a memo of bounded size, first come, as common stretches come early.
A stretch of printable ASCII is split here, any other one by the library itself. Nothing is
truncated or padded.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import chain

import numpy as np

MEMO = 500_000  # stretches remembered in a Python worker, and as many pieces
LONGEST = 64  # bytes of a stretch worth remembering
WORD_BYTES = 1 << 22  # texts whose words are encoded together

_ASCII_PAIR = re.compile(rb"[\t-\r ]{2}")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t-\r])")
_PLAIN = re.compile(r" ?[!-~]+")
_LATIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

# fixed values: the pre-tokenizers' patterns on printable ASCII, the first with letters of Latin-1,
# which have one lower case and no other composed form
_WORD_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")
_SPACE_PIECE = "\u0120"  # a leading space, as byte-level pieces write it

def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LETTER = {b: c for c, b in byte_letters().items()}
_open: dict[tuple[str, str], Memo] = {}


class _Known(dict):
    """Remembered stretches, and behind them those of the texts at hand."""

    rest: dict[bytes, object] = {}

    def __missing__(self, key):
        return self.rest[key]


class Memo:
    """Encodings of stretches; ``of_ids`` turns ids into what is kept, which adds up by ``+``."""

    def __init__(self, path: str, lower: bool, of_ids, empty):
        self.limit = MEMO
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = {t[0] for t in self.special}
        self.lower, self.of_ids, self.empty = lower, of_ids, empty
        self.known, self.pieces = _Known(), {}

    def piece(self, text: str):
        value = self.of_ids([t.id for t in self.merge(text)])
        if len(self.pieces) < self.limit and len(text) <= LONGEST:
            self.pieces[text] = value
        return value

    def encode(self, stretch: str):
        plain = _LATIN if self.lower else _PLAIN
        if not plain.fullmatch(stretch) or (
            not self.marks.isdisjoint(stretch) and any(t in stretch for t in self.special)
        ):
            ids = self.library.encode(stretch, add_special_tokens=False).ids
            return self.of_ids(ids)
        if self.lower:
            parts = _WORD_PIECES.findall(stretch.lower())
            if not stretch.isascii():  # bytes are merged, written as letters
                parts = ["".join(map(_LETTER.__getitem__, p.encode())) for p in parts]
        else:
            parts = [p.replace(" ", _SPACE_PIECE) for p in _BYTE_PIECES.findall(stretch)]
        value = self.empty
        for p in parts:
            found = self.pieces.get(p)
            value = value + (self.piece(p) if found is None else found)
        return value

    def learn(self, stretches: set[bytes], prefix: str = "") -> dict[bytes, object]:
        """A mapping that has all ``stretches``; each is encoded with ``prefix`` before it."""
        self.known.rest = {}
        for w in stretches - self.known.keys():
            into = self.known if len(self.known) < self.limit and len(w) <= LONGEST else self.known.rest
            into[w] = self.encode(prefix + w.decode("utf-8", "replace"))
        return self.known


def _memo(path: str, kind: str, *how) -> Memo:
    if (path, kind) not in _open:
        _open[path, kind] = Memo(path, *how)
    return _open[path, kind]


def _grouped(texts, size: int = 1 << 20):
    """Lists of consecutive texts of about ``size`` bytes."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _four_bytes(ids: list[int]) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def word_ids(path: str, texts, memo_size: int = MEMO, group_bytes: int = WORD_BYTES):
    """For each UTF-8 text, its ids as little-endian unsigned 32-bit integers (bytes).

    For tokenizers that drop white space. A memo of fewer words and smaller groups of texts take
    less memory and more time, and change no result.
    """
    memo = _memo(path, f"ids {memo_size}", True, _four_bytes, b"")
    memo.limit = memo_size
    for group in _grouped(texts, group_bytes):
        words = [t.split() for t in group]
        known = memo.learn(set(chain.from_iterable(words)))
        # all before any is given out: the memo may learn other texts in between
        yield from [b"".join(map(known.__getitem__, w)) for w in words]


def _stretches(text: bytes) -> list[bytes] | None:
    """Parts between single spaces, if every space may begin a stretch."""
    if _ASCII_PAIR.search(text) or text[:1].isspace() or text[-1:].isspace():
        return None
    if not text.isascii() and _ODD_SPACE.search(text.decode("utf-8", "replace")):
        return None
    return text.split(b" ")


def stretch_counts(path: str, texts):
    """For each UTF-8 text, the ends of its stretches (byte offsets) and their token counts.

    For byte-level tokenizers. The ends are boundaries that hold in any context.
    """
    first, later = _memo(path, "first", False, len, 0), _memo(path, "later", False, len, 0)
    for group in _grouped(texts):
        split = [_stretches(t) if t and b"\x1c" not in t else None for t in group]
        whole = [
            None if s is not None else [p.encode() for p in _STABLE.split(t.decode("utf-8", "replace"))]
            for s, t in zip(split, group, strict=True)
        ]
        known = later.learn(set(chain.from_iterable(s[1:] for s in split if s)), " ")
        begun = first.learn({s[0] for s in split if s} | set(chain.from_iterable(w for w in whole if w)))
        found = []
        for s, w in zip(split, whole, strict=True):
            if s is not None:
                lengths = np.fromiter(map(len, s), np.int64, len(s))
                lengths[1:] += 1
                counts = np.fromiter(chain([begun[s[0]]], map(known.__getitem__, s[1:])), np.int64, len(s))
            else:
                w = [x for x in w if x]
                lengths = np.fromiter(map(len, w), np.int64, len(w))
                counts = np.fromiter(map(begun.__getitem__, w), np.int64, len(w))
            found.append((np.cumsum(lengths), counts))
        # all before any is given out: the memo may learn other texts in between
        yield from found
