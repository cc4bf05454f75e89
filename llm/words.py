"""Word and shingle hashes of batches of texts, whole texts at a time, in numpy.

Words are runs of bytes other than space and tab to carriage return, after A-Z became
a-z. A word's hash is a polynomial over its bytes (prefix sums, so all words of a batch
come out of a few passes), a shingle's hash combines five word hashes in order; both are
64 bits. Equal hashes are taken as equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = (32, 9, 10, 11, 12, 13)
BASE = 0x9E3779B97F4A7C15
SLAB = 1 << 18  # bytes hashed at a time, unless one text is longer

_rng = np.random.default_rng(20240607)
EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = EXACT.copy()  # A-Z hash as a-z
LOWER[65:91] = LOWER[97:123]
_graph = np.arange(256)
_alnum = (_graph >= 128) | ((_graph >= 48) & (_graph < 58)) | ((_graph | 32) >= 97) & ((_graph | 32) < 123)
# classes of bytes: 0 separates, and a run of one other class is a word
WORDS = np.ones(256, np.int8)  # all but white space
WORDS[list(SPACES)] = 0
ALNUM = _alnum.astype(np.int8)  # letters and digits, and all that is not ASCII
PUNCT = np.where(WORDS == 0, 0, np.where(_alnum, 1, 2)).astype(np.int8)  # those, and runs of signs
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= SLAB * 2:
            _powers[base] = have
    return have[:n]


def word_hashes(
    data: np.ndarray, classes: np.ndarray = WORDS, values: np.ndarray = LOWER, prefix: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in bytes ``data``, which must end in a space.

    With ``prefix``, a second column of hashes has the first so many bytes of each word.
    """
    kind = classes[data]
    turn = np.concatenate(([True], kind[1:] != kind[:-1]))
    start = np.flatnonzero(turn & (kind != 0))
    end = np.flatnonzero(turn[1:] & (kind[:-1] != 0)) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(len(data), BASE), out=sums[1:])
    inverse = pow(BASE, -1, 2**64)
    back = _power(len(data), inverse)[start]
    whole = mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))
    if not prefix:
        return whole, start
    stop = np.minimum(end, start + prefix)
    return np.stack((whole, mix(~((sums[stop] - sums[start]) * back))), axis=1), start


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of the whole sequence if there are fewer."""
    k = min(n, len(words))
    if k == 0:
        return words
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i]
    return mix(out)


def texts_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def words_by_text(column: pa.Array, classes: np.ndarray = WORDS, values: np.ndarray = LOWER, prefix: int = 0):
    """For each text in order, the hashes of its words."""
    data, offsets = texts_bytes(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, "right")) - 1)
        parts = data[offsets[i] : offsets[j]]
        # one space after each text keeps words apart
        padded = np.insert(parts, offsets[i + 1 : j + 1] - offsets[i], 32)
        hashes, start = word_hashes(padded, classes, values, prefix)
        first = np.searchsorted(start, offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1))
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield hashes[a:b]
        i = j


def shingle_sets(column: pa.Array, n: int = 5):
    """For each text in order, its distinct shingle hashes, ascending."""
    for words in words_by_text(column):
        yield distinct(shingles(words, n))
