"""A minimal acyclic transducer from words (byte strings) to token ids, in one file that is mapped.

The automaton is built from sorted words, suffixes shared as soon as they are complete (Daciuk et
al. 2000). An arc carries how many words come before those behind it, so that the outputs along a
word add up to its number; the number finds the word's ids in a table. The file holds flat arrays
only: arcs sorted by state and byte, and the table. Readers map it and copy nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

MAGIC = 0x4C455831
# arrays of the file, in order: arcs (state * 256 + byte), their targets and outputs; whether a state
# ends a word; where a word's ids begin; the ids
KINDS = ("<i8", "<i4", "<i4", "u1", "<i8", "<u4")


def _automaton(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool], int]:
    """Arcs (byte, target) and ends of the states, and the start, for sorted distinct words."""
    arcs: list[list[tuple[int, int]]] = []
    ends: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]  # states of the last word, still open

    def close(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            out, end = path.pop()
            key = (end, *out)
            if key not in known:
                known[key] = len(arcs)
                arcs.append(out)
                ends.append(end)
            path[-1][0].append((last[len(path) - 1], known[key]))

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same, last)
        path.extend(([], False) for _ in word[same:])
        path[-1] = (path[-1][0], True)
        last = word
    close(0, last)
    arcs.append(path[0][0])
    ends.append(path[0][1])
    return arcs, ends, len(arcs) - 1


def compiled(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file's content for words and their ids; words must be distinct."""
    held = sorted(words)
    arcs, ends, start = _automaton([w for w, _ in held])
    behind = [0] * len(arcs)  # words from a state on; targets come before their sources
    outputs = []
    for state, out in enumerate(arcs):
        total = int(ends[state])
        outputs.append([])
        for _, target in out:
            outputs[-1].append(total)
            total += behind[target]
        behind[state] = total
    # the start becomes state 0
    number = [s + 1 for s in range(len(arcs))]
    number[start] = 0
    flat = sorted(
        (number[s] << 8 | byte, number[target], output)
        for s, out in enumerate(arcs) for (byte, target), output in zip(out, outputs[s], strict=True)
    )
    end = np.zeros(len(arcs) + 1, np.uint8)
    end[number] = ends
    lengths = [len(ids) for _, ids in held]
    arrays = [
        [a for a, _, _ in flat], [t for _, t, _ in flat], [o for _, _, o in flat], end,
        np.concatenate(([0], np.cumsum(lengths))), [i for _, ids in held for i in ids],
    ]
    packed = [np.asarray(a).astype(kind) for a, kind in zip(arrays, KINDS, strict=True)]
    head = np.array([MAGIC, *(len(a) for a in packed)], "<i8").tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in packed)


class Lexicon:
    """A mapped file of :func:`compiled`."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        head = data[: 8 * (1 + len(KINDS))].view("<i8")
        if head[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at, arrays = 8 * len(head), []
        for kind, n in zip(KINDS, head[1:].tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            arrays.append(data[at : at + size].view(kind))
            at += size + -size % 8
        self.arc, self.target, self.output, self.end, self.first, self.ids = arrays

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon has none; all words step by step together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        while len(live):
            key = state[live] << 8 | data[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.arc, key), max(len(self.arc) - 1, 0))
            found = self.arc[at] == key if len(self.arc) else np.zeros(len(live), bool)
            state[live[~found]] = -1
            live, at = live[found], at[found]
            state[live] = self.target[at]
            total[live] += self.output[at]
            depth += 1
            live = live[size[live] > depth]
        known = state >= 0
        known[known] = self.end[state[known]] > 0
        return np.where(known, total, -1)

    def found(self, words: list[bytes]) -> list[bytes | None]:
        """The ids (little-endian 32-bit) of each word, ``None`` where the lexicon has none."""
        number = self.numbers(words)
        hit = np.flatnonzero(number >= 0)
        out: list[bytes | None] = [None] * len(words)
        if len(hit):
            first, stop = 4 * self.first[number[hit]], 4 * self.first[number[hit] + 1]
            raw = memoryview(self.ids).cast("B")
            for i, a, b in zip(hit.tolist(), first.tolist(), stop.tolist()):
                out[i] = bytes(raw[a:b])
        return out
