"""Token counts of whole texts, huge ones in overlapping chunks spliced where both agree.

A text of more than ``CHUNK`` bytes is encoded chunk by chunk, each reaching ``overlap`` bytes
into the next. Both encodings of an overlap list their stable boundaries: a place before ASCII
white space and after a character that is none, where the tokenizer splits whatever surrounds it
(see ``tokens``). At the first place that both list, and after which both count alike up to the
next place they share, the left chunk's tokens end and the right chunk's begin. A chunk that was
cut inside a word or a special string falls into step after it. If an overlap has no such place,
it is doubled, up to the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import ship
from llm.tokens import stretch_counts

CHUNK = 1 << 16
OVERLAP = 1 << 9


def _whole_character(text: bytes, at: int) -> int:
    """The start of the character that holds byte ``at``."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _agreement(left: tuple, right: tuple, after: int) -> int | None:
    """The first place beyond ``after`` that both list and from which they count alike."""
    (ends_l, counts_l), (ends_r, counts_r) = left, right
    common, at_l, at_r = np.intersect1d(ends_l[:-1], ends_r[:-1], assume_unique=True, return_indices=True)
    for i in np.flatnonzero(common > after)[:-1]:
        here_l, here_r = (slice(at[i] + 1, at[i + 1] + 1) for at in (at_l, at_r))
        if counts_l[here_l].sum() == counts_r[here_r].sum():
            return int(common[i])
    return None


def spliced_count(text: bytes, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode`` gives the boundaries and counts of one stretch of bytes."""

    def encoded(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        ends, counts = encode(text[a:b])
        return ends + a, counts

    def upto(at: int) -> int:
        return len(text) if at >= len(text) else _whole_character(text, at)

    total = done = begin = 0
    reach = upto(chunk + overlap)
    now = encoded(begin, reach)
    while reach < len(text):
        start = _whole_character(text, max(done, reach - overlap))
        stop = upto(reach + chunk)
        right = encoded(start, stop)
        meet = _agreement(now, right, done)
        if meet is None:
            overlap *= 2
            reach = upto(reach + overlap)
            now = encoded(begin, reach)
            continue
        total += int(now[1][(now[0] > done) & (now[0] <= meet)].sum())
        begin, reach, now, done = start, stop, right, meet
    return total + int(now[1][now[0] > done].sum())


def token_counts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 512,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row.

    Null text counts as empty, with 0 tokens. Rows with the same or a null doc_id are counted
    one by one; no rows give no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encode(part: bytes):
            return next(stretch_counts(tokenizer, [part]))

        for b in batches:
            texts = [t.encode() if t else b"" for t in b.column(1).to_pylist()]
            short = stretch_counts(tokenizer, (t for t in texts if len(t) <= chunk))
            counts = [
                int(next(short)[1].sum()) if len(t) <= chunk else spliced_count(t, encode, chunk, overlap)
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
