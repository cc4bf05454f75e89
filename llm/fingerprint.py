"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes marks chunk ends. It is normalised: before ``NORMAL`` bytes a
harder mask must match, after it an easier one, so chunk sizes keep near ``NORMAL`` between
``LEAST`` and ``MOST``. Ends depend on nearby bytes only, so an insertion shifts chunks without
changing those further on. A fingerprint is the set of chunk digests, each with its length;
likeness is containment: the length of the chunks that two sets share over the length of the
smaller set, so a passage taken over whole counts fully.

Documents are compared with the next one in descending doc_id: rows are dealt into ranges of
doc_id, sorted there, and the first row of each range is also given to the range before it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import ship
from llm.words import BASE, EXACT, _power, distinct, mix

NORMAL, LEAST, MOST = 64, 16, 256
HARD, EASY = 0xFF << 24, 0x0F << 24  # 8 and 4 bits of 32 around the 6 of NORMAL
WINDOW = 32
SLAB = 1 << 18
RANGE_ROWS = 4096  # documents of a range

GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)
GEAR[0] = 0  # so that padding leaves no trace


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash that ends at each byte, its window doubled from 1 to 32 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def _slab(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer((b"\0" * WINDOW).join(texts) + b"\0", np.uint8)
    h = gear_hash(data)
    hard = np.flatnonzero((h & np.uint32(HARD)) == 0).tolist()
    easy = np.flatnonzero((h & np.uint32(EASY)) == 0).tolist()
    begins, ends, sizes, at = [], [], [], 0
    for t in texts:
        s, e, n = at, at + len(t), 0
        while s < e:
            end = min(e, s + MOST)
            i = bisect_left(hard, s + LEAST - 1)
            if i < len(hard) and hard[i] < s + NORMAL - 1:
                end = min(end, hard[i] + 1)
            else:
                j = bisect_left(easy, s + NORMAL - 1)
                if j < len(easy):
                    end = min(end, easy[j] + 1)
            begins.append(s)
            ends.append(end)
            s, n = end, n + 1
        sizes.append(n)
        at = e + WINDOW
    begins, ends = np.array(begins, np.int64), np.array(ends, np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(EXACT[data] * _power(len(data), BASE), out=sums[1:])
    value = (sums[ends] - sums[begins]) * _power(len(data), pow(BASE, -1, 2**64))[begins]
    length = (ends - begins).astype(np.uint64)
    digest = (mix(value + length) & np.uint64(~0xFFFF & (1 << 64) - 1)) | length
    first = 0
    for n in sizes:
        yield distinct(digest[first : first + n])
        first += n


def fingerprints(texts) -> Iterator[np.ndarray]:
    """For each UTF-8 text, its chunks ascending: a digest of 48 bits, then the length in 16."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= SLAB:
            yield from _slab(held)
            held, total = [], 0
    if held:
        yield from _slab(held)


def as_text(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Shared length over that of the smaller set; two empty sets are alike, one is not like another."""
    size = lambda x: int((x & np.uint64(0xFFFF)).sum())
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]
    return size(both) / min(size(a), size(b))


def _compared(rows: list[tuple], following: tuple) -> list[tuple]:
    """Result rows of ``rows`` (doc_id, text), each against the next, the last against ``following``."""
    edited = []
    for (_, t), (_, after) in zip(rows, [*rows[1:], following], strict=True):
        k = len(t) // 3
        edited.append((t[: len(t) - k] + after[:k]).encode())
    own = list(fingerprints(t.encode() for _, t in [*rows, following]))
    out = []
    for i, ((key, t), e, f) in enumerate(zip(rows, edited, fingerprints(edited), strict=True)):
        out.append(
            (key, len(t), hashlib.sha256(e).hexdigest(), as_text(own[i]), as_text(f),
             containment(own[i], f), containment(own[i], own[i + 1]))
        )
    return out


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third (whole code points, rounded down) replaced by the
    beginning, as long, of the next document. Null text counts as empty. Null ids come after
    all others; rows that repeat an id follow one another in the order of their texts. A single
    row is followed by itself; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select(F.col("doc_id").cast("double").alias("at"), "doc_id")
    n = max(1, -(-ids.count() // range_rows))
    inner = sorted(set(ids.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    deal = Bucketizer(splits=[float("-inf"), *(inner or [0.0]), float("inf")], inputCol="at", outputCol="b", handleInvalid="keep")

    def dealt(df: DataFrame) -> DataFrame:
        # a range of its own for null ids, below all others
        placed = deal.transform(df.withColumn("at", F.col("doc_id").cast("double")))
        return placed.withColumn("b", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("b").cast("int")))

    top = sorted(dealt(ids).groupBy("b").agg(F.max("doc_id")).collect(), reverse=True)  # one row for each range
    if not top:
        return spark.createDataFrame([], SCHEMA)
    firsts = spark.createDataFrame(
        [(b, first, before[0]) for (b, first), before in zip(top, [top[-1], *top[:-1]], strict=True)],
        "b int, first long, guest_of int",
    )
    both = (
        dealt(rows).join(F.broadcast(firsts), "b")
        .select(
            "doc_id", "text",
            F.explode(
                F.when(
                    F.col("doc_id").eqNullSafe(F.col("first")),
                    F.array(F.struct("b", F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("b"), F.lit(1).alias("guest"))),
                ).otherwise(F.array(F.struct("b", F.lit(0).alias("guest"))))
            ).alias("p"),
        )
        .select(F.col("p.b").alias("b"), F.col("p.guest").alias("guest"), "doc_id", "text")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(top))
    placed = both.repartition(parts, "b").sortWithinPartitions(
        F.desc("b"), "guest", F.desc_nulls_last("doc_id"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        stream = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        held, size, range_ = [], 0, None
        for b, guest, key, t in stream:
            if b != range_:
                held, size, range_ = [], 0, b
            if held and (guest or size >= SLAB * 4):
                yield batch(_compared(held, (key, t)))
                held, size = [], 0
            if not guest:
                held.append((key, t))
                size += len(t)

    return placed.mapInArrow(run, SCHEMA)
