"""Vector codes: every part of a vector becomes the index of its nearest codebook entry.

Components are integers, floor(256 x), and all arithmetic is exact: the dot products of parts
and entries come from ``limbs``, squared distances are put together in int64, and the first least
one is taken. A task reduces its batches to a count and component sums for each entry; only these,
as many as the codebook has numbers, are shuffled and reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from llm.limbs import exact_products, largest
from llm.shared import cut, ship, stored
from llm.vectors import SCALE, first_width, integer_rows, is_whole

PARTS = 16
ENTRIES = 64
ROUNDS = 2
HOT = 1000  # a label is hot if it holds more than one in HOT rows, so there are fewer than HOT


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of every row of ``x``, and its squared distance."""
    width = x.shape[1]
    if width * (largest(x) + largest(entries)) ** 2 >= 1 << 63:
        raise OverflowError("components too large for 64-bit distances")
    cross = exact_products(x, entries)
    far = (entries * entries).sum(axis=1) - 2 * cross
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code] + (x * x).sum(axis=1)


def codes_of(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of every part of every row, and the row's squared distances summed over parts."""
    parts, _, width = books.shape
    code = np.zeros((len(x), parts), np.uint8)
    error = np.zeros(len(x), np.int64)
    for p in range(parts):
        code[:, p], far = nearest(x[:, p * width : (p + 1) * width], books[p])
        error += far
    return code, error


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``(slot, total, n)``: component sums and counts of the parts nearest to each entry."""
    parts, entries, width = books.shape
    names = ["slot", "total", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.shape, np.int64)
        count = np.zeros((parts, entries), np.int64)
        for b in batches:
            _, _, x = integer_rows(b.column(0), parts * width)
            if len(x) == 0:
                continue
            code, _ = codes_of(x, books)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                count[p] += np.bincount(code[:, p], minlength=entries)
        slot = np.flatnonzero(np.repeat(count.ravel(), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(total.ravel()[slot]), pa.array(np.repeat(count.ravel(), width)[slot])], names
        )

    found = rows.select("embedding").mapInArrow(run, "slot long, total long, n long")
    return found.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def train_codebooks(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks as (part, entry, component), ``None`` if no vector is whole.

    They start as the parts of the whole vectors of the least ids, as many as there are up to
    ``entries``, among those as long as the very first one; equal ids are ordered by the vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    width = first_width(rows, "vec_id", "embedding")
    if width is None:
        return None
    if width == 0 or width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    start = (
        rows.where(is_whole("embedding")).where(F.size("embedding") == width)
        .orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    )
    first = np.array([[int(np.floor(SCALE * float(x))) for x in r["embedding"]] for r in start], np.int64)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        flat = books.ravel().copy()
        for r in _sums(rows, books).collect():  # as many as the codebooks have numbers
            flat[r["slot"]] = int(r["total"]) // r["n"]
        books = flat.reshape(books.shape)
    return books


def _with_label_totals(scored: DataFrame) -> DataFrame:
    """Add ``label_error``. Labels that hold many rows are few, and joined without moving their rows."""
    totals = cut(scored.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = totals.agg(F.sum("n")).head()[0] or 0
    totals = totals.withColumnRenamed("label", "of")
    hot = F.broadcast(totals.where(F.col("n") * HOT > rows).drop("n"))  # fewer than HOT rows
    rest = totals.where(F.col("n") * HOT <= rows).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    of_hot = scored.join(hot, same)
    others = scored.join(hot, same, "left_anti").join(rest, same)
    return of_hot.unionByName(others).drop("of")


def compress(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are dropped. A whole vector
    that is not as long as that of the least vec_id keeps its row with a null code and error.
    Null labels are one label; repeated rows and null ids count one by one; no rows give no rows.
    Components whose squared distances leave 64 bits raise an OverflowError. Other columns are
    not read.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = rows.schema["label"].dataType
    books = train_codebooks(rows, parts, entries, rounds)
    width = 0 if books is None else parts * books.shape[2]
    schema = StructType(
        [StructField("vec_id", LongType()), StructField("label", kind), StructField("code", StringType()),
         StructField("error", LongType())]
    )
    label_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, fits, x = integer_rows(b.column(2), width)
            written: list[str | None] = [None] * len(b)
            missed: list[int | None] = [None] * len(b)
            if len(x):
                code, error = codes_of(x, books)
                digits = code.tobytes().hex()
                for k, (i, e) in enumerate(zip(fits.tolist(), error.tolist(), strict=True)):
                    written[i], missed[i] = digits[2 * parts * k : 2 * parts * (k + 1)], e
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(whole), b.column(1).cast(label_type).take(whole),
                 pa.array([written[i] for i in whole], pa.string()), pa.array([missed[i] for i in whole], pa.int64())],
                schema.names,
            )

    said = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    digest = hashlib.sha256(said.encode()).hexdigest()
    scored = _with_label_totals(stored(rows.mapInArrow(run, schema)))
    return scored.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
