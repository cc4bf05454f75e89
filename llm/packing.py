"""Harmonic packing of token sequences.

Class j holds pieces that fit j times, but not j + 1 times, into a sequence, and every
sequence of a class takes exactly j of them. Workers fill the sequences of their own group of
pieces; no group needs another's state. Whole sequences are cut off a document first. What is
left is cut again where its class would leave more than ``SLACK`` tokens unused: a piece of the
next class's exact size goes, and the rest finds a class with less waste. Pieces of the last
class are too short for a fixed count and fill sequences by their running length. Groups that
cannot fill their last sequence hand its pieces on to fewer groups, and the few of the last
round, at most a class's count for each class, are put together first fit by falling length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from llm.shared import cut, ship, stored
from llm.tokens import MEMO, WORD_BYTES, word_ids

CAPACITY = 2048
CLASSES = 64  # the last one holds all shorter pieces
SLACK = 24  # tokens of a place that may stay empty
PIECES = 3  # into which the end of a document may fall
GROUP = 1000  # pieces of a class that one group holds
FAN_IN = 32  # groups that hand their rest to one
IDS_BYTES = 1 << 23  # of ids handed on at a time
BIN_BITS = 16  # of a sequence's number within its group, of some GROUP pieces
ROWS = 1000  # pieces assembled at a time

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, class int"


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``tokens`` tokens, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    for k in range(PIECES):
        if rest == 0:
            break
        j = capacity // rest
        if j >= CLASSES or capacity // j - rest <= SLACK or k == PIECES - 1:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= capacity // (j + 1)
    return out


def document_pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, narrow: bool = False,
    memo_size: int = MEMO, group_bytes: int = WORD_BYTES,
) -> DataFrame:
    """Pieces of every document's ids and end id: start, length, class (and the ids).

    The ids have 4 bytes each; with ``narrow`` only 2 in documents whose ids all fit.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(5 + with_ids)]
            held = 0
            texts = (t.encode() if t else b"" for t in b.column(1).to_pylist())
            for key, ids in zip(b.column(0).to_pylist(), word_ids(tokenizer, texts, memo_size, group_bytes), strict=True):
                ids += end
                each, kept, at = 4, ids, 0
                if narrow and (few := np.frombuffer(ids, "<u4")).max() < 1 << 16:
                    each, kept = 2, few.astype("<u2").tobytes()
                for n in piece_lengths(len(ids) // 4, capacity):
                    row = (key, at, n, len(ids) // 4, min(CLASSES, capacity // n))
                    if with_ids:
                        row = (*row, kept[each * at : each * (at + n)])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += n
                held += with_ids * len(ids)
                if held > IDS_BYTES:
                    yield batch(cols)
                    cols, held = [[] for _ in cols], 0
            yield batch(cols)

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32()),
             *(pa.array(c, pa.binary()) for c in cols[5:])],
            names,
        )

    schema = PIECE_SCHEMA + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _fill(pieces: DataFrame, groups: dict[int, int], capacity: int) -> DataFrame:
    """Number the sequences of each class within each group; ``full`` marks the complete ones."""
    of_class = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    # a class's groups number as many as its pieces ask for
    at = pieces.withColumn("group", F.pmod(F.xxhash64("piece"), F.element_at(of_class, F.col("class"))))
    w = Window.partitionBy("class", "group").orderBy("piece")
    short = capacity // CLASSES
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn(
        "bin",
        F.when(
            F.col("class") < CLASSES, F.floor((F.row_number().over(w) - 1) / F.col("class"))
        ).otherwise(F.floor(F.coalesce(before, F.lit(0)) / (capacity - short))).cast("long"),
    )
    whole = Window.partitionBy("class", "group", "bin")
    last = F.max("bin").over(Window.partitionBy("class", "group"))
    return (
        at.withColumn("n_in", F.count("*").over(whole))
        .withColumn(
            "full",
            F.when(F.col("class") < CLASSES, F.col("n_in") == F.col("class")).otherwise(F.col("bin") < last),
        )
        .drop("n_in")
    )


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every piece is in exactly one sequence.

    Rows that repeat are pieces of their own, and extra columns pass through; ids may be null.
    Pieces are dealt by their number ``piece``, which is given here where the column is missing and
    else has to be unique, so that no group grows with equal rows. No rows give no rows.
    """
    own = "piece" not in pieces.columns
    if own:
        pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    rest = cut(pieces)
    counts = dict(rest.groupBy("class").count().collect())  # one number for each class
    groups = {c: -(-n // GROUP) for c, n in counts.items()}
    done, level = [], 0
    while groups and max(groups.values()) > 1:
        numbered = cut(_fill(rest, groups, capacity).withColumn("level", F.lit(level)))
        done.append(numbered.where("full"))
        rest = numbered.where("not full").drop("group", "bin", "full", "level")
        groups = {c: -(-g // FAN_IN) for c, g in groups.items()}
        level += 1
    if groups:
        numbered = cut(_fill(rest, groups, capacity).withColumn("level", F.lit(level)))
        done.append(numbered.where("full"))
        rest = numbered.where("not full").drop("group", "bin", "full", "level")

    def first_fit(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["length", "piece"], ascending=[False, True])
        room: list[int] = []
        place = []
        for n in order["length"]:
            k = next((i for i, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            room[k] -= n
            place.append(k)
        return order.assign(group=0, bin=place, full=True, level=level + 1, **{"class": 0})

    schema = StructType(
        [*pieces.schema, StructField("group", LongType()), StructField("bin", LongType()),
         StructField("full", BooleanType()), StructField("level", IntegerType())]
    )
    # the incomplete sequences of one group of each class: at most 1 + 2 + ... + CLASSES pieces
    done.append(rest.groupBy(F.col("length") * 0).applyInPandas(first_fit, schema))
    every = done[0].select(*schema.names)
    for d in done[1:]:
        every = every.unionByName(d.select(*schema.names))
    inside = (
        Window.partitionBy("level", "class", "group", "bin").orderBy("piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    number = (
        F.shiftleft(F.col("level").cast("long"), 58)
        + F.shiftleft(F.col("class").cast("long"), 51)
        + F.shiftleft(F.col("group"), BIN_BITS) + F.col("bin")
    )
    fits = (F.col("bin") < 1 << BIN_BITS) & (F.col("group") < 1 << 51 - BIN_BITS)
    number = F.when(fits, number).otherwise(F.raise_error(F.lit("a group has more sequences than its numbers")).cast("long"))
    return every.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).withColumn(
        "sequence_id", number
    ).drop("group", "bin", "full", "level", "class", *(["piece"] if own else []))


@dataclass
class Assembled:
    """Whole sequences in one flat array of ids, padded, and the pieces they are made of."""

    rows: pa.RecordBatch
    ids: np.ndarray
    sequence: np.ndarray  # number of each piece's sequence within ``begin``
    begin: np.ndarray  # of each sequence in ``ids``
    padded: np.ndarray
    tokens: np.ndarray
    place: np.ndarray  # of each piece in ``ids``


def _values(column: pa.Array, length: np.ndarray) -> np.ndarray:
    """All ids of the pieces, one after another; a piece has 2 or 4 bytes for each."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    for each in (2, 4):
        if (size == each * length).all():
            return data.view(f"<u{each}").astype("<u4")
    parts = [
        data[a - ends[0] : b - ends[0]].view("<u2" if b - a == 2 * n else "<u4")
        for a, b, n in zip(ends[:-1].tolist(), ends[1:].tolist(), length.tolist())
    ]
    return np.concatenate(parts).astype("<u4")


def _one(rows: pa.RecordBatch, capacity: int, pad_id: int) -> Assembled:
    key, offset, length = (rows.column(c).to_numpy() for c in ("sequence_id", "offset", "length"))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sequence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    before = np.cumsum(length) - length
    wrong = np.flatnonzero(offset != before - before[first][sequence])
    if len(wrong):
        raise ValueError(f"sequence {key[wrong[0]]}: a piece at {offset[wrong[0]]} that does not follow the one before")
    tokens = np.add.reduceat(length, first)
    if tokens.max() > capacity:
        raise ValueError(f"sequence {key[first[tokens.argmax()]]} has {tokens.max()} tokens")
    padded = np.where(tokens & (tokens - 1) == 0, tokens, capacity)
    begin = np.cumsum(padded) - padded
    ids = np.full(int(padded.sum()), pad_id, "<u4")
    place = begin[sequence] + offset
    ids[np.repeat(place - before, length) + np.arange(int(length.sum()))] = _values(rows.column("ids"), length)
    return Assembled(rows, ids, sequence, begin, padded, tokens, place)


def _assembled(batches: Iterator[pa.RecordBatch], capacity: int, pad_id: int) -> Iterator[Assembled]:
    """Whole sequences, from rows that come sequence by sequence in order."""
    held: pa.RecordBatch | None = None
    for b in batches:
        for at in range(0, len(b), ROWS):
            rows = b.slice(at, ROWS)
            if held is not None:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            key = rows.column("sequence_id").to_numpy()
            last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if last:
                yield _one(rows.slice(0, last), capacity, pad_id)
            held = rows.slice(last)
    if held is not None:
        yield _one(held, capacity, pad_id)


def _in_order(packed: DataFrame) -> DataFrame:
    return packed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, n_tokens)``: the ids of packed pieces that carry them, padded.

    Padding reaches the capacity, except where the length is a power of two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _assembled(batches, capacity, pad_id):
            key = made.rows.column("sequence_id").to_numpy()
            first = np.searchsorted(made.sequence, np.arange(len(made.begin)))
            ids = pa.ListArray.from_arrays(
                pa.array(np.append(made.begin, len(made.ids)), pa.int32()), pa.array(made.ids.astype(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first]), ids, pa.array(made.tokens)], ["sequence_id", "ids", "n_tokens"]
            )

    parts = _in_order(packed.select("sequence_id", "offset", "length", "ids"))
    return parts.mapInArrow(run, "sequence_id long, ids array<long>, n_tokens long")


def packed_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = 1, pad_id: int = 0, with_sequences: bool = True,
    memo_size: int = MEMO, group_bytes: int = WORD_BYTES,
) -> DataFrame:
    """The pieces of all documents as they lie in the assembled, padded sequences.

    ``length``, ``ids_crc32`` and ``offset`` are those of the stretch of the sequence's ids. The row
    at offset 0 also has them all in ``sequence`` (``with_sequences``), null in the other rows.
    Only small rows without ids are packed; the ids wait in the shared folder and move twice.
    ``memo_size`` words are remembered in a Python worker, which encodes ``group_bytes`` at a time.
    """
    pieces = document_pieces(
        docs, tokenizer, doc_id, text, capacity, end_id, True, True, memo_size, group_bytes
    )
    pieces = stored(pieces.withColumn("piece", F.monotonically_increasing_id()))
    placed = harmonic_pack(pieces.drop("ids"), capacity).select("piece", "sequence_id", "offset")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "sequence_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _assembled(batches, capacity, pad_id):
            raw = memoryview(made.ids).cast("B")
            length, offset = made.rows.column("length").to_numpy(), made.place - made.begin[made.sequence]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(made.place.tolist(), (made.place + length).tolist())]
            of = {"ids_crc32": pa.array(crc, pa.int64()), "offset": pa.array(offset)}
            columns = [of[n] if n in of else made.rows.column(n) for n in names]
            if with_sequences:
                later = offset > 0
                size = np.where(later, 0, made.padded[made.sequence])
                ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(made.ids.astype(np.int64)), mask=pa.array(later)))
            yield pa.RecordBatch.from_arrays(columns, names + ["sequence"] * with_sequences)

    parts = pieces.select("piece", "doc_id", "start", "length", "doc_tokens", "ids").join(placed, "piece").drop("piece")
    schema = ", ".join(f"{n} long" for n in names) + ", sequence array<long>" * with_sequences
    return _in_order(parts).mapInArrow(run, schema)
