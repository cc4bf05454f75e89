"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of records in ascending doc_id order, and the shards ascend as well:

    record   uint64 length of the payload | uint32 masked checksum of those 8 bytes |
             payload | uint32 masked checksum of the payload
    payload  int64 doc_id | uint8 bytes of an id, 2 or 4 | the ids
    index    for each record: int64 doc_id, uint64 offset in the shard, uint64 length in bytes

All integers are little-endian. A checksum is the CRC-32 of zlib, rotated right by 15 bits
plus a constant, so that a checksum of bytes that hold checksums stays telling. Tasks write
under a name of their own and rename when done, so a task that runs again, or twice at once,
leaves one complete shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.shared import cut, shared_folder, ship
from llm.tokens import word_ids

MASK = 0xA282EAD8
SHARD_ROWS = 16_384
BLOCK = 1 << 22
INDEX = "<qQQ"

SHARDS = "shard long, path string, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def record(doc_id: int, ids: bytes) -> bytes:
    """A record of little-endian 32-bit ids, kept in 16 bits where all fit."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) == 0 or wide.max() < 1 << 16:
        body = struct.pack("<qB", doc_id, 2) + wide.astype("<u2").tobytes()
    else:
        body = struct.pack("<qB", doc_id, 4) + ids
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def parse(data: bytes) -> tuple[int, np.ndarray]:
    """doc_id and ids of one whole record; ValueError if a length or checksum is wrong."""
    (n,) = struct.unpack_from("<Q", data)
    if n != len(data) - 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise ValueError("record length is damaged")
    body = data[12:-4]
    if struct.unpack("<I", data[-4:])[0] != masked(body):
        raise ValueError("record payload is damaged")
    doc_id, width = struct.unpack_from("<qB", body)
    return doc_id, np.frombuffer(body, f"<u{width}", offset=9).astype("<u4")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text",
    end_id: int = 1, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Encode, append the end id, and write; returns the shards, ascending: path and sizes.

    Null text counts as empty: the end id alone. A null doc_id is written as -1. Rows that
    repeat a doc_id follow one another, in the order of their texts. No rows, no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        place, path = _open(f"{folder}/{shard:08d}.rec")
        out = index = None
        n = tokens = at = 0
        for b in batches:
            if out is None and b.num_rows:
                place.create_dir(path.rpartition("/")[0], recursive=True)
                out = place.open_output_stream(f"{path}.{mine}")
                index = place.open_output_stream(f"{path}.{mine}.idx")
            texts = (t.encode() for t in b.column(1).to_pylist())
            for key, ids in zip(b.column(0).to_pylist(), word_ids(tokenizer, texts), strict=True):
                data = record(key, ids + end)
                out.write(data)
                index.write(struct.pack(INDEX, key, at, len(data)))
                at, n, tokens = at + len(data), n + 1, tokens + len(ids) // 4 + 1
        if out is not None:
            out.close()
            index.close()
            place.move(f"{path}.{mine}.idx", f"{path}.idx")
            place.move(f"{path}.{mine}", path)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [f"{folder}/{shard:08d}.rec"], "n_records": [n], "n_tokens": [tokens]},
                pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, SHARDS))


def read_token_files(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of every record of the shards, in file order within a shard.

    start counts the ids of all documents before; ids are little-endian 32-bit integers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                place, name = _open(path)
                with place.open_input_file(f"{name}.idx") as f:
                    index = np.frombuffer(f.read(), np.dtype([("id", "<i8"), ("at", "<u8"), ("n", "<u8")]))
                with place.open_input_file(name) as f:
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(index["at"], index["at"][i] + BLOCK)))
                        block = f.read_at(int(index["at"][j - 1] + index["n"][j - 1] - index["at"][i]), int(index["at"][i]))
                        rows = []
                        for at, n in zip(index["at"][i:j] - index["at"][i], index["n"][i:j], strict=True):
                            key, ids = parse(block[int(at) : int(at + n)])
                            rows.append((key, start, ids.tobytes()))
                            start += len(ids)
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"])
                        i = j

    # one number for each file of the order of 100 MB
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # one task for each file; a number keeps adaptive execution from joining them
    spread = starts.repartitionByRange(max(1, shards.count()), "shard").select("path", "start")
    return spread.mapInPandas(read, "doc_id long, start long, ids binary")


def read_records(shard: str, positions: list[int]) -> list[tuple[int, np.ndarray]]:
    """The records at some positions of a shard, in that order: a shuffled read by the index."""
    place, name = _open(shard)
    found = []
    with place.open_input_file(f"{name}.idx") as idx, place.open_input_file(name) as f:
        for p in positions:
            _, at, n = struct.unpack(INDEX, idx.read_at(24, 24 * p))
            found.append(parse(f.read_at(n, at)))
    return found
