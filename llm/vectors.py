"""Integer vectors from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 1 << 31  # of a component after scaling


def is_whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    value = F.col(vector)
    fine = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return value.isNotNull() & fine


def first_width(rows: DataFrame, vec_id: str, vector: str) -> int | None:
    """The length of the whole vector of the least id, ``None`` if there is none."""
    first = (
        rows.where(is_whole(vector)).orderBy(F.asc_nulls_last(vec_id), F.col(vector))
        .select(F.size(vector).alias("n")).head()
    )
    return None if first is None else first["n"]


def integer_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are whole, which of them have ``width`` components, and floor(256 x) of the latter."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    value = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    here = np.maximum(size, 0)
    start = np.cumsum(here) - here
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
    whole = (size >= 0) & (bad[start + here] == bad[start])
    rows = np.flatnonzero(whole & (size == width))
    x = np.floor(SCALE * value[start[rows][:, None] + np.arange(width)])
    if x.size and np.abs(x).max() >= LARGEST:
        raise OverflowError("components too large for 64-bit dot products")
    return np.flatnonzero(whole), rows, x.astype(np.int64)
