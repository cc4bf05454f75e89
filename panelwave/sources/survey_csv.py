"""Wide survey tables from CSV or Parquet."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelwave.sources.names import unique_headers


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Raw header fields. Only the first line of the file is fetched."""
    first = spark.read.text(path).take(1)
    if not first:
        raise ValueError(f"no header line in {path}")
    return next(csv.reader([first[0][0]]))


def read_wide(
    spark: SparkSession,
    path: str,
    id_col: str = "CASEID",
    dtype: T.DataType | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Read a wide survey CSV: ``id_col`` as bigint, every other column as ``dtype``.

    Repeated header names become ``X``, ``X.1``, ``X.2`` by order of appearance. The
    schema is explicit, so Spark makes no inference pass, and a field that is no
    number (such as an empty one) is null. Pass ``names`` for files without repeats
    in their header to skip the look at the first line.
    """
    value = dtype or T.DoubleType()
    columns = list(names) if names is not None else unique_headers(header_of(spark, path))
    schema = T.StructType(
        [T.StructField(c, T.LongType() if c == id_col else value) for c in columns]
    )
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")


def read_wide_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The same table after a one-time conversion; only used columns are read."""
    return spark.read.parquet(path)
