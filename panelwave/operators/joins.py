"""Joins and set operations on panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import quoted


def natural_left(left: DataFrame, *rights: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on all shared column names, one right table after another.

    ``null_safe`` lets a null key match a null key. Repeated keys on the right
    multiply rows; ``assert_unique`` guards against that where it matters.
    """
    for right in rights:
        shared = [c for c in left.columns if c in right.columns]
        if not shared:
            raise ValueError("no shared column to join on")
        if not null_safe:
            left = left.join(right, shared, "left")
            continue
        keyed = right.select(
            *[F.col(quoted(c)).alias(f"right:{c}" if c in shared else c) for c in right.columns]
        )
        match = reduce(
            lambda a, b: a & b,
            [left[quoted(c)].eqNullSafe(keyed[quoted(f"right:{c}")]) for c in shared],
        )
        left = left.join(keyed, match, "left").drop(*[f"right:{c}" for c in shared])
    return left


def exclude_ids(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``ids``; nulls in ``ids`` exclude nothing."""
    return df.join(ids, key, "left_anti")


def attach_wave(
    df: DataFrame, history: DataFrame, wave: int, renames: Mapping[str, str], key: str = "caseid"
) -> DataFrame:
    """Left join, on the person only, the named columns of one wave of another table."""
    one = history.where(F.col("wave") == wave).select(
        key, *[F.col(old).alias(new) for old, new in renames.items()]
    )
    return df.join(one, key, "left")


def stack(*dfs: DataFrame) -> DataFrame:
    """Union of all rows by column name; a column that one side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
