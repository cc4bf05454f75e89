"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import fill_const, quoted


def melt_panel(
    df: DataFrame, id_col: str, cols: Sequence[str], value: str, variable: str = "variable"
) -> DataFrame:
    """One row per (row, column), missing values kept. Narrow: no shuffle."""
    return df.select(id_col, *[F.col(quoted(c)) for c in cols]).unpivot(
        id_col, [quoted(c) for c in cols], variable, value
    )


def spread(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Long to wide for a fixed list of names; a repeated (keys, name) is an error.

    The check rides on the aggregation: a cell that got two rows fails the job.
    """
    def cell(label: str) -> Column:
        here = F.col(name) == label
        twice = F.count(F.when(here, 1)) > 1
        only = F.max(F.when(here, F.col(value)))
        error = F.raise_error(F.lit(f"spread: more than one row for {label}"))
        return F.when(twice, error).otherwise(only).alias(label)

    return df.groupBy(*keys).agg(*[cell(label) for label in names])


def any_positive(df: DataFrame, keys: Sequence[str], col: str, alias: str | None = None) -> DataFrame:
    """1 if the values of a group sum to more than 0, else 0 (also for all-null groups)."""
    total = F.sum(F.expr(fill_const(col, 0)))
    return df.groupBy(*keys).agg(F.when(total > 0, 1).otherwise(0).alias(alias or col))
