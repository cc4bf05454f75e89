"""Within-person operators on long tables, as window functions.

A person has at most one row per wave, so the rows one window sees are bounded by
the number of waves, however many persons or raw records there are. Where raw
records come first (several jobs, many events), reduce them to person x wave cells
with a ``groupBy`` - it combines on the map side - before using these. All functions
use one partitioning, so Spark plans a single exchange and sort for any mix of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from panelwave.functions.nullsafe import fill_const

KEY = "caseid"
WAVE = "wave"


def by_wave(key: str = KEY, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*(order or (WAVE,)))


def lead1(col: str, key: str = KEY, *order: str) -> Column:
    """Value of the person's next row."""
    return F.lead(col, 1).over(by_wave(key, *order))


def lag1(col: str, key: str = KEY, *order: str) -> Column:
    return F.lag(col, 1).over(by_wave(key, *order))


def running_total(col: str, key: str = KEY, *order: str) -> Column:
    """Sum up to and including the row, null counted as 0."""
    upto = by_wave(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.expr(fill_const(col, 0))).over(upto)


def total_before(col: str, key: str = KEY, *order: str) -> Column:
    """The previous row's running total; null on the first row."""
    before = by_wave(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return F.sum(F.expr(fill_const(col, 0))).over(before)


def filled(col: str, key: str = KEY, *order: str) -> Column:
    """Last non-null value up to the row."""
    upto = by_wave(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col, ignorenulls=True).over(upto)


def ffill(df: DataFrame, cols: Sequence[str], key: str = KEY, *order: str) -> DataFrame:
    return df.withColumns({c: filled(c, key, *order) for c in cols})


def value_at(col: str, wave: int, key: str = KEY) -> Column:
    """The person's value at one wave, on every row; null if that wave is absent.

    Stated as a range of waves from the current row on, so it shares the sort of the
    other windows.
    """
    whole = Window.partitionBy(key).orderBy(WAVE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return F.max(F.when(F.col(WAVE) == wave, F.col(col))).over(whole)


def backfill_from(df: DataFrame, col: str, at: int, src: int, key: str = KEY) -> DataFrame:
    """At wave ``at``, replace null by the person's value at wave ``src``."""
    missing = (F.col(WAVE) == at) & F.col(col).isNull()
    return df.withColumn(
        col, F.when(missing, value_at(col, src, key)).otherwise(F.col(col))
    )


def value_ahead(col: str, waves: int, key: str = KEY) -> Column:
    """Value exactly ``waves`` waves later (not rows later); null if there is none."""
    exact = Window.partitionBy(key).orderBy(WAVE).rangeBetween(waves, waves)
    return F.max(col).over(exact)


def exposure_history(
    df: DataFrame, status: str, ever: str, key: str = KEY, *order: str
) -> DataFrame:
    """Add ``ever``: 1 if exposed before and not now, else 0; a null status counts as 0."""
    upto = by_wave(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    known = df.withColumn(status, F.expr(fill_const(status, 0)))
    return known.withColumn(
        ever, F.when(F.col(status) == 1, 0).otherwise(F.max(status).over(upto))
    )
