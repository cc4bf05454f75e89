"""Exact global quantiles by radix selection, and the trimming rules built on the median.

Doubles are read as 64-bit integers in the same order. A pass counts 16-bit digits of all values
under the prefixes that hold a wanted rank; after four passes each wanted value is known to the
last bit. All conditions and shares take part in the same passes. The first pass reads the input;
what lies under the prefixes it finds is written, and the other passes read that. Rows without a
value do not reach Python. Tasks return counts of digits, of which there are no more than 65,536 for
a prefix, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import fill_const, null_if, number, quoted
from panelwave.functions.recode import flag_at_least
from panelwave.sources.shared import saved

DIGIT_BITS = 16
PASSES = 64 // DIGIT_BITS
DIGITS = 1 << DIGIT_BITS


def global_median(df: DataFrame, value: str, where: str | None = None) -> float | None:
    """Exact median of the non-null values, middle pair averaged; ``None`` if there are none."""
    return global_quantiles(df, value, (0.5,), where)[0]


def global_quantiles(
    df: DataFrame, value: str, shares: Sequence[float], where: str | None = None, accuracy: int | None = None
) -> list[float | None]:
    """Quantiles of the values of one condition; see :func:`quantiles`."""
    return quantiles(df, value, shares, {"all": where or "true"}, accuracy)["all"]


def quantiles(
    df: DataFrame, value: str, shares: Sequence[float], conditions: Mapping[str, str], accuracy: int | None = None
) -> dict[str, list[float | None]]:
    """Quantiles of ``value`` under every named condition; nulls and NaN do not count.

    Exact ones lie between two neighbouring order statistics in proportion; the two zeros are one
    value. With ``accuracy`` they are a value whose rank is off by at most the number of values over
    ``accuracy`` instead, from mergeable sketches in one pass.
    """
    columns = [
        F.expr(f"CASE WHEN {c} THEN nullif(CAST({value} AS DOUBLE), DOUBLE('NaN')) END").alias(f"v{i}")
        for i, c in enumerate(conditions.values())
    ]
    values = df.select(*columns)
    if accuracy is not None:
        if accuracy <= 0:
            raise ValueError("accuracy must be positive")
        sketched = [F.percentile_approx(c, list(shares), accuracy).alias(c) for c in values.columns]
        found = values.agg(*sketched).head()
        return {name: list(x) if x is not None else [None for _ in shares] for name, x in zip(conditions, found)}
    selected = _selected(values, shares)
    return dict(zip(conditions, selected))


def _ranks(total: int, share: float) -> tuple[int, int, float]:
    """The two neighbouring ranks, from 0, and the way between them."""
    place = (total - 1) * share
    first, part = math.floor(place), place - math.floor(place)
    return first, first + (1 if part > 0 else 0), part


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (values + 0.0).view(np.uint64)  # a negative zero becomes the positive one
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def unordered(key: int) -> float:
    """The double of an integer of :func:`ordered`."""
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def under_prefixes(columns: Sequence[str], prefixes: Sequence[tuple[int, int]], done: int) -> str:
    """Condition that holds for all rows with a value under one of the prefixes, and for few others.

    A value has to lie between the least and the greatest double of a prefix; a bound that is no
    finite number bounds nothing.
    """
    below = 64 - DIGIT_BITS * done
    parts = []
    for column, prefix in prefixes:
        value = quoted(columns[column])
        low, high = unordered(prefix << below), unordered((prefix + 1 << below) - 1)
        bounds = [f"{value} {sign} {number(x)}" for sign, x in ((">=", low), ("<=", high)) if math.isfinite(x)]
        parts.append(" AND ".join([f"{value} IS NOT NULL", *bounds]))
    return " OR ".join(f"({x})" for x in parts)


def digit_counts(values: DataFrame, prefixes: Sequence[tuple[int, int]], done: int) -> dict[int, np.ndarray]:
    """For each (column, prefix of ``done`` digits), how many of the column's values go on with each digit."""
    shift = np.uint64(64 - DIGIT_BITS * (done + 1))

    def count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(prefixes), DIGITS), np.int64)
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            for slot, (column, prefix) in enumerate(prefixes):
                if column not in held:
                    x = batch.iloc[:, column].to_numpy(dtype=float)
                    held[column] = ordered(x[~np.isnan(x)]) >> shift
                keys = held[column]
                if done:
                    keys = keys[keys >> np.uint64(DIGIT_BITS) == np.uint64(prefix)]
                counts[slot] += np.bincount((keys & np.uint64(DIGITS - 1)).astype(np.int64), minlength=DIGITS)
        slot, digit = np.nonzero(counts)
        yield pd.DataFrame({"slot": slot, "digit": digit, "n": counts[slot, digit]})

    found = values.mapInPandas(count_task, "slot int, digit int, n bigint")
    out = {slot: np.zeros(DIGITS, np.int64) for slot in range(len(prefixes))}
    for row in found.groupBy("slot", "digit").agg(F.sum("n").alias("n")).collect():
        out[row["slot"]][row["digit"]] = row["n"]
    return out


def _selected(values: DataFrame, shares: Sequence[float]) -> list[list[float | None]]:
    """Exact quantiles of every column."""
    columns = range(len(values.columns))
    values = values.where(" OR ".join(f"{quoted(c)} IS NOT NULL" for c in values.columns))
    # a wanted rank: its prefix so far and its rank under that
    prefix: dict[tuple[int, int], int] = {}
    under: dict[tuple[int, int], int] = {}
    totals: list[int] = []
    for done in range(PASSES):
        if done == 0:
            slots = [(c, 0) for c in columns]
        else:
            slots = sorted({(c, p) for (c, _), p in prefix.items()})
        if not slots:
            break
        if done == 1:
            values = saved(values.where(under_prefixes(values.columns, slots, done)), "values")
        counts = digit_counts(values, slots, done)
        if done == 0:
            totals = [int(counts[c].sum()) for c in columns]
            for c in columns:
                for share in shares if totals[c] else ():
                    for rank in _ranks(totals[c], share)[:2]:
                        prefix[c, rank], under[c, rank] = 0, rank
        place = {slot: i for i, slot in enumerate(slots)}
        upto = {i: np.cumsum(n) for i, n in counts.items()}
        for wanted, rank in under.items():
            sums = upto[place[wanted[0], prefix[wanted]]]
            digit = int(np.searchsorted(sums, rank, side="right"))
            under[wanted] = rank - (int(sums[digit - 1]) if digit else 0)
            prefix[wanted] = prefix[wanted] << DIGIT_BITS | digit
    out: list[list[float | None]] = []
    for c in columns:
        row: list[float | None] = []
        for share in shares:
            if not totals[c]:
                row.append(None)
                continue
            first, second, part = _ranks(totals[c], share)
            low, high = unordered(prefix[c, first]), unordered(prefix[c, second])
            row.append(low if part == 0 else low + (high - low) * part)
        out.append(row)
    return out


def medians(median: float | None, k: float) -> str:
    return "CAST(NULL AS DOUBLE)" if median is None else number(float(median) * k)


def cap_above_median(value: str, median: float | None, k: float = 5) -> str:
    """``value``, null where it exceeds ``k`` medians (everywhere if there is no median)."""
    return null_if(f"{value} > {medians(median, k)}", value)


def cap_k_median(df: DataFrame, col: str, k: float = 5, threshold: float = 1) -> DataFrame:
    """Null amounts become 0, ``<col>_indicator`` flags those of at least ``threshold``,
    and amounts above ``k`` medians of the flagged ones become null."""
    amount = df.withColumn(col, F.expr(fill_const(f"CAST({col} AS DOUBLE)", "0D"))).withColumn(
        f"{col}_indicator", F.expr(flag_at_least(col, threshold))
    )
    median = global_median(amount, col, where=f"{col}_indicator = 1")
    return amount.withColumn(col, F.expr(cap_above_median(col, median, k)))


def filter_below_k_median(
    df: DataFrame, col: str, k: float = 5, where: str = "true"
) -> DataFrame:
    """Rows with ``0 < col < k * median``; the median is over all of ``df``, and
    ``where`` is one more condition on the rows kept."""
    median = global_median(df, col)
    return df.where(f"{col} > 0 AND {col} < {medians(median, k)} AND ({where})")
