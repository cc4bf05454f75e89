"""Scalar recodes: flags, range bins, deflation, logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from panelwave.functions.nullsafe import among, if3, number

# Price index by wave.
PRICE_INDEX = {
    4: 0.978, 5: 1.019, 6: 1.055, 7: 1.096, 8: 1.112, 9: 1.157, 10: 1.211,
    11: 1.274, 12: 1.346, 13: 1.381, 14: 1.426, 15: 1.462, 16: 1.544,
    17: 1.616, 18: 1.688, 19: 1.771, 20: 1.852,
}

# Industry classes as (above, below, class), both ends excluded, in order.
INDUSTRY_BINS = (
    (66, 399, 1),
    (None, 58, 2),
    (406, 480, 3),
    (506, 699, 4),
    (706, 899, 5),
)
INDUSTRY_OTHER = 6


def flag_equal(value: str, code) -> str:
    return if3(f"{value} = {code}", 1, 0)


def flag_in(value: str, codes: Iterable) -> str:
    return if3(among(value, list(codes)), 1, 0)


def flag_positive(value: str) -> str:
    return if3(f"{value} > 0", 1, 0)


def flag_at_least(value: str, threshold) -> str:
    return if3(f"{value} < {threshold}", 0, 1)


def bin_ranges(value: str, bins=INDUSTRY_BINS, default=INDUSTRY_OTHER) -> str:
    """Class of the first open range holding ``value``; ``default`` in the gaps, null for null."""
    cases = [f"WHEN {value} IS NULL THEN NULL"]
    for above, below, label in bins:
        low = "" if above is None else f"{value} > {above} AND "
        cases.append(f"WHEN {low}{value} < {below} THEN {label}")
    return f"CASE {' '.join(cases)} ELSE {default} END"


def lookup(key: str, table: Mapping) -> str:
    """Value of a small literal table, null outside it."""
    return "CASE " + " ".join(f"WHEN {key} = {k} THEN {number(v)}" for k, v in table.items()) + " END"


def deflate(
    value: str, wave: str, index: Mapping[int, float] = PRICE_INDEX, otherwise: str = "null"
) -> str:
    """``value`` over the index of its wave.

    ``otherwise`` says what a wave outside the index gives: ``"null"`` or ``"nominal"``.
    """
    if otherwise not in ("null", "nominal"):
        raise ValueError(f"otherwise must be 'null' or 'nominal', got {otherwise!r}")
    if otherwise == "null":
        return f"{value} / {lookup(wave, index)}"
    return f"{value} / coalesce({lookup(wave, index)}, 1D)"


def log_shifted(value: str, shift: float = 1) -> str:
    return f"ln({value} + {shift})"


def log_scaled(value: str, unit: float) -> str:
    return f"ln({value} / {unit})"


def row_max(*values: str) -> str:
    """Largest of the values in a row, nulls skipped; null only if all are null."""
    return f"greatest({', '.join(values)})"
