"""Wave arithmetic: yearly until 1994, every second year from 1996 on.

Each rule exists twice: for a plain number (source names are parsed on the driver)
and as an expression (long tables that carry the year or the stem as data).
"""

from __future__ import annotations

from collections.abc import Mapping

from panelwave.functions.nullsafe import text

# Fixed values of the survey calendar.
FIRST_YEAR = 1979
BIENNIAL_FROM = 1996
BIENNIAL_OFFSET = 982
CENTURY_SPLIT = 50

# Waves added to the suffix number, by name stem.
INCOME_SHIFT = {"Q1_TRUNC_REVISED": 3, "Q1_TRUNC": 19}
PSECTOR_SHIFT = {"QE": 15}
EMPLOYMENT_MOVES = {18: 21}

# Wave of the n-th repeat of a drug item, by name stem.
DRUG_WAVES = {
    "D11": {0: 5, 1: 9, 2: 13, 3: 15, 4: 19},
    "D15": {0: 5, 1: 9, 2: 13, 3: 15, 4: 19},
    "D19": {0: 13, 1: 15, 2: 19},
}
DRUG_DEFAULT_WAVE = 5
DRUG_KEPT_STEM = "D19"


def year_to_wave(year: float) -> float:
    if year < BIENNIAL_FROM:
        return year - FIRST_YEAR
    return year / 2 - BIENNIAL_OFFSET


def wave_to_year(wave: int) -> int:
    annual = FIRST_YEAR + wave
    return annual if annual < BIENNIAL_FROM - 1 else 2 * (wave + BIENNIAL_OFFSET)


def wave_of_year(year: str) -> str:
    return (
        f"CASE WHEN {year} < {BIENNIAL_FROM} THEN CAST({year} - {FIRST_YEAR} AS DOUBLE)"
        f" ELSE CAST({year} AS DOUBLE) / 2 - {BIENNIAL_OFFSET} END"
    )


def full_year(two_digits: float) -> float:
    """Four-digit year of a two-digit one; 50 itself is left alone."""
    if two_digits == CENTURY_SPLIT:
        return two_digits
    return two_digits + (2000 if two_digits < CENTURY_SPLIT else 1900)


def expand_year(two_digits: str) -> str:
    return (
        f"CASE WHEN {two_digits} < {CENTURY_SPLIT} THEN {two_digits} + 2000"
        f" WHEN {two_digits} > {CENTURY_SPLIT} THEN {two_digits} + 1900 ELSE {two_digits} END"
    )


def school_wave(number: float) -> float:
    """Wave of an education column whose number may be a wave or a calendar year.

    Numbers up to 30 are waves already; 1995 belongs to neither calendar and stays.
    """
    if 30 < number < 1995:
        return number - FIRST_YEAR
    if number > 1995:
        return number / 2 - BIENNIAL_OFFSET
    return number


def school_wave_of(value: str) -> str:
    return (
        f"CASE WHEN {value} > 30 AND {value} < 1995 THEN CAST({value} - {FIRST_YEAR} AS DOUBLE)"
        f" WHEN {value} > 1995 THEN CAST({value} AS DOUBLE) / 2 - {BIENNIAL_OFFSET}"
        f" ELSE CAST({value} AS DOUBLE) END"
    )


def shift_wave(stem: str, wave: str, shifts: Mapping[str, int]) -> str:
    """Add a stem's offset to its wave; other stems keep theirs."""
    cases = " ".join(f"WHEN {stem} = {text(s)} THEN {wave} + {by}" for s, by in shifts.items())
    return f"CASE {cases} ELSE {wave} END"


def drug_wave(stem: str, repeat: int, fixed: bool = False) -> int:
    """Wave of a drug item.

    By default only the last stem keeps its own lookup and every other item counts
    at the default wave. ``fixed=True`` honours the lookup of all three stems.
    """
    known = DRUG_WAVES.get(stem, {}) if fixed or stem == DRUG_KEPT_STEM else {}
    return known.get(repeat, DRUG_DEFAULT_WAVE)


def remap_wave(stem: str, wave: str, table: Mapping[str, Mapping[int, int]], default) -> str:
    """Wave looked up by (stem, wave) in a small literal table."""
    cases = " ".join(
        f"WHEN {stem} = {text(name)} AND {wave} = {old} THEN {new}"
        for name, moves in table.items()
        for old, new in moves.items()
    )
    return f"CASE {cases} ELSE {default} END"


def name_stem(variable: str, sep: str = "[.]") -> str:
    """First piece of a source name."""
    return f"get(split({variable}, {text(sep)}), 0)"


def name_wave(variable: str, sep: str = "[.]", piece: int = 1) -> str:
    """Numeric suffix of a source name; 0 when there is none or it is no number."""
    return f"coalesce(try_cast(get(split({variable}, {text(sep)}), {piece}) AS INT), 0)"


def edit_name(variable: str, *edits: tuple[str, str]) -> str:
    """Literal replacements, every occurrence, in the given order."""
    for old, new in edits:
        variable = f"replace({variable}, {text(old)}, {text(new)})"
    return variable
