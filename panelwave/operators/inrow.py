"""Within-person operators on the wide layout.

A wide survey row already holds all waves of its person. So the values of one
variable over the waves are a list of expressions, and lead, running totals, fills and
exposure histories are expressions over that list: no shuffle, no sort, and no
person can be too large for a task. ``panelwave.operators.history`` has the same
operators for long tables.

Every function takes the expressions in (wave, file order) and returns a list of the
same length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelwave.functions.nullsafe import fill_const, quoted, text

ROWS = "_rows"


def null_of(dtype: str) -> str:
    return f"CAST(NULL AS {dtype})"


def lead1(values: Sequence[str], dtype: str = "double") -> list[str]:
    return [*values[1:], null_of(dtype)] if values else []


def lag1(values: Sequence[str], dtype: str = "double") -> list[str]:
    return [null_of(dtype), *values[:-1]] if values else []


def running_totals(values: Sequence[str]) -> str:
    """Array of the sums of all values up to and including each one, null counted as 0.

    One expression for all waves: a sum per wave would repeat the earlier ones and
    grow with the square of their number.
    """
    known = ", ".join(fill_const(v, "0D") for v in values)
    step = "(sums, v) -> array_append(sums, coalesce(element_at(sums, -1), 0D) + v)"
    return f"aggregate(array({known}), array(0D), {step})"


def running_total(totals: str, count: int) -> list[str]:
    """The running total at each of ``count`` positions of :func:`running_totals`."""
    return [f"{totals}[{i + 1}]" for i in range(count)]


def ffill(values: Sequence[str]) -> list[str]:
    """Last non-null value so far."""
    return [f"coalesce({', '.join(values[i::-1])})" for i in range(len(values))]


def first_exposed(status: Sequence[str]) -> str:
    """Position, from 1, of the first exposure; 0 if there is none."""
    return f"array_position(array({', '.join(status)}), 1)"


def exposure_history(status: Sequence[str], first: str) -> list[str]:
    """1 where the person was exposed before and is not exposed now, else 0.

    ``status`` is 0/1 without nulls, ``first`` the column of :func:`first_exposed`.
    """
    return [
        f"CASE WHEN {now} = 1 THEN 0 WHEN {first} BETWEEN 1 AND {i} THEN 1 ELSE 0 END"
        for i, now in enumerate(status)
    ]


def emit_rows(
    df: DataFrame, keep: Sequence[str], rows: Sequence[dict[str, str]], projected: bool = False
) -> DataFrame:
    """One output row per entry of ``rows``, with the ``keep`` columns repeated.

    All entries need the same names and types. The plan is one narrow generator. With ``projected``
    its array is a column of the projection below it: that is compiled, whereas a generator
    interprets what it is given, cell by cell, which costs more once rows have many columns. The
    array is never empty; the outer form says so, or Spark would make it a second time to look.
    """
    structs = [
        "named_struct(" + ", ".join(f"{text(k)}, {v}" for k, v in row.items()) + ")" for row in rows
    ]
    kept, array = [quoted(c) for c in keep], f"array({', '.join(structs)})"
    if projected:
        return df.selectExpr(*kept, f"{array} AS {ROWS}").selectExpr(*kept, f"inline_outer({ROWS})")
    return df.selectExpr(*kept, f"inline({array})")
