"""Missing-value rules.

Survey recodes use three-valued logic: a flag computed from a missing answer is
itself missing. Spark's ``CASE WHEN`` sends a null condition to the ELSE branch,
so every flag goes through :func:`if3`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Refused, don't know, invalid skip, valid skip, non-interview.
SENTINELS = (-1, -2, -3, -4, -5)
NON_INTERVIEW = -5


def quoted(name: str) -> str:
    """Backtick a column name, so dots in survey names are not struct access."""
    return "`" + name.replace("`", "``") + "`"


def number(value: float | int | None) -> str:
    """A number as SQL text; doubles keep every digit."""
    if value is None:
        return "NULL"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def if3(cond: str, yes, no) -> str:
    """``yes`` / ``no`` by ``cond``; null where ``cond`` is null."""
    return f"CASE WHEN {cond} THEN {yes} WHEN NOT ({cond}) THEN {no} END"


def among(value: str, codes: Sequence) -> str:
    return f"{value} IN ({', '.join(str(c) for c in codes)})"


def null_sentinel(value: str, codes: Sequence[int] = SENTINELS) -> str:
    """``value`` with the missing-answer codes turned into null."""
    return f"CASE WHEN NOT ({among(value, codes)}) THEN {value} END"


def null_sentinels(
    df: DataFrame, codes: Sequence[int] = SENTINELS, cols: Sequence[str] | None = None
) -> DataFrame:
    """:func:`null_sentinel` on ``cols`` (default: every column), in one projection."""
    chosen = set(df.columns if cols is None else cols)
    return df.selectExpr(
        *[
            f"{null_sentinel(quoted(c), codes)} AS {quoted(c)}" if c in chosen else quoted(c)
            for c in df.columns
        ]
    )


def flag_sentinel(value: str, code: int = NON_INTERVIEW) -> str:
    """1 where the raw answer is ``code``, 0 for any other answer, null if absent."""
    return if3(f"{value} = {code}", 1, 0)


def fill_const(value: str, constant) -> str:
    return f"coalesce({value}, {constant})"


def fill_if_observed(value: str, witness: str, constant=0) -> str:
    """Replace null by ``constant``, but only where ``witness`` was answered."""
    return (
        f"CASE WHEN {value} IS NULL AND {witness} IS NOT NULL THEN {constant} ELSE {value} END"
    )


def null_if(cond: str, value: str) -> str:
    """Null ``value`` out where ``cond`` holds or is unknown."""
    return f"CASE WHEN NOT ({cond}) THEN {value} END"


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise ``ValueError`` if a key repeats; returns ``df`` unchanged.

    The count combines on the map side, so a key holding many rows still reaches
    the shuffle as one record per task.
    """
    repeated = df.groupBy(*[quoted(k) for k in keys]).count().where("count > 1")
    first = repeated.take(1)
    if first:
        raise ValueError(f"key {tuple(keys)} is not unique, e.g. {first[0].asDict()}")
    return df
