"""Finding survey columns by name and reading stem and number out of the name.

The schema is known on the driver, so this is settled before the plan exists and
costs nothing at run time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelwave.functions.nullsafe import quoted


def with_prefix(columns: Sequence[str], *prefixes: str) -> list[str]:
    """Columns starting with a prefix, any case; all of one prefix before the next."""
    found: list[str] = []
    for prefix in prefixes:
        found += [
            c for c in columns if c.lower().startswith(prefix.lower()) and c not in found
        ]
    return found


def containing(columns: Sequence[str], text: str) -> list[str]:
    return [c for c in columns if text.lower() in c.lower()]


def select_prefix(df: DataFrame, *prefixes: str, keep: Sequence[str] = ()) -> DataFrame:
    names = [*keep, *[c for c in with_prefix(df.columns, *prefixes) if c not in keep]]
    return df.select(*[quoted(c) for c in names])


def select_contains(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    names = [*keep, *[c for c in containing(df.columns, text) if c not in keep]]
    return df.select(*[quoted(c) for c in names])


def drop_like(
    df: DataFrame,
    names: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    contains: Sequence[str] = (),
) -> DataFrame:
    """Drop columns by exact name, by prefix or by substring (the last two in any case)."""
    gone = set(names) | set(with_prefix(df.columns, *prefixes))
    for text in contains:
        gone |= set(containing(df.columns, text))
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def snake_name(name: str) -> str:
    """Name usable without backticks: dots and dashes become underscores, lower case."""
    return name.replace(".", "_").replace("-", "_").lower()


def snake_names(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"{quoted(c)} AS {quoted(snake_name(c))}" for c in df.columns])


def unique_headers(header: Sequence[str]) -> list[str]:
    """Column names of a survey file.

    Anything but letters, digits, dot and underscore becomes a dot, a name cannot
    start with a digit, and repeats get ``.1``, ``.2``, ... by order of appearance
    (numbers taken by another header are passed over).
    """
    base = []
    for raw in header:
        name = re.sub(r"[^A-Za-z0-9._]", ".", raw.strip().strip('"'))
        base.append(name if name[:1].isalpha() or name[:1] == "." else "X" + name)
    taken = set(base)
    repeats: dict[str, int] = {}
    names = []
    for name in base:
        if name not in repeats:
            repeats[name] = 0
            names.append(name)
            continue
        count = repeats[name] + 1
        while f"{name}.{count}" in taken:
            count += 1
        repeats[name] = count
        taken.add(f"{name}.{count}")
        names.append(f"{name}.{count}")
    return names


@dataclass(frozen=True)
class NameRule:
    """How a topic finds its columns and reads their names.

    ``edits`` are literal replacements (every occurrence, in order). The edited name
    is split on ``seps[0]``: the first piece is the stem, the second holds the number.
    A second separator splits that piece again and the number is its first part.
    Pieces beyond those are ignored.
    """

    prefixes: tuple[str, ...] = ()
    contains: str | None = None
    edits: tuple[tuple[str, str], ...] = ()
    seps: tuple[str, ...] = (".",)

    def columns(self, names: Sequence[str], key: str) -> list[str]:
        found = (
            with_prefix(names, *self.prefixes)
            if self.contains is None
            else containing(names, self.contains)
        )
        return [c for c in found if c != key]

    def parse(self, name: str) -> tuple[str, float | None]:
        for old, new in self.edits:
            name = name.replace(old, new)
        pieces = name.split(self.seps[0])
        number = pieces[1] if len(pieces) > 1 else None
        if number is not None and len(self.seps) > 1:
            number = number.split(self.seps[1])[0]
        return pieces[0], to_number(number)


def to_number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


@dataclass(frozen=True)
class Source:
    """One survey column: its stem, the number in its name and its file order."""

    column: str
    stem: str
    number: float | None
    pos: int


def parse_names(columns: Sequence[str], rule: NameRule, key: str) -> list[Source]:
    return [
        Source(column, *rule.parse(column), pos)
        for pos, column in enumerate(rule.columns(columns, key))
    ]
