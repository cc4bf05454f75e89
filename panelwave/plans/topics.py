"""The survey topics: which columns, which wave, which recode.

A topic is declared once and used twice, as a long table of its own
(:func:`topic_table`) and inside the assembled panel (``panelwave.plans.panel``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from panelwave.functions import recode as rc
from panelwave.functions import waves as wv
from panelwave.functions.nullsafe import (
    NON_INTERVIEW,
    fill_const,
    fill_if_observed,
    flag_sentinel,
    null_sentinel,
    number,
    quoted,
)
from panelwave.operators import inrow
from panelwave.operators.inrow import null_of
from panelwave.sources.names import NameRule, Source, parse_names

KEY = "caseid"
LEFT_OUT = "left out"


def suffix_wave(source: Source) -> float | None:
    """Wave from the number in the name; a name without one is wave 0."""
    return source.number or 0


def shifted(table: Mapping[str, int]) -> Callable[[Source], float | None]:
    return lambda source: suffix_wave(source) + table.get(source.stem, 0)


def as_type(value: str, dtype: str) -> str:
    return f"CAST({value} AS {dtype})"


def as_int(name: str):
    return lambda source, value: {name: as_type(value, "int")}


def as_double(name: str):
    return lambda source, value: {name: as_type(value, "double")}


@dataclass(frozen=True)
class Topic:
    """One topic of the survey.

    ``at`` gives the wave (or year) of a source column, ``None`` where its name does not say and
    ``LEFT_OUT`` where the topic does not want it.
    ``recode`` turns one answer into named values. ``merge`` joins the answers that
    share a wave: ``"any"`` flags a positive sum, ``"spread"`` lets every stem fill
    its own variable. ``sequence`` gets each variable as a list over the waves, and the
    ``person`` values: one expression each over all of a person's answers.
    """

    name: str
    rule: NameRule
    variables: Mapping[str, str]
    recode: Callable[[Source, str], dict[str, str]]
    at: Callable[[Source], float | None] = suffix_wave
    key: str = "wave"
    merge: str | None = None
    sequence: Callable[[dict[str, list[str]], dict[str, str]], dict[str, list[str]]] | None = None
    person: Callable[[dict[str, list[str]]], dict[str, str]] | None = None
    raw: bool = False


def school_at(source: Source) -> float | None:
    if source.stem == "edyears":
        return wv.school_wave(suffix_wave(source))
    if source.number is None:
        return None
    return wv.school_wave(wv.full_year(source.number))


def school_recode(source: Source, value: str) -> dict[str, str]:
    if source.stem == "edyears":
        return {"edyears": as_type(value, "int")}
    return {"enrolled": rc.flag_in(value, (2, 3))}


def employment_at(source: Source) -> float | None:
    wave = suffix_wave(source)
    return wv.EMPLOYMENT_MOVES.get(wave, wave)


def employment_recode(source: Source, value: str) -> dict[str, str]:
    return {
        "employed": rc.flag_in(value, (1, 2)),
        "unemployed": rc.flag_equal(value, 3),
        "military": rc.flag_equal(value, 8),
    }


# The answer that means public sector, by name stem.
PUBLIC_SECTOR_CODE = {"CP": 2, "QE": 1}


def psector_recode(source: Source, value: str) -> dict[str, str]:
    code = PUBLIC_SECTOR_CODE.get(source.stem)
    return {"psector": "0" if code is None else fill_const(rc.flag_equal(value, code), 0)}


def industry_at(source: Source) -> float | str:
    wave = suffix_wave(source)
    late = source.stem == "INDALL" and wave > 14
    return wave if late or source.stem == "CPSIND70" else LEFT_OUT


def drugs_at(fixed: bool) -> Callable[[Source], float | None]:
    return lambda source: wv.drug_wave(source.stem, int(suffix_wave(source)), fixed)


def lead_into(name: str, new: str):
    return lambda series, person: {**series, new: inrow.lead1(series[name])}


def exposure_person(series: dict[str, list[str]]) -> dict[str, str]:
    return {"first": inrow.first_exposed(series["incarcerated"])}


def exposure_sequence(series, person) -> dict[str, list[str]]:
    status = series["incarcerated"]
    return {**series, "ever_inc": inrow.exposure_history(status, person["first"])}


def work_person(series: dict[str, list[str]]) -> dict[str, str]:
    return {"totals": inrow.running_totals(series["weeks_worked"])}


def work_sequence(series, person) -> dict[str, list[str]]:
    totals = inrow.running_total(person["totals"], len(series["weeks_worked"]))
    return {**series, "total_weeks_worked": totals, "lag_weeks_worked": inrow.lag1(totals)}


def welfare_recode(source: Source, value: str) -> dict[str, str]:
    amount = fill_const(as_type(value, "double"), "0D")
    return {"welfare": amount, "welfare_indicator": rc.flag_at_least(amount, 1)}


# Prefixes, literal name edits and separators of the survey names.
NON_INTERVIEWED = Topic(
    "non_interview",
    NameRule(("URBAN",), edits=(("URBAN.", ""),)),
    {"non_interview": "int"},
    lambda source, value: {"non_interview": flag_sentinel(value, NON_INTERVIEW)},
    raw=True,
)
AGE = Topic("age", NameRule(("AGEATIN",)), {"age": "int"}, as_int("age"))
INCARCERATION = Topic(
    "incarceration",
    NameRule(("hh1",), edits=(("H1.", ""),)),
    {"incarcerated": "int", "ever_inc": "int"},
    lambda source, value: {"incarcerated": fill_const(rc.flag_equal(value, 5), 0)},
    sequence=exposure_sequence,
    person=exposure_person,
)
WAGES = Topic(
    "wages",
    NameRule(("HRP1",)),
    {"wages": "double", "wages_lead": "double"},
    as_double("wages"),
    sequence=lead_into("wages", "wages_lead"),
)
DRUGS = Topic(
    "drugs",
    NameRule(("DS", "DRUG"), edits=(("S.", ""),)),
    {"drugs": "int"},
    as_double("drugs"),
    at=drugs_at(fixed=False),
    merge="any",
)
DRUGS_FIXED = Topic(
    "drugs_fixed", DRUGS.rule, DRUGS.variables, DRUGS.recode, at=drugs_at(fixed=True), merge="any"
)
PSECTOR = Topic(
    "psector",
    NameRule(contains="QES.56C", edits=(("S.QES.56C", ""), ("S.56C.01", ""))),
    {"psector": "int"},
    psector_recode,
    at=shifted(wv.PSECTOR_SHIFT),
)
INDUSTRY = Topic(
    "industry",
    NameRule(("INDALL.EMP", "CPSIND70"), edits=((".EMP.01", ""),)),
    {"industry": "int"},
    lambda source, value: {"industry": rc.bin_ranges(value)},
    at=industry_at,
)
REGION = Topic("region", NameRule(("REGION",)), {"region": "int"}, as_int("region"))
UNION = Topic(
    "union",
    NameRule(("EMPLOYERS_ALL_UNION",), edits=(("S_ALL_UNION", ""),), seps=("_", ".")),
    {"year": "int", "union": "int"},
    as_double("union"),
    at=lambda source: source.number,
    key="year",
    merge="any",
)
MARRIAGE = Topic(
    "marriage",
    NameRule(("MARSTAT",), edits=(("T.KEY", ""),)),
    {"married": "int"},
    lambda source, value: {"married": rc.flag_equal(value, 1)},
)
WORK = Topic(
    "work",
    NameRule(("WKSWK",), edits=(("K.PCY", ""),)),
    {"weeks_worked": "double", "total_weeks_worked": "double", "lag_weeks_worked": "double"},
    as_double("weeks_worked"),
    sequence=work_sequence,
    person=work_person,
)
EDUCATION = Topic(
    "education",
    NameRule(("HGC", "ENROLLMTREV"), edits=(("HGC", "edyears"), ("TREV", "."))),
    {"edyears": "int", "enrolled": "int"},
    school_recode,
    at=school_at,
    merge="spread",
)
URBAN = Topic(
    "urban", NameRule(("URBAN",), edits=(("URBAN.", ""),)), {"urban": "int"}, as_int("urban")
)
INCOME = Topic(
    "income",
    NameRule(("Q13.5",), edits=(("3.5", ""),)),
    {"income_past_year": "double", "income_current_y": "double"},
    as_double("income_past_year"),
    at=shifted(wv.INCOME_SHIFT),
    sequence=lead_into("income_past_year", "income_current_y"),
)
POVERTY = Topic("poverty", NameRule(("POVSTATUS",)), {"pov_status": "int"}, as_int("pov_status"))
WELFARE = Topic(
    "welfare",
    NameRule(("WELFARE",), edits=((".AMT", ""),), seps=(".", "_")),
    {"welfare": "double", "welfare_indicator": "int"},
    welfare_recode,
    at=lambda source: source.number,
    key="year",
)
EMPLOYMENT = Topic(
    "employment",
    NameRule(contains="ESR_KEY"),
    {"employed": "int", "unemployed": "int", "military": "int"},
    employment_recode,
    at=employment_at,
)

# Right tables of the panel, in join order. The age topic is the left one.
JOINED_TOPICS = (
    INCARCERATION, WAGES, DRUGS, PSECTOR, INDUSTRY, REGION, UNION, MARRIAGE, WORK,
    EDUCATION, URBAN, INCOME, POVERTY, WELFARE, EMPLOYMENT,
)

# Person-level columns and the names they get.
STATIC_RENAMES = {
    "SAMPLE_RACE": "race",
    "POLICE.1": "stopped80",
    "POLICE.2": "charged80",
    "POLICE.3": "convicted80",
    "POLICE.6": "probation80",
}
STATIC_VARIABLES = (
    "race", "stopped80", "charged80", "convicted80", "probation80", "incarcerated80",
    "cog_ability", "black", "hispanic", "female",
)


class PersonColumns(dict):
    """Names of a topic's per-person columns."""

    def __init__(self, topic: str):
        super().__init__()
        self.topic = topic

    def __missing__(self, name: str) -> str:
        return quoted(f"{self.topic}|{name}")


@dataclass
class Staged:
    """A wide table with recoded columns, and each topic's values as expressions over it."""

    df: DataFrame
    rows: dict[str, list[tuple[float, dict[str, str]]]] = field(default_factory=dict)


def static_columns(id_value: Callable[[str], str]) -> dict[str, str]:
    """Person-level variables; ``id_value`` gives the cleaned answer of a survey name."""
    value = {new: as_type(id_value(old), "int") for old, new in STATIC_RENAMES.items()}
    stopped = value["stopped80"]
    jailed = rc.flag_equal(id_value("POLICE.7"), 1)
    value["incarcerated80"] = fill_if_observed(jailed, stopped)
    for name in ("charged80", "convicted80", "probation80"):
        value[name] = fill_if_observed(value[name], stopped)
    value["cog_ability"] = as_type(id_value("AFQT.1"), "double")
    value["black"] = rc.flag_equal(id_value("SAMPLE_RACE"), 2)
    value["hispanic"] = rc.flag_equal(id_value("SAMPLE_RACE"), 1)
    value["female"] = rc.flag_equal(id_value("SAMPLE_SEX"), 2)
    return {name: value[name] for name in STATIC_VARIABLES}


def stage_topics(
    wide: DataFrame, topics: Sequence[Topic], id_col: str = "CASEID", static: Sequence[str] = ()
) -> Staged:
    """Recode the topics' columns in place: two narrow projections over the wide rows.

    The first turns missing codes to null, the second recodes each answer and adds
    what a topic needs per person. Merges and sequences stay expressions over those
    columns and are evaluated where rows are emitted; another projection as wide as
    the survey would cost more than it saves.
    """
    names = [c for c in wide.columns if c != id_col]
    sources = {t.name: located(parse_names(names, t.rule, id_col), t) for t in topics}

    cleaned: dict[str, str] = {}
    for topic in topics:
        for _, source in sources[topic.name]:
            value = quoted(source.column)
            cleaned[clean_name(source.column, topic.raw)] = (
                value if topic.raw else null_sentinel(value)
            )
    if static:
        for name in (*STATIC_RENAMES, "SAMPLE_SEX", "AFQT.1", "POLICE.7"):
            cleaned[clean_name(name)] = null_sentinel(quoted(name))
    df = wide.selectExpr(f"{quoted(id_col)} AS {KEY}", *aliased(cleaned))

    recoded: dict[str, str] = {}
    layout: dict[str, list[tuple[float, dict[str, str]]]] = {}
    for topic in topics:
        layout[topic.name] = []
        for i, (at, source) in enumerate(sources[topic.name]):
            values = topic.recode(source, quoted(clean_name(source.column, topic.raw)))
            placed = {var: f"{topic.name}|{var}|{i}" for var in values}
            recoded.update({placed[var]: value for var, value in values.items()})
            layout[topic.name].append((at, placed))
        if topic.person is not None:
            cells = [values for _, values in layout[topic.name]]
            answers = {v: [recoded[c[v]] for c in cells] for v in (cells[0] if cells else {})}
            for name, value in topic.person(answers).items():
                recoded[f"{topic.name}|{name}"] = value
    statics = static_columns(lambda name: quoted(clean_name(name))) if static else {}
    recoded.update({name: statics[name] for name in static})
    df = df.selectExpr(KEY, *aliased(recoded))

    rows: dict[str, list[tuple[float, dict[str, str]]]] = {}
    for topic in topics:
        merged = merge_rows(topic, layout[topic.name])
        series = {var: [values.get(var) for _, values in merged] for var in topic_inputs(merged)}
        if topic.sequence is not None:
            series = topic.sequence(series, PersonColumns(topic.name))
        rows[topic.name] = [
            (at, {v: as_type(s[i], topic.variables[v]) for v, s in series.items() if s[i] is not None})
            for i, (at, _) in enumerate(merged)
        ]
    return Staged(df, rows)


def aliased(values: Mapping[str, str]) -> list[str]:
    return [f"{value} AS {quoted(name)}" for name, value in values.items()]


def clean_name(column: str, raw: bool = False) -> str:
    return f"raw:{column}" if raw else f"clean:{column}"


def located(sources: Sequence[Source], topic: Topic) -> list[tuple[float | None, Source]]:
    """Sources with their wave or year, in (wave, file order); those of unknown place come last."""
    placed = [(topic.at(s), s) for s in sources]
    return sorted(
        [(at, s) for at, s in placed if at != LEFT_OUT],
        key=lambda item: (item[0] is None, item[0] or 0, item[1].pos),
    )


def topic_inputs(rows: Sequence[tuple[float, dict[str, str]]]) -> list[str]:
    return list(dict.fromkeys(var for _, values in rows for var in values))


def merge_rows(
    topic: Topic, cells: Sequence[tuple[float, dict[str, str]]]
) -> list[tuple[float, dict[str, str]]]:
    """Rows of a topic from its cells, after the merge rule."""
    if topic.merge is None:
        return [(at, {v: quoted(n) for v, n in values.items()}) for at, values in cells]
    grouped: dict[float, dict[str, list[str]]] = {}
    for at, values in cells:
        slot = grouped.setdefault(at, {})
        for var, name in values.items():
            slot.setdefault(var, []).append(quoted(name))
    if topic.merge == "any":
        return [
            (at, {var: positive_sum(columns) for var, columns in slot.items()})
            for at, slot in grouped.items()
        ]
    for at, slot in grouped.items():
        for var, columns in slot.items():
            if len(columns) > 1:
                raise ValueError(f"{topic.name}: {len(columns)} columns of {var} share {at}")
    return [(at, {var: columns[0] for var, columns in slot.items()}) for at, slot in grouped.items()]


def positive_sum(values: Sequence[str]) -> str:
    return rc.flag_positive("(" + " + ".join(fill_const(v, 0) for v in values) + ")")


def number_literal(value: float | None, whole: bool) -> str:
    if value is None:
        return null_of("int" if whole else "double")
    return str(int(value)) if whole else number(float(value))


def topic_rows(
    topic: Topic, staged: Staged, variables: Sequence[str] | None = None
) -> list[dict[str, str]]:
    """Rows of the topic's long table, keyed by ``wave``, by ``year`` or by both."""
    wanted = [v for v in topic.variables if v != "year"] if variables is None else variables
    placed = staged.rows[topic.name]
    known = [at for at, _ in placed if at is not None]
    whole = all(float(at).is_integer() for at in known)
    whole_wave = all(float(wv.year_to_wave(at)).is_integer() for at in known)
    out = []
    for at, values in placed:
        row: dict[str, str] = {topic.key: number_literal(at, whole)}
        if topic is UNION:
            row["wave"] = number_literal(None if at is None else wv.year_to_wave(at), whole_wave)
        for var in wanted:
            row[var] = values[var] if var in values else null_of(topic.variables[var])
        out.append(row)
    return out


def topic_table(wide: DataFrame, topic: Topic, id_col: str = "CASEID") -> DataFrame:
    """The topic as a long table, one row per person and wave (or year).

    Columns whose names do not tell the wave keep their rows, with a null one.
    """
    staged = stage_topics(wide, [topic], id_col)
    return inrow.emit_rows(staged.df, [KEY], topic_rows(topic, staged))


def static_table(wide: DataFrame, id_col: str = "CASEID") -> DataFrame:
    """One row per person with the variables that do not change over the waves."""
    return stage_topics(wide, [], id_col, STATIC_VARIABLES).df
