"""The assembled person x wave panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelwave.functions.waves import year_to_wave
from panelwave.operators.inrow import emit_rows, null_of
from panelwave.operators.joins import natural_left
from panelwave.operators.medians import cap_above_median, global_median
from panelwave.plans import topics as tp
from panelwave.sources.shared import saved

PANEL_COLUMNS = (
    "caseid", "wave", "age", "incarcerated", "ever_inc", "wages", "wages_lead", "drugs",
    "psector", "industry", "region", "year", "union", "married", "weeks_worked",
    "total_weeks_worked", "lag_weeks_worked", "edyears", "enrolled", "urban",
    "income_past_year", "income_current_y", "pov_status", "welfare", "welfare_indicator",
    "employed", "unemployed", "military", *tp.STATIC_VARIABLES,
)

WELFARE_CAP = 5


def welfare_median(wide: DataFrame, id_col: str = "CASEID") -> float | None:
    """Median of the amounts received, over all persons and years."""
    amounts = tp.topic_table(wide, tp.WELFARE, id_col)
    return global_median(amounts, "welfare", where="welfare_indicator = 1")


def welfare_table(wide: DataFrame, id_col: str = "CASEID") -> DataFrame:
    """The welfare topic, keyed by person and year, with outliers nulled out."""
    median = welfare_median(wide, id_col)
    return tp.topic_table(wide, tp.WELFARE, id_col).selectExpr(
        tp.KEY,
        "year",
        f"{cap_above_median('welfare', median, WELFARE_CAP)} AS welfare",
        "welfare_indicator",
    )


def build_panel(
    wide: DataFrame,
    id_col: str = "CASEID",
    columns: Sequence[str] | None = None,
    drugs_fixed: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """The panel, one row per person and age wave, in a single narrow pass.

    Every topic lives on the person's own wide row, so the panel is emitted from it
    directly instead of melting each topic and joining the results: no shuffle and
    one scan, plus one pass over the welfare columns for their median. Only the
    topics behind ``columns`` are read. Topics must not repeat a wave; a survey whose
    names do repeat one needs :func:`join_panel`, which multiplies rows as joins do.

    With ``parts`` the survey's rows are dealt over as many partitions by the person and sorted
    first, so that the panel comes out dealt and in order: as many bytes as a wide row has move, not
    those of its rows in the panel, and it can be written in buckets without another exchange.
    """
    wanted = list(PANEL_COLUMNS if columns is None else columns)
    static = [c for c in tp.STATIC_VARIABLES if c in wanted]
    joined = [tp.DRUGS_FIXED if t is tp.DRUGS and drugs_fixed else t for t in tp.JOINED_TOPICS]
    used = [t for t in joined if any(v in wanted for v in t.variables)]
    if tp.WELFARE in used and tp.UNION not in used:
        used.append(tp.UNION)  # it carries the year that welfare is keyed by
    dealt = wide if parts is None else wide.repartition(parts, id_col).sortWithinPartitions(id_col)
    staged = tp.stage_topics(dealt, [tp.AGE, *used], id_col, static)

    by_wave = {t.name: keyed_once(t, staged) for t in [tp.AGE, *used]}
    years = {
        wave: year
        for year, wave in ((at, year_to_wave(at)) for at, _ in staged.rows.get(tp.UNION.name, []) if at is not None)
    }
    cap = welfare_median(wide, id_col) if "welfare" in wanted else None

    rows: list[dict[str, str]] = []
    for wave in by_wave[tp.AGE.name]:
        row = {"wave": str(int(wave)), "age": by_wave[tp.AGE.name][wave]["age"]}
        for topic in used:
            at = years.get(wave) if topic is tp.WELFARE else wave
            found = by_wave[topic.name].get(at, {})
            for var, dtype in topic.variables.items():
                row[var] = found[var] if var in found else null_of(dtype)
            if topic is tp.UNION:
                row["year"] = str(int(years[wave])) if wave in years else null_of("int")
            if topic is tp.WELFARE and "welfare" in wanted:
                row["welfare"] = cap_above_median(row["welfare"], cap, WELFARE_CAP)
        rows.append({k: v for k, v in row.items() if k in wanted})
    return emit_rows(staged.df, [tp.KEY, *static], rows, projected=True).select(*wanted)


def keyed_once(topic: tp.Topic, staged: tp.Staged) -> dict[float, dict[str, str]]:
    """Values by wave (by year for welfare); a repeated or unknown one is an error."""
    placed: dict[float, dict[str, str]] = {}
    for at, values in staged.rows[topic.name]:
        if at is None:
            raise ValueError(f"{topic.name}: a column's name does not tell its wave; use join_panel")
        at = year_to_wave(at) if topic is tp.UNION else at
        if at in placed:
            raise ValueError(f"{topic.name}: wave {at} comes twice; use join_panel")
        placed[at] = values
    return placed


def join_panel(wide: DataFrame, id_col: str = "CASEID", drugs_fixed: bool = False) -> DataFrame:
    """The panel as a chain of left joins of the topic tables.

    Same rows as :func:`build_panel`; needed where a topic repeats a wave or a name does
    not tell it. Welfare joins on person and year, the static table on the person, all
    others on person and wave; an unknown wave or year matches an unknown one.
    Each table is written first, so that the driver plans joins of narrow tables and not of the
    projections of some 480 columns behind every one of them. All have rows for every person, and
    as files of a few distinct values they look far smaller than in memory: they are merged, since
    the driver would have to hold each one that is broadcast, all at once. The joins on other columns
    than person and wave come first, that of the year after the topic that carries it: each deals all
    rows anew, which are narrow by then, and not yet multiplied by what repeats in the other topics.
    """
    rights = {}
    for topic in tp.JOINED_TOPICS:
        if topic is tp.WELFARE:
            rights[topic.name] = welfare_table(wide, id_col)
        else:
            chosen = tp.DRUGS_FIXED if topic is tp.DRUGS and drugs_fixed else topic
            rights[topic.name] = tp.topic_table(wide, chosen, id_col)
    first = saved(tp.topic_table(wide, tp.AGE, id_col), "topic")
    dealing = [rights.pop(tp.UNION.name), rights.pop(tp.WELFARE.name), tp.static_table(wide, id_col)]
    others = [saved(t, "topic").hint("merge") for t in [*dealing, *rights.values()]]
    panel = natural_left(first, *others, null_safe=True)
    return panel.select(*PANEL_COLUMNS)
