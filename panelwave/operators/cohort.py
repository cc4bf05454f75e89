"""Cohorts: covariates at a baseline wave, treatment after it, outcome at the horizon."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import assert_unique, quoted
from panelwave.functions.recode import row_max
from panelwave.operators.history import value_ahead


def build_cohorts(
    sample: DataFrame,
    history: DataFrame,
    outcome: str,
    covariates: Mapping[str, str] | Sequence[str],
    baselines: Sequence[int],
    horizon: int = 3,
    exposed: str = "incarcerated",
    ever: str = "ever_inc",
    check_keys: bool = False,
) -> DataFrame:
    """One row per person and baseline wave, all baselines in one pass.

    At baseline *b* a person is left out who is exposed or was exposed before, or who
    is exposed at *b + horizon*. ``covariates`` (old name to new) come from the sample
    at *b*, ``treatment`` is the largest ``ever`` of ``history`` over the waves up to
    *b + horizon*, and the outcome is the sample's at *b + horizon*. Rows with a null
    anywhere, the exposures at all waves ahead included, or with a covariate or outcome that
    is not a number, are dropped.

    ``history`` may cover persons and waves that ``sample`` does not; both need unique
    (caseid, wave), which ``check_keys`` verifies. However many baselines there are, the sample is read once, looks
    ahead an exact number of waves in a window by person, and joins one row per person
    with the exposures at all waves needed. That row is an aggregate that combines on
    the map side, and both sides are partitioned by person, so a sample that comes out
    of another window by person is not shuffled again.
    """
    if check_keys:
        assert_unique(sample, ["caseid", "wave"])
        assert_unique(history, ["caseid", "wave"])
    names = dict(covariates) if isinstance(covariates, Mapping) else {c: c for c in covariates}
    starts = sorted(set(baselines))
    ends = {b + horizon for b in starts}
    ahead = sorted({b + k for b in starts for k in range(1, horizon + 1)})
    fields = ", ".join(f"{quoted(old)} AS {quoted(new)}" for old, new in names.items())
    floating = {f.name for f in sample.schema if f.dataType.typeName() in ("double", "float")}
    complete = " AND ".join(
        f"{quoted(old)} IS NOT NULL" + (f" AND NOT isnan({quoted(old)})" if old in floating else "")
        for old in names
    )

    used = sample.where(f"wave IN ({listed(set(starts) | ends)})").selectExpr(
        "caseid",
        "wave",
        f"CASE WHEN wave IN ({listed(starts)}) AND {complete} THEN struct({fields}) END AS covariates",
        f"CASE WHEN {exposed} = 1 OR {ever} = 1 THEN 1 ELSE 0 END AS tainted",
        f"CASE WHEN {exposed} = 1 THEN 1 ELSE 0 END AS exposed",
        f"CAST({outcome} AS DOUBLE) AS outcome",
    )
    started = used.select(
        "caseid",
        "wave",
        "covariates",
        "tainted",
        value_ahead("exposed", horizon).alias("exposed_end"),
        value_ahead("outcome", horizon).alias("outcome_end"),
    ).where(
        "covariates IS NOT NULL AND tainted = 0 AND coalesce(exposed_end, 0) = 0"
        " AND outcome_end IS NOT NULL AND NOT isnan(outcome_end)"
    )
    exposures = (
        history.where(f"wave IN ({listed(ahead)})")
        .groupBy("caseid")
        # a wave counts only if the exposure itself was observed there, too
        .agg(
            *[
                F.expr(f"max(CASE WHEN wave = {w} AND {exposed} IS NOT NULL THEN {ever} END)").alias(f"ever_{w}")
                for w in ahead
            ]
        )
    )
    by_start = {
        k: "CASE wave " + " ".join(f"WHEN {b} THEN ever_{b + k}" for b in starts) + " END"
        for k in range(1, horizon + 1)
    }
    followed = started.join(exposures, "caseid").selectExpr(
        "caseid", "wave", "covariates", "outcome_end",
        *[f"{expr} AS after_{k}" for k, expr in by_start.items()],
    )
    after = [f"after_{k}" for k in by_start]
    return followed.where(" AND ".join(f"{a} IS NOT NULL" for a in after)).selectExpr(
        "wave AS bl",
        "caseid",
        f"{row_max(*after) if horizon > 1 else after[0]} AS treatment",
        f"outcome_end AS {quoted(outcome)}",
        "covariates.*",
    )


def listed(waves) -> str:
    return ", ".join(str(w) for w in sorted(waves))


def difference_in_means(cohort: DataFrame, outcome: str) -> DataFrame:
    """Mean outcome by treatment over all baselines, and their difference."""
    return cohort.agg(
        F.count(F.when(F.col("treatment") == 1, 1)).alias("n_treated"),
        F.count(F.when(F.col("treatment") == 0, 1)).alias("n_control"),
        F.avg(F.when(F.col("treatment") == 1, F.col(outcome))).alias("mean_treated"),
        F.avg(F.when(F.col("treatment") == 0, F.col(outcome))).alias("mean_control"),
    ).withColumn("difference", F.expr("mean_treated - mean_control"))
