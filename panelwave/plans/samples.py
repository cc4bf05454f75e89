"""The two analysis samples and the cohorts drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions import recode as rc
from panelwave.functions.nullsafe import fill_const, null_if
from panelwave.operators import history as hs
from panelwave.operators.cohort import build_cohorts
from panelwave.operators.medians import filter_below_k_median

# Fixed values of the two samples: waves kept (both ends excluded), last wave of the
# index in the first one, the wave whose drug answer is backfilled and its source.
SAMPLE_ONE_WAVES = (3, 18)
SAMPLE_TWO_WAVES = (3, 23)
SAMPLE_ONE_INDEX = {w: v for w, v in rc.PRICE_INDEX.items() if w <= 17}
DRUGS_BACKFILL = (4, 5)

# Fixed values of the cohort design.
BASELINES = (4, 8, 12, 16)
HORIZON = 3

# Covariates taken at baseline, with the name they get.
COHORT_COVARIATES = {
    "industry_nas": "industry_nas",
    "union": "union",
    "wages_nas": "wages_t0",
    "psector": "psector",
    "region": "region",
    "married": "married",
    "edyears": "edyears",
    "enrolled": "enrolled",
    "urban_nas": "urban_nas",
    "drugs": "drugs",
    "age": "age",
    "cog_ability": "cog_ability",
    "stopped80": "stopped80",
    "charged80": "charged80",
    "probation80": "probation80",
    "convicted80": "convicted80",
    "total_weeks_worked": "total_weeks_worked",
    "welfare_indicator": "welfare_indicator",
    "employed": "employed",
    "unemployed": "unemployed",
    "military": "military",
    "weeks_worked": "weeks_worked",
    "black": "black",
    "hispanic": "hispanic",
    "pov_status": "pov_status",
    "income_current_y_nas": "income_current_y_nas",
    "income_past_year_nas": "income_past_year_nas",
}


def fill_drugs(df: DataFrame, *more: str) -> DataFrame:
    """Forward fill within the person, then backfill the first wave of the sample."""
    return hs.backfill_from(hs.ffill(df, ["drugs", *more]), "drugs", *DRUGS_BACKFILL)


def sample_one(panel: DataFrame) -> DataFrame:
    """Men outside the military with a plausible wage, waves 4 to 17, logs and real wages."""
    low, high = SAMPLE_ONE_WAVES
    kept = filter_below_k_median(
        panel,
        "wages",
        where=f"female = 0 AND military = 0 AND wave > {low} AND wave < {high}",
    )
    derived = kept.withColumns(
        {
            "log_age": F.expr("ln(age)"),
            "education10": F.expr("edyears * 10"),
            "log_weeks": F.expr(rc.log_shifted("lag_weeks_worked")),
            "cog_ability": F.expr("cog_ability / 100"),
            "wages_deflated": F.expr(rc.deflate("wages", "wave", SAMPLE_ONE_INDEX)),
        }
    ).withColumn("log_wages", F.expr(rc.log_scaled("wages_deflated", 100)))
    return fill_drugs(derived)


def real_amounts(df: DataFrame) -> DataFrame:
    """Deflated wages and incomes with negatives nulled out, their logs, and copies
    with null coded as 0. A wave outside the index keeps nominal wages but no income."""
    wages = rc.deflate("wages", "wave", otherwise="nominal")
    current = rc.deflate("income_current_y", "wave")
    past = rc.deflate("income_past_year", "wave")
    real = df.withColumns(
        {
            "wages_deflated": F.expr(null_if(f"{wages} < 0", wages)),
            "income_current_y_d": F.expr(null_if(f"{current} < 0", current)),
            "income_past_year_d": F.expr(null_if(f"{past} < 0", past)),
        }
    )
    return real.withColumns(
        {
            **{
                c: F.expr(null_if(f"{c} < 0", c))
                for c in ("wages", "income_current_y", "income_past_year")
            },
            "log_wages": F.expr(rc.log_shifted("wages_deflated")),
            "log_income_current_y": F.expr(rc.log_shifted("income_current_y_d")),
            "log_income_past_y": F.expr(rc.log_shifted("income_past_year_d")),
            "wages_nas": F.expr(fill_const("wages_deflated", "0D")),
            "income_current_y_nas": F.expr(fill_const("income_current_y_d", "0D")),
            "income_past_year_nas": F.expr(fill_const("income_past_year_d", "0D")),
        }
    )


def sample_two(panel: DataFrame) -> DataFrame:
    """Men, waves 4 to 22, with real wages and incomes and null-coded copies.

    No early-exposure correction is made: it would apply to a wave that the sample
    does not contain.
    """
    low, high = SAMPLE_TWO_WAVES
    kept = panel.where(f"female = 0 AND wave > {low} AND wave < {high}")
    derived = real_amounts(kept).withColumns(
        {
            "log_age": F.expr("ln(age)"),
            "log_weeks": F.expr(rc.log_shifted("lag_weeks_worked")),
            "cog_ability": F.expr("cog_ability / 100"),
            "industry_nas": F.expr(fill_const("industry", 0)),
            "pov_status": F.expr(fill_const("pov_status", 0)),
            "urban_nas": F.expr(fill_const("urban", 2)),
        }
    )
    return fill_drugs(derived, "psector")


def cohorts(
    sample: DataFrame, history: DataFrame, baselines: Sequence[int] = BASELINES
) -> DataFrame:
    """The stacked cohorts of the second sample: outcome log wages, 27 covariates."""
    return build_cohorts(
        sample, history, "log_wages", COHORT_COVARIATES, baselines, HORIZON
    )
