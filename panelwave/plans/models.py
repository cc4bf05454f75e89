"""The regression specifications fitted to the samples and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelwave.operators.linear import Design, design

OUTCOME = "log_wages"
PERSON = "caseid"

# Terms of the regressions on the first sample.
WAGE_TERMS = (
    "incarcerated", "ever_inc", "married", "log_age", "edyears", "lag_weeks_worked",
    "enrolled", "urban", "drugs", "union", "psector",
)
WAGE_TERMS_REPORTED = (
    *WAGE_TERMS, "cog_ability", "charged80", "incarcerated80", "black", "hispanic",
)
WITHIN_TERMS = (*WAGE_TERMS, "year")

# Covariates shared by the regressions on the second sample and the cohorts.
COVARIATES = (
    "union", "psector", "married", "edyears", "enrolled", "drugs", "age", "cog_ability",
    "stopped80", "charged80", "probation80", "convicted80", "total_weeks_worked",
    "welfare_indicator", "employed", "unemployed", "military", "weeks_worked", "black",
    "hispanic", "pov_status",
)
NAIVE_TERMS = (
    "ever_inc", "incarcerated", *COVARIATES, "urban", "income_current_y", "income_past_year", "year",
)
COHORT_TERMS = (
    "treatment", *COVARIATES, "urban_nas", "income_current_y_nas", "income_past_year_nas", "wages_t0",
)

# Levels of the categorical columns; known, so no pass is spent on finding them.
REGIONS = [1, 2, 3, 4]
INDUSTRIES = [1, 2, 3, 4, 5, 6]


def wage_design(sample: DataFrame) -> Design:
    return design(sample, OUTCOME, WAGE_TERMS, ["region"], [PERSON], {"region": REGIONS})


def wage_design_reported(sample: DataFrame) -> Design:
    levels = {"region": REGIONS, "industry": INDUSTRIES}
    return design(sample, OUTCOME, WAGE_TERMS_REPORTED, ["region", "industry"], [PERSON], levels)


def within_design(sample: DataFrame) -> Design:
    levels = {"region": REGIONS, "industry": INDUSTRIES}
    return design(sample, OUTCOME, WITHIN_TERMS, ["region", "industry"], [PERSON], levels)


def naive_design(sample: DataFrame) -> Design:
    return design(sample, OUTCOME, NAIVE_TERMS, ["region"], [PERSON], {"region": REGIONS})


def cohort_design(cohort: DataFrame) -> Design:
    return design(cohort, OUTCOME, COHORT_TERMS, ["region"], [PERSON, "bl"], {"region": REGIONS})


# Covariates of the propensity and outcome models: the regression's and the baseline wave.
EFFECT_TERMS = (*COHORT_TERMS[1:], "bl")


def effect_design(cohort: DataFrame) -> Design:
    """Covariates as terms, the region as a factor; the treatment is kept beside them."""
    return design(cohort, OUTCOME, EFFECT_TERMS, ["region"], [PERSON, "treatment"], {"region": REGIONS})
