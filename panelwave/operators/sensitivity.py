"""How strong an unmeasured confounder would have to be (omitted-variable bias bounds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelwave.functions.nullsafe import number
from panelwave.operators.linear import Fit

STRENGTHS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)


def sensitivity_grid(
    spark: SparkSession,
    fit: Fit,
    term: str,
    with_treatment: Sequence[float] = STRENGTHS,
    with_outcome: Sequence[float] = STRENGTHS,
) -> DataFrame:
    """Adjusted estimate for every pair of confounder strengths.

    Strengths are partial R squared of the confounder with the treatment
    (``r2_treatment``) and with the outcome (``r2_outcome``). The estimate moves
    towards zero by the bias they imply; ``adjusted_t`` uses the adjusted error.
    """
    estimate, se = fit.of(term)
    grid = spark.createDataFrame(
        [(float(d), float(y)) for d in with_treatment for y in with_outcome],
        "r2_treatment double, r2_outcome double",
    )
    est, err, df = number(float(estimate)), number(float(se)), number(float(fit.df))
    return grid.selectExpr(
        "*",
        f"{err} * sqrt({df}) * sqrt(r2_outcome * r2_treatment / (1 - r2_treatment)) AS bias",
        f"{err} * sqrt((1 - r2_outcome) / (1 - r2_treatment) * {df} / ({df} - 1)) AS adjusted_se",
    ).selectExpr(
        "r2_treatment",
        "r2_outcome",
        "bias",
        f"signum({est}) * (abs({est}) - bias) AS adjusted_estimate",
        "adjusted_se",
    ).selectExpr("*", "adjusted_estimate / adjusted_se AS adjusted_t")


def robustness_value(spark: SparkSession, fit: Fit, term: str, share: float = 1.0) -> DataFrame:
    """Equal strength on both sides that would remove ``share`` of the estimate."""
    estimate, se = fit.of(term)
    row = spark.createDataFrame(
        [(float(estimate), float(se), int(fit.df))], "estimate double, se double, df bigint"
    )
    return row.selectExpr(
        "*", "estimate / se AS t", f"{number(float(share))} * abs(estimate / se) / sqrt(df) AS f"
    ).selectExpr(
        "estimate", "se", "df", "t",
        "t * t / (t * t + df) AS partial_r2",
        "0.5D * (sqrt(f * f * f * f + 4 * f * f) - f * f) AS robustness_value",
    )
