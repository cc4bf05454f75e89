"""Tables behind the diagnostic plots; all are aggregates, none collects rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.operators.medians import quantiles


def binned(df: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """Count, mean and spread of ``y`` in equal-width bins of ``x``.

    Bin 0 holds what lies below ``low`` and bin ``bins + 1`` what lies at or above ``high``.
    """
    return (
        df.selectExpr(
            f"CAST(width_bucket({x}, {low}D, {high}D, {bins}) AS INT) AS bin", f"{y} AS v"
        )
        .groupBy("bin")
        .agg(
            F.count("*").alias("n"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("sd"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
        )
    )


def residual_by_fitted(scored: DataFrame, low: float, high: float, bins: int = 20) -> DataFrame:
    return binned(scored, "fitted", "residual", low, high, bins)


def residual_by_observed(scored: DataFrame, low: float, high: float, bins: int = 20) -> DataFrame:
    """The observed value is fitted plus residual."""
    return binned(scored, "fitted + residual", "residual", low, high, bins)


def quantile_table(
    df: DataFrame, value: str, shares: Sequence[float], groups: dict[str, str]
) -> DataFrame:
    """Exact quantiles of ``value``, one row per named condition and share."""
    rows = [
        (name, float(share), found)
        for name, values in quantiles(df, value, shares, groups).items()
        for share, found in zip(shares, values)
    ]
    return df.sparkSession.createDataFrame(rows, "part string, share double, value double")


def support_table(scored: DataFrame, t: str) -> DataFrame:
    """Rows kept and dropped by common support, by arm, with their spread of predictions."""
    return scored.groupBy(t, "supported").agg(
        F.count("*").alias("n"),
        F.expr(f"avg(CASE WHEN {t} = 1 THEN sd1 ELSE sd0 END)").alias("sd_factual"),
        F.expr(f"avg(CASE WHEN {t} = 1 THEN sd0 ELSE sd1 END)").alias("sd_counterfactual"),
    )
