"""Cross-fitted propensities and outcome surfaces from weighted cross-products.

The propensity is a logistic fit by a fixed number of Newton steps, each of them one pass that
returns the weighted cross-products of all folds' models; the outcome has a least-squares surface
per arm. Both are ridge fits on standardised covariates, so that folds with few rows, collinear
terms or perfectly separated arms still have one finite answer. Folds follow the person's number,
and every figure can be repeated in SQL. Only p x p numbers of each model reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import number, quoted
from panelwave.operators.effects import CLIP, clipped_propensity
from panelwave.operators.linear import Design
from panelwave.operators.moments import Moments, moments, moments_by

RIDGE = 0.01  # penalty per row on standardised slopes
STEPS = 8
LEAST_WEIGHT = 1e-10
PRIME, FACTOR = 10007, 7919  # spread the persons' numbers over folds
CONSTANT = 1e-9  # spread, against the mean, below which a term does not vary


@dataclass
class Ridge:
    """A penalised least-squares fit: intercept, slopes, and what the spread of a prediction needs."""

    intercept: float
    slopes: np.ndarray
    centre: np.ndarray
    inverse: np.ndarray
    variance: float
    n: float


def ridge_of(m: Moments, ridge: float = RIDGE) -> Ridge:
    """Fit of the last variable on the others; the intercept is not penalised.

    The residual variance has the effective number of terms, the trace of the fit's projection,
    taken off its rows; it is NaN where none are left.
    """
    p = len(m.mean) - 1
    penalty = ridge * m.n
    a = m.cross[:p, :p] + penalty * np.eye(p)
    inverse = np.linalg.inv(a)
    slopes = inverse @ m.cross[:p, p]
    rss = m.cross[p, p] - 2 * slopes @ m.cross[:p, p] + slopes @ m.cross[:p, :p] @ slopes
    left = m.n - 1 - p + penalty * np.trace(inverse)
    variance = max(rss, 0.0) / left if left > 1e-9 else float("nan")
    return Ridge(float(m.mean[p] - slopes @ m.mean[:p]), slopes, m.mean[:p], inverse, variance, m.n)


def integer_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Add ``fold`` from a whole-numbered person; the same for all rows of a person.

    The number is spread by a multiplication modulo a prime first, as numbers in use may share a factor.
    """
    spread = f"pmod(pmod(CAST({quoted(group)} AS BIGINT), {PRIME}) * {FACTOR}, {PRIME})"
    return df.withColumn("fold", F.expr(f"CAST({spread} % {folds} AS INT)"))


def standardised(d: Design, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame with every term less its mean and over its standard deviation (0 if that is 0 but for rounding)."""
    m = moments(d.df, d.terms)
    sd = np.sqrt(np.diag(m.cross) / m.n)
    names = [f"z{i}" for i in range(len(d.terms))]
    scaled = [
        f"({quoted(x)} - {number(float(c))}) / {number(float(s))} AS {z}" if s > CONSTANT * (1 + abs(c)) else f"0D AS {z}"
        for x, z, c, s in zip(d.terms, names, m.mean, sd)
    ]
    return d.df.selectExpr(*map(quoted, keep), f"{quoted(d.y)} AS y", *scaled), names


def _linear(fit: tuple[float, np.ndarray], names: list[str]) -> str:
    intercept, slopes = fit
    return " + ".join([number(float(intercept)), *(f"{number(float(b))} * {z}" for b, z in zip(slopes, names))])


def logistic_fits(train: DataFrame, names: list[str], models: int, ridge: float, steps: int) -> list[Ridge]:
    """Newton steps of the penalised logistic fits of column ``t`` for every value of ``model``."""
    now = [(0.0, np.zeros(len(names))) for _ in range(models)]
    fits: list[Ridge] = []
    for _ in range(steps):
        eta = " ".join(f"WHEN {k} THEN {_linear(now[k], names)}" for k in range(models))
        step = (
            train.withColumn("eta", F.expr(f"CASE model {eta} END"))
            .withColumn("p", F.expr("1 / (1 + exp(-eta))"))
            .withColumn("w", F.expr(f"greatest(p * (1 - p), {number(LEAST_WEIGHT)})"))
            .withColumn("u", F.expr("eta + (t - p) / w"))
        )
        found = moments_by(step, [*names, "u"], weight="w", by="model")
        fits = [ridge_of(found[k], ridge) for k in range(models)]
        now = [(f.intercept, f.slopes) for f in fits]
    return fits


def surface_fits(train: DataFrame, names: list[str], models: int, ridge: float) -> dict[tuple[int, int], Ridge]:
    """The outcome's fit of every model and arm, in one pass."""
    found = moments_by(train, [*names, "y"], by="model * 2 + CAST(t AS BIGINT)")
    for k in range(models):
        for arm in (0, 1):
            if 2 * k + arm not in found:
                raise ValueError(f"no row of arm {arm} outside fold {k}")
    return {(k, arm): ridge_of(found[2 * k + arm], ridge) for k in range(models) for arm in (0, 1)}


def cross_fit_linear(
    d: Design, t: str, group: str, keep: list[str] | None = None, folds: int = 2, ridge: float = RIDGE,
    steps: int = STEPS, clip: float = CLIP,
) -> DataFrame:
    """``keep``, ``fold``, the outcome, ``e``, ``clipped`` and, for both arms, ``mu`` and ``sd``.

    ``d`` has the covariates as its terms, without ``t``, and ``t`` (0 or 1) among its columns. Each
    fold is scored by models of the other folds. ``sd1`` and ``sd0`` are the standard errors of the
    arm's mean at the row's covariates. ``e`` is kept ``clip`` away from 0 and 1; ``clipped`` is 1
    where that changed it. The frame is read ``steps`` + 3 times, so pass a written table.
    """
    keep = list(dict.fromkeys([group, t, *(keep or [])]))
    scaled, names = standardised(Design(integer_folds(d.df, group, folds), d.y, d.terms), [*keep, "fold"])
    scaled = scaled.withColumn("t", F.col(t).cast("double"))
    others = F.expr(f"explode(filter(sequence(0, {folds - 1}), k -> k <> fold))")
    train = scaled.select("*", others.alias("model"))
    chance = logistic_fits(train, names, folds, ridge, steps)
    surface = surface_fits(train, names, folds, ridge)

    def score(fold: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        z = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        out = np.full((len(z), 5), np.nan)
        for k in np.unique(fold.to_numpy()):
            here = fold.to_numpy() == k
            own = z[here]
            out[here, 0] = 1 / (1 + np.exp(-(chance[k].intercept + own @ chance[k].slopes)))
            for at, arm in ((1, 1), (2, 0)):
                fit = surface[k, arm]
                out[here, at] = fit.intercept + own @ fit.slopes
                gap = own - fit.centre
                spread = ((gap @ fit.inverse) * gap).sum(axis=1) + 1 / fit.n
                out[here, at + 2] = np.sqrt(fit.variance * spread)
        return pd.DataFrame(out, columns=["e", "mu1", "mu0", "sd1", "sd0"])

    scores = F.pandas_udf(score, "e double, mu1 double, mu0 double, sd1 double, sd0 double")
    scored = scaled.withColumn("s", scores("fold", *names))
    wide = scored.selectExpr(*map(quoted, keep), "fold", f"y AS {quoted(d.y)}", "s.*")
    return clipped_propensity(wide, clip)
