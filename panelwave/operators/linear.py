"""Linear models from distributed cross-products.

The data are read once per model, by :mod:`panelwave.operators.moments` or by a
``groupBy`` on the person; only p x p matrices are solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import number, quoted, text
from panelwave.operators.factors import triangular_factor
from panelwave.operators.moments import Moments, moments
from panelwave.sources.shared import saved

INTERCEPT = "(intercept)"
# A column is collinear with earlier ones if less than this share of its variation is left.
TOLERANCE = 1e-10
# The same on lengths, where a triangular factor shows them.
LEFT_OVER = 1e-9
NO_SPREAD = 1e-12  # of a column's length, which is but rounding
# Variance ratios tried in one pass, the range of their logarithms, and the degree between them.
RATIOS = 32
LOW_RATIO, HIGH_RATIO = -12.0, 8.0
DEGREE = 20


@dataclass
class Design:
    """A model frame: complete rows with outcome, terms and pass-through columns."""

    df: DataFrame
    y: str
    terms: list[str]


def levels_of(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted levels of categorical columns, found in one pass; as many as the caller's columns have."""
    if not cols:
        return {}
    row = df.agg(*[F.collect_set(F.col(quoted(c))).alias(f"l{i}") for i, c in enumerate(cols)]).head()
    return {c: sorted(row[i]) for i, c in enumerate(cols)}


def written(level) -> str:
    """A level as SQL."""
    if isinstance(level, (bool, int, float)):
        return repr(level)
    return f"CAST({text(str(level))} AS STRING)"


def dummy(col: str, level, known: Sequence) -> str:
    """1 at ``level``, 0 at the other known ones; any other value is an error, not a level of its own."""
    others = ", ".join(map(written, known))
    error = text(f"{col} has a level that is not listed")
    value = quoted(col) if isinstance(level, (bool, int, float)) else f"CAST({quoted(col)} AS STRING)"
    return (
        f"CASE WHEN {value} = {written(level)} THEN 1D WHEN {value} IN ({others}) THEN 0D"
        f" ELSE CAST(raise_error({error}) AS DOUBLE) END"
    )


def design(
    df: DataFrame,
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    keep: Sequence[str] = (),
    levels: dict[str, list] | None = None,
) -> Design:
    """Rows complete in every used column, with a 0/1 column per level but the first.

    Dummies are named ``<column>_<level>`` and follow the numeric terms. Levels come
    from ``levels`` or from the whole of ``df``; one that no complete row has gives an
    all-zero column, whose coefficient is null. A row with a level that ``levels`` does
    not list raises an error when it is read.
    """
    used = list(dict.fromkeys([y, *numeric, *categorical]))
    known = dict(levels or {})
    known |= levels_of(df, [c for c in categorical if c not in known])
    complete = df.na.drop("any", subset=used)
    dummies = {
        f"{col}_{level}": dummy(col, level, known[col])
        for col in categorical
        for level in known[col][1:]
    }
    extra = [c for c in keep if c not in used or c in categorical]
    frame = complete.selectExpr(
        *[quoted(c) for c in extra],
        f"CAST({quoted(y)} AS DOUBLE) AS {quoted(y)}",
        *[f"CAST({quoted(c)} AS DOUBLE) AS {quoted(c)}" for c in numeric],
        *[f"{expr} AS {quoted(name)}" for name, expr in dummies.items()],
    )
    return Design(frame, y, [*numeric, *dummies])


@dataclass
class Fit:
    """A fitted linear model. Collinear terms have estimate and se ``None``."""

    terms: list[str]
    estimate: list[float | None]
    se: list[float | None]
    sigma: float
    r2: float | None
    n: int
    df: int
    groups: int | None = None
    group_sd: float | None = None
    extra: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return sum(e is not None for e in self.estimate)

    def of(self, term: str) -> tuple[float, float]:
        i = self.terms.index(term)
        if self.estimate[i] is None:
            raise ValueError(f"{term} is collinear with earlier terms")
        return self.estimate[i], self.se[i]


def solve_in_order(
    cross: np.ndarray, base: np.ndarray, tolerance: float = TOLERANCE
) -> tuple[list[int], np.ndarray, np.ndarray, float]:
    """Regress the last variable of a cross-product matrix on the others.

    Variables enter in order; one that earlier ones explain, up to ``tolerance`` of
    its own ``base`` sum of squares, is left out. Returns the variables kept, their
    coefficients, the inverse of their cross-products and the residual sum of squares.
    """
    p = len(cross) - 1
    scale = np.sqrt(np.where(base > 0, base, 1.0))
    a = cross / np.outer(scale, scale)
    kept: list[int] = []
    for j in range(p):
        if base[j] <= 0 or a[j, j] <= tolerance:
            continue
        pivot = a[j, j]
        column = a[:, j].copy()
        a -= np.outer(column, column) / pivot
        a[:, j] = column / pivot
        a[j, :] = column / pivot
        a[j, j] = -1.0 / pivot
        kept.append(j)
    keep = np.array(kept, dtype=int)
    coef = a[keep, p] * scale[p] / scale[keep]
    inverse = -a[np.ix_(keep, keep)] / np.outer(scale[keep], scale[keep])
    return kept, coef, inverse, float(a[p, p] * scale[p] ** 2)


def ols_of(m: Moments, terms: Sequence[str]) -> Fit:
    """Least squares with intercept from the moments of ``[terms, y]``."""
    p = len(terms)
    n = int(m.n)
    kept, coef, inverse, rss = solve_in_order(m.cross, np.diag(m.cross))
    df = n - len(kept) - 1
    variance = rss / df if df > 0 else math.nan
    centre = m.mean[kept]
    intercept = m.mean[p] - coef @ centre
    intercept_se = math.sqrt(variance * (1.0 / n + centre @ inverse @ centre))
    estimate: list[float | None] = [float(intercept)] + [None] * p
    se: list[float | None] = [intercept_se] + [None] * p
    for i, j in enumerate(kept):
        estimate[j + 1] = float(coef[i])
        se[j + 1] = math.sqrt(variance * inverse[i, i])
    total = m.cross[p, p]
    return Fit(
        [INTERCEPT, *terms], estimate, se, math.sqrt(variance),
        float(1 - rss / total) if total > 0 else None, n, df,
    )


def ols_of_factor(r: np.ndarray, n: int, terms: Sequence[str]) -> Fit:
    """Least squares from the triangular factor of ``[1, terms, y]``.

    Terms enter in order; one is left out if what earlier ones leave of it is shorter than
    ``LEFT_OVER`` of its length about its mean.
    """
    if n == 0:
        raise ValueError("no complete rows to fit")
    p = len(terms)
    kept = [0]
    factor = r[:, :1]
    for j in range(1, p + 1):
        tried = np.linalg.qr(np.column_stack([factor, r[:, j]]), mode="r")
        about_mean = np.linalg.norm(r[1:, j])
        if about_mean > NO_SPREAD * np.linalg.norm(r[:, j]) and abs(tried[len(kept), -1]) > LEFT_OVER * about_mean:
            kept.append(j)
            factor = r[:, kept]
    q, upper = np.linalg.qr(factor)
    inverse = np.linalg.inv(upper)
    target = q.T @ r[:, p + 1]
    coef = inverse @ target
    left = r[:, p + 1] - q @ target
    df = n - len(kept)
    rss, total = float(left @ left), float(r[1:, p + 1] @ r[1:, p + 1])
    variance = rss / df if df > 0 else math.nan
    spread = inverse @ inverse.T
    estimate: list[float | None] = [None] * (p + 1)
    se: list[float | None] = [None] * (p + 1)
    for i, j in enumerate(kept):
        estimate[j], se[j] = float(coef[i]), math.sqrt(variance * spread[i, i])
    return Fit(
        [INTERCEPT, *terms], estimate, se, math.sqrt(variance),
        1 - rss / total if total > 0 else None, n, df, extra={"kept": kept, "spread": spread},
    )


def ols(d: Design, cluster: str | None = None) -> Fit:
    """Ordinary least squares: one pass over the frame.

    With ``cluster`` the standard errors allow for any dependence within its groups.
    """
    fit = ols_of_factor(*triangular_factor(d.df, [*d.terms, d.y]), d.terms)
    return fit if cluster is None else clustered(d, fit, cluster)


def clustered(d: Design, fit: Fit, cluster: str) -> Fit:
    """``fit`` with sandwich standard errors from the groups' sums of scores.

    A group is one row of sums, combined on the map side; null groups are one group. The usual
    factor for few groups and many terms applies.
    """
    kept = fit.extra["kept"]
    names = [None if j == 0 else d.terms[j - 1] for j in kept]
    error = f"({quoted(d.y)} - ({linear_predictor(fit)}))"
    scores = d.df.groupBy(cluster).agg(
        *[F.expr(f"sum({error}{'' if x is None else ' * ' + quoted(x)})").alias(f"u{i}") for i, x in enumerate(names)]
    )
    m = moments(scores, [f"u{i}" for i in range(len(kept))])
    meat = m.cross + m.w * np.outer(m.mean, m.mean)
    groups = int(m.n)
    spread = fit.extra["spread"]
    factor = groups / (groups - 1) * (fit.n - 1) / fit.df if groups > 1 and fit.df > 0 else math.nan
    variance = factor * spread @ meat @ spread
    se: list[float | None] = [None] * len(fit.terms)
    for i, j in enumerate(kept):
        se[j] = math.sqrt(max(variance[i, i], 0.0)) if not math.isnan(factor) else math.nan
    return replace(fit, se=se, groups=groups)


def group_sums(d: Design, group: str, centre: np.ndarray) -> DataFrame:
    """One row per group: its size and the sums of the columns less ``centre``.

    Combines on the map side, so a group of any size is one record per task.
    """
    cols = [*d.terms, d.y]
    return d.df.groupBy(group).agg(
        F.count("*").alias("size"),
        *[F.expr(f"sum({quoted(c)} - {number(float(centre[i]))}) AS s{i}") for i, c in enumerate(cols)],
    )


def within_ols(d: Design, group: str) -> Fit:
    """Least squares on deviations from group means (group effects absorbed).

    The within cross-products are the total ones less those of the group means, so no
    row has to be demeaned and rows never move by group: only group sums do.
    """
    p = len(d.terms)
    total = moments(d.df, [*d.terms, d.y])
    sums = group_sums(d, group, total.mean)
    means = sums.selectExpr("size", *[f"s{i} / size AS s{i}" for i in range(p + 1)])
    between = moments(means, [f"s{i}" for i in range(p + 1)], weight="size")
    cross = total.cross - between.cross
    groups = int(between.n)
    n = int(total.n)
    kept, coef, inverse, rss = solve_in_order(cross, np.diag(total.cross))
    df = n - len(kept) - groups
    variance = rss / df if df > 0 else math.nan
    estimate: list[float | None] = [None] * p
    se: list[float | None] = [None] * p
    for i, j in enumerate(kept):
        estimate[j] = float(coef[i])
        se[j] = math.sqrt(variance * inverse[i, i])
    spread = cross[p, p]
    return Fit(
        list(d.terms), estimate, se, math.sqrt(variance),
        float(1 - rss / spread) if spread > 0 else None, n, df, groups,
    )


def ratio_sums(sums: DataFrame, cols: Sequence[str], ratios: Sequence[float]) -> tuple[np.ndarray, np.ndarray, int]:
    """For all variance ratios in one pass over group sums: the cross-products of ``size`` and ``cols``
    weighted by ratio / (1 + size * ratio), the sums of log(1 + size * ratio), and the number of groups.

    A task returns one number for every ratio and pair of columns; they are added up by place.
    """
    theta = np.asarray(ratios, dtype=float)
    upper = np.triu_indices(len(cols) + 1)
    places = len(theta) * (len(upper[0]) + 1) + 1
    picked = sums.selectExpr("CAST(size AS DOUBLE) AS size", *[f"CAST({quoted(c)} AS DOUBLE) AS {quoted(c)}" for c in cols])

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cross, logs, groups = np.zeros((len(theta), len(upper[0]))), np.zeros(len(theta)), 0
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            spread = 1 + np.outer(values[:, 0], theta)
            cross += (theta / spread).T @ (values[:, upper[0]] * values[:, upper[1]])
            logs += np.log(spread).sum(axis=0)
            groups += len(values)
        yield pd.DataFrame({"place": np.arange(places), "value": np.concatenate([cross.ravel(), logs, [groups]])})

    total = np.zeros(places)
    found = picked.mapInPandas(reduce_task, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    for row in found.collect():  # as many as there are ratios and pairs of columns
        total[row["place"]] = row["value"]
    half = total[: -len(theta) - 1].reshape(len(theta), -1)
    cross = np.zeros((len(theta), len(cols) + 1, len(cols) + 1))
    cross[:, upper[0], upper[1]] = half
    cross[:, upper[1], upper[0]] = half
    return cross, total[-len(theta) - 1 : -1], int(round(total[-1]))


def random_intercept(d: Design, group: str) -> Fit:
    """Restricted maximum likelihood fit with a normal intercept per group.

    With ``theta`` the ratio of the group to the residual variance, the likelihood needs the total
    cross-products and, for each ratio, weighted cross-products of the group sums. The group sums are
    written once and read twice: for a coarse grid of ratios, and for Chebyshev nodes around its best
    one. All that the likelihood is made of is smooth in log(theta), so between the nodes it is known
    to rounding, and the minimum and its fit need no further pass, whatever the sizes of the groups.
    """
    p = len(d.terms)
    total = moments(d.df, [*d.terms, d.y])
    n = int(total.n)
    start = ols_of(total, d.terms)
    used = [i for i in range(p) if start.estimate[i + 1] is not None]
    slots = [*used, p]
    full = np.zeros((len(slots) + 1, len(slots) + 1))
    full[0, 0] = n
    full[1:, 1:] = total.cross[np.ix_(slots, slots)]
    df = n - len(slots)
    sums = saved(group_sums(d, group, total.mean).select("size", *[f"s{i}" for i in slots]), "group-sums")

    def fit_at(cross: np.ndarray, logs: float):
        a = full - cross
        kept, coef, inverse, rss = solve_in_order(a, np.diag(full), 0.0)
        sign, logdet = np.linalg.slogdet(a[:-1, :-1])
        variance = rss / df
        return df * math.log(variance) + logs + logdet, coef, inverse, variance

    def criteria(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        cross, logs, groups = ratio_sums(sums, [f"s{i}" for i in slots], np.exp(at))
        return np.array([fit_at(c, g)[0] for c, g in zip(cross, logs)]), cross, logs, groups

    grid = np.linspace(LOW_RATIO, HIGH_RATIO, RATIOS)
    values, _, _, groups = criteria(grid)
    best = int(np.argmin(values))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, RATIOS - 1)]
    unit_nodes = np.cos(np.pi * (np.arange(RATIOS) + 0.5) / RATIOS)
    values, cross, logs, _ = criteria((low + high) / 2 + (high - low) / 2 * unit_nodes)
    at = smooth_minimum(unit_nodes, values)
    theta = math.exp((low + high) / 2 + (high - low) / 2 * at)
    weights = np.polynomial.chebyshev.chebvander([at], DEGREE) @ np.linalg.pinv(
        np.polynomial.chebyshev.chebvander(unit_nodes, DEGREE)
    )
    found = fit_at(np.tensordot(weights[0], cross, axes=1), float(weights[0] @ logs))
    none = fit_at(np.zeros_like(full), 0.0)
    if none[0] <= found[0]:
        theta, found = 0.0, none
    criterion, coef, inverse, variance = found
    estimate: list[float | None] = [None] * (p + 1)
    se: list[float | None] = [None] * (p + 1)
    shift = np.concatenate([[1.0], -total.mean[used]])
    estimate[0] = float(total.mean[p] + shift @ coef)
    se[0] = math.sqrt(variance * (shift @ inverse @ shift))
    for i, j in enumerate(used):
        estimate[j + 1] = float(coef[i + 1])
        se[j + 1] = math.sqrt(variance * inverse[i + 1, i + 1])
    return Fit(
        [INTERCEPT, *d.terms], estimate, se, math.sqrt(variance), None, n, df,
        groups, math.sqrt(theta * variance), {"theta": theta, "criterion": criterion},
    )


def smooth_minimum(nodes: np.ndarray, values: np.ndarray) -> float:
    """Where between -1 and 1 the polynomial through Chebyshev nodes is least."""
    fitted = np.polynomial.Chebyshev.fit(nodes, values - values.min(), DEGREE, domain=[-1, 1])
    flat = fitted.deriv().roots()
    flat = flat[np.abs(flat.imag) < 1e-9].real
    places = np.concatenate([flat[np.abs(flat) <= 1], [-1.0, 1.0]])
    return float(places[np.argmin(fitted(places))])


def coef_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """One row per term: estimate, standard error, t; collinear terms are null."""
    rows = [
        (i, term, e, s, None if e is None or not s else e / s)
        for i, (term, e, s) in enumerate(zip(fit.terms, fit.estimate, fit.se))
    ]
    return spark.createDataFrame(
        rows, "pos int, term string, estimate double, se double, t double"
    )


def fit_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """One row on the fit as a whole."""
    row = (fit.n, fit.k, fit.df, fit.sigma, fit.r2, fit.groups, fit.group_sd)
    return spark.createDataFrame(
        [row],
        "n bigint, k int, df bigint, sigma double, r2 double, n_groups bigint, group_sd double",
    )


def linear_predictor(fit: Fit) -> str:
    parts = []
    for term, e in zip(fit.terms, fit.estimate):
        if e is not None:
            parts.append(number(e) if term == INTERCEPT else f"{number(e)} * {quoted(term)}")
    return " + ".join(parts) or "0D"


def score(d: Design, fit: Fit) -> DataFrame:
    """The frame with ``fitted`` and ``residual``."""
    return d.df.withColumn("fitted", F.expr(linear_predictor(fit))).withColumn(
        "residual", F.expr(f"{quoted(d.y)} - fitted")
    )


def score_within(d: Design, fit: Fit, group: str) -> DataFrame:
    """As :func:`score`, for a fit with absorbed group effects: the group's mean
    residual belongs to the fitted value."""
    linear = d.df.withColumn("linear", F.expr(linear_predictor(fit)))
    effect = linear.groupBy(F.col(group).alias("_group")).agg(
        F.expr(f"avg({quoted(d.y)} - linear)").alias("group_effect")
    )
    return (
        linear.join(effect, F.col(group).eqNullSafe(F.col("_group")))  # a null group is one, too
        .drop("_group")
        .withColumn("fitted", F.expr("linear + group_effect"))
        .withColumn("residual", F.expr(f"{quoted(d.y)} - fitted"))
        .drop("linear")
    )
