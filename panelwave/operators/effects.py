"""Average effects of a binary treatment, cross-fitted on Spark ML models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import number, quoted
from panelwave.operators.linear import Design, random_intercept
from panelwave.sources.shared import saved

FEATURES = "features"
CLIP = 0.01
Z95 = 1.96
REPLICATES = 200
ROUNDS = 3


def with_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Add ``fold``, the same for all rows of a person so that no fit sees one it scores."""
    return df.withColumn("fold", F.expr(f"CAST(pmod(xxhash64({quoted(group)}), {folds}) AS INT)"))


def assembled(df: DataFrame, x: Sequence[str], into: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(x), outputCol=into).transform(df)


def clipped_propensity(df: DataFrame, clip: float = CLIP) -> DataFrame:
    """``e`` kept ``clip`` away from 0 and 1; ``clipped`` is 1 where that changed it."""
    low, high = number(float(clip)), number(float(1 - clip))
    return df.withColumn("clipped", F.expr(f"CASE WHEN e < {low} OR e > {high} THEN 1 ELSE 0 END")).withColumn(
        "e", F.expr(f"least(greatest(e, {low}), {high})")
    )


def propensity(
    train: DataFrame, test: DataFrame, t: str, x: Sequence[str], method: str = "boosted", seed: int = 1,
    clip: float = CLIP,
) -> DataFrame:
    """``test`` with ``e``, the chance of treatment given ``x``, kept ``clip`` off 0 and 1, and ``clipped``."""
    if method == "boosted":
        model = GBTClassifier(
            labelCol="label", featuresCol=FEATURES, maxIter=10, maxDepth=3, stepSize=0.3, seed=seed
        )
    elif method == "logistic":
        model = LogisticRegression(labelCol="label", featuresCol=FEATURES, regParam=1e-3)
    else:
        raise ValueError(f"method must be 'boosted' or 'logistic', got {method!r}")
    labelled = assembled(train, x).select(FEATURES, F.col(t).cast("double").alias("label"))
    fitted = model.fit(labelled)
    scored = fitted.transform(assembled(test, x))
    chance = vector_to_array("probability")[1]
    return clipped_propensity(scored.withColumn("e", chance), clip).drop(
        FEATURES, "rawPrediction", "probability", "prediction"
    )


def person_intercepts(train: DataFrame, residual: str, person: str) -> DataFrame:
    """``(person, intercept)``: shrunken mean residuals, at the variance ratio fitted to the residuals."""
    fit = random_intercept(Design(train, residual, []), person)
    centred = train.withColumn(residual, F.expr(f"{residual} - {number(fit.estimate[0])}"))
    effects = person_effects(centred, residual, person, fit.extra["theta"])
    return effects.select(F.col(person).alias("_person"), F.col("person_effect").alias("_intercept"))


def outcome_forest(
    train: DataFrame, y: str, inputs: Sequence[str], trees: int, depth: int, seed: int,
    person: str | None = None, rounds: int = ROUNDS,
):
    """A forest of ``y`` on ``inputs``; with ``person``, of ``y`` less a normal intercept per person.

    The two parts are fitted in turn, ``rounds`` times: a forest on the outcome less the persons'
    intercepts, then the variance ratio of its residuals and each person's shrunken mean residual.
    A round moves sums per person, never rows; the intercepts are written, so plans do not grow.
    """
    # all features at every split: what a tree leaves of a covariate would pass for persons' intercepts
    learner = RandomForestRegressor(
        labelCol="label", featuresCol=FEATURES, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all"
    )
    labelled = train.withColumn("label", F.col(y).cast("double"))
    if person is None:
        return learner.fit(assembled(labelled, inputs).select(FEATURES, "label"))
    now = labelled
    for k in range(rounds):
        forest = learner.fit(assembled(now, inputs).select(FEATURES, "label"))
        if k + 1 == rounds:
            return forest
        left = forest.transform(assembled(labelled, inputs)).selectExpr(quoted(person), "label - prediction AS residual")
        intercepts = saved(person_intercepts(left, "residual", person), "intercepts")
        joined = labelled.join(intercepts, F.col(person).eqNullSafe(F.col("_person")))
        now = joined.withColumn("label", F.expr("label - _intercept")).drop("_person", "_intercept")


def outcome_surface(
    train: DataFrame,
    test: DataFrame,
    y: str,
    t: str,
    x: Sequence[str],
    trees: int = 20,
    depth: int = 5,
    seed: int = 1,
    person: str | None = None,
) -> DataFrame:
    """``test`` with each bagged tree's prediction under treatment and under control.

    ``draws1`` and ``draws0`` are arrays with one prediction per tree, ``mu1`` / ``mu0``
    their means and ``sd1`` / ``sd0`` their standard deviations. With ``person`` the forest
    is fitted beside an intercept per person; a scored person's intercept counts as 0.
    """
    inputs = [t, *x]
    forest = outcome_forest(train, y, inputs, trees, depth, seed, person)
    out = test.withColumns({"observed_t": F.col(t), "in1": F.lit(1.0), "in0": F.lit(0.0)})
    for arm in ("1", "0"):
        out = assembled(out, [f"in{arm}", *x], f"x{arm}")
        for i, tree in enumerate(forest.trees):
            tree.setFeaturesCol(f"x{arm}").setPredictionCol(f"p{arm}_{i}")
            out = tree.transform(out)
    names = test.columns
    drawn = out.selectExpr(
        *[quoted(c) for c in names],
        *[f"array({', '.join(f'p{arm}_{i}' for i in range(trees))}) AS draws{arm}" for arm in "10"],
    )
    return drawn.selectExpr("*", *[e for arm in "10" for e in draw_stats(arm)])


def draw_stats(arm: str) -> list[str]:
    """Mean and sample standard deviation of an array of draws."""
    draws = f"draws{arm}"
    mean = f"(aggregate({draws}, 0D, (a, v) -> a + v) / size({draws}))"
    square = f"aggregate({draws}, 0D, (a, v) -> a + (v - {mean}) * (v - {mean}))"
    return [f"{mean} AS mu{arm}", f"sqrt({square} / (size({draws}) - 1)) AS sd{arm}"]


def cross_fit(
    df: DataFrame,
    y: str,
    t: str,
    x: Sequence[str],
    group: str,
    folds: int = 2,
    method: str = "boosted",
    trees: int = 20,
    depth: int = 5,
    seed: int = 1,
    person: bool = False,
    clip: float = CLIP,
) -> DataFrame:
    """Rows with out-of-fold ``e``, ``clipped``, ``mu1``, ``mu0``, ``sd1``, ``sd0`` and draws.

    With ``person`` the outcome model has a normal intercept for each ``group``.

    Each fold is scored by models fitted on the other folds. Fits are distributed
    Spark ML jobs; ``df`` is read once per fit, so pass a written or cached table.
    """
    folded = with_folds(df, group, folds)
    parts = []
    for k in range(folds):
        train, test = folded.where(f"fold <> {k}"), folded.where(f"fold = {k}")
        scored = propensity(train, test, t, x, method, seed, clip)
        parts.append(outcome_surface(train, scored, y, t, x, trees, depth, seed, group if person else None))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def person_effects(df: DataFrame, residual: str, group: str, theta: float) -> DataFrame:
    """Shrunken mean residual of each person, for a variance ratio ``theta``."""
    return df.groupBy(group).agg(
        F.expr(
            f"{number(float(theta))} * sum({residual}) / (1 + {number(float(theta))} * count(*))"
        ).alias("person_effect"),
        F.count("*").alias("n_rows"),
    )


def common_support(df: DataFrame, t: str, rule: str = "sd", width: float = 1.0) -> DataFrame:
    """Add ``supported``, 0 for rows outside the region where both arms are informed.

    ``"sd"``: the counterfactual prediction may not be less certain than the worst
    factual prediction of the row's own arm plus ``width`` standard deviations of those.
    ``"propensity"``: ``e`` has to lie in the range seen in the other arm. The cuts are
    one row of aggregates; they enter the row test as numbers.
    """
    arms = (0, 1)
    if rule == "sd":
        cuts = df.agg(
            *[
                F.expr(
                    f"max(CASE WHEN {t} = {a} THEN sd{a} END) + {width} * coalesce("
                    f"stddev_samp(CASE WHEN {t} = {a} THEN sd{a} END), 0)"
                ).alias(f"cut{a}")
                for a in arms
            ]
        ).head()
        inside = (
            f"CASE WHEN {t} = 1 THEN sd0 <= {number(cuts['cut1'])} ELSE sd1 <= {number(cuts['cut0'])} END"
        )
    elif rule == "propensity":
        cuts = df.agg(
            *[
                F.expr(f"{f}(CASE WHEN {t} = {a} THEN e END)").alias(f"{f}{a}")
                for f in ("min", "max")
                for a in arms
            ]
        ).head()
        seen = {a: f"{number(cuts[f'min{a}'])} AND {number(cuts[f'max{a}'])}" for a in arms}
        inside = f"CASE WHEN {t} = 1 THEN e BETWEEN {seen[0]} ELSE e BETWEEN {seen[1]} END"
    else:
        raise ValueError(f"rule must be 'sd' or 'propensity', got {rule!r}")
    return df.withColumn("supported", F.expr(f"CASE WHEN {inside} THEN 1 ELSE 0 END"))


def influence_average(df: DataFrame, value: str, weight: str, group: str) -> DataFrame:
    """``sum(value) / sum(weight)`` with a standard error that adds up within persons.

    Persons are summed on the map side first; the ratio and the products needed for
    its variance come from one pass over the person sums.
    """
    persons = df.groupBy(group).agg(
        F.expr(f"sum({value})").alias("a"),
        F.expr(f"sum({weight})").alias("b"),
        F.expr(f"count(CASE WHEN {weight} <> 0 THEN 1 END)").alias("rows"),
    )
    sums = persons.agg(
        F.expr("sum(a)").alias("a"),
        F.expr("sum(b)").alias("b"),
        F.expr("sum(a * a)").alias("aa"),
        F.expr("sum(a * b)").alias("ab"),
        F.expr("sum(b * b)").alias("bb"),
        F.expr("sum(rows)").alias("n_rows"),
        F.expr("count(CASE WHEN rows > 0 THEN 1 END)").alias("n_persons"),
    )
    return sums.selectExpr(
        "a / b AS estimate",
        "sqrt(greatest(aa - 2 * (a / b) * ab + (a / b) * (a / b) * bb, 0D)) / b AS sd",
        "n_rows",
        "n_persons",
    )


def with_interval(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "*", f"estimate - {Z95} * sd AS ci_lower", f"estimate + {Z95} * sd AS ci_upper"
    )


def ate(df: DataFrame, y: str, t: str, group: str) -> DataFrame:
    """Average effect over all rows: augmented inverse-propensity scores."""
    score = (
        f"mu1 - mu0 + {t} * ({y} - mu1) / e - (1 - {t}) * ({y} - mu0) / (1 - e)"
    )
    return with_interval(influence_average(df, score, "1D", group))


def att(df: DataFrame, t: str, group: str) -> DataFrame:
    """Average of the individual differences over treated rows."""
    return with_interval(
        influence_average(df, f"{t} * (mu1 - mu0)", f"CAST({t} AS DOUBLE)", group)
    )


def att_augmented(df: DataFrame, y: str, t: str, group: str) -> DataFrame:
    """Average effect on the treated with the control surface corrected by the
    odds-weighted control residuals."""
    score = f"({t} - (1 - {t}) * e / (1 - e)) * ({y} - mu0)"
    return with_interval(influence_average(df, score, f"CAST({t} AS DOUBLE)", group))


def treated_draws(df: DataFrame, t: str) -> DataFrame:
    """Mean individual difference over treated rows, for every draw."""
    return (
        df.where(f"{t} = 1")
        .selectExpr("posexplode(zip_with(draws1, draws0, (a, b) -> a - b)) AS (draw, difference)")
        .groupBy("draw")
        .agg(F.avg("difference").alias("difference"))
    )


def att_of_draws(df: DataFrame, t: str) -> DataFrame:
    """Mean and standard deviation, over draws, of the treated rows' mean difference."""
    return with_interval(
        treated_draws(df, t).agg(
            F.avg("difference").alias("estimate"), F.stddev_samp("difference").alias("sd")
        )
    )


def bootstrap_weight(group: str, replicate: str) -> str:
    """A Poisson(1) count from the first 32 bits of a hash of person and replicate, as SQL."""
    bits = f"conv(substring(md5(concat(CAST({group} AS STRING), ':', CAST({replicate} AS STRING))), 1, 8), 16, 10)"
    steps = " + ".join(f"CASE WHEN h >= {cut} THEN 1 ELSE 0 END" for cut in poisson_cuts())
    return f"transform(array(CAST({bits} AS BIGINT)), h -> {steps})[0]"


def poisson_cuts() -> list[int]:
    """The shares of 2^32 below which a Poisson(1) count is at most 0, 1, 2, ..."""
    return [
        round(2**32 * sum(math.exp(-1.0) / math.factorial(k) for k in range(top + 1)))
        for top in range(10)  # a count of more than 10 has a chance under 2^-24
    ]


def person_bootstrap(
    df: DataFrame, value: str, weight: str, group: str, replicates: int = REPLICATES
) -> DataFrame:
    """``(replicate, estimate)``: ``sum(value) / sum(weight)`` with Poisson(1) counts of persons.

    A person's count in a replicate depends on the person and the replicate alone, so replicates
    are the same wherever the rows lie, and persons are resampled whole. Rows are summed by person
    first; the person sums meet all replicates in one pass that combines on the map side.
    """
    persons = df.groupBy(group).agg(F.expr(f"sum({value})").alias("a"), F.expr(f"sum({weight})").alias("b"))
    drawn = persons.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    counted = drawn.withColumn("k", F.expr(bootstrap_weight(quoted(group), "replicate")))
    return counted.groupBy("replicate").agg(F.expr("sum(k * a) / sum(k * b)").alias("estimate"))


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    """Mean and standard deviation over replicates, with a normal 95 % interval."""
    return with_interval(
        draws.agg(
            F.avg("estimate").alias("estimate"), F.stddev_samp("estimate").alias("sd"), F.count("estimate").alias("n_draws")
        )
    )


def effect_table(estimates: dict[str, DataFrame]) -> DataFrame:
    """Stack (estimate, sd) rows under their method names, with 95 % intervals."""
    out = None
    for model, df in estimates.items():
        row = df.selectExpr(f"'{model}' AS model", "estimate AS att", "sd")
        out = row if out is None else out.unionByName(row)
    return out.selectExpr(
        "*", f"att - {Z95} * sd AS ci_lower", f"att + {Z95} * sd AS ci_upper"
    )
