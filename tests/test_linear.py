import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwave.operators import factors as fa
from panelwave.operators import linear as ln
from panelwave.operators import moments as mm


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 900
    g = rng.integers(0, 150, n)
    x1 = rng.normal(1e4, 1, n) + 0.5 * (g % 3)
    x2 = rng.normal(size=n)
    cat = rng.integers(1, 5, n)
    u = rng.normal(0, 1.5, 150)[g]
    y = 3 + 0.7 * x1 - 1.2 * x2 + 0.4 * (cat == 3) + u + rng.normal(size=n)
    rows = [(int(a), float(b), float(c), int(d), float(e)) for a, b, c, d, e in zip(g, x1, x2, cat, y)]
    rows += [(1, None, 0.0, 1, 0.0), (1, 0.0, 0.0, 1, None)]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, cat int, y double").repartition(6)
    X = np.column_stack([x1, x2, cat == 2, cat == 3, cat == 4]).astype(float)
    return df, g, X, y


def made(df):
    return ln.design(df, "y", ["x1", "x2"], ["cat"], ["g"])


def classical(X, y, k_absorbed=0):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ beta
    df = len(y) - X.shape[1] - k_absorbed
    cov = np.linalg.inv(X.T @ X) * (e @ e) / df
    return beta, np.sqrt(np.diag(cov)), np.sqrt(e @ e / df), df


def test_ols_matches_least_squares(data):
    df, _, X, y = data
    fit = ln.ols(made(df))
    assert fit.terms == [ln.INTERCEPT, "x1", "x2", "cat_2", "cat_3", "cat_4"] and fit.n == 900
    centred = X.copy()
    centred[:, 0] -= 1e4
    beta, se, sigma, dof = classical(np.column_stack([np.ones(900), centred]), y)
    assert fit.estimate[1:] == pytest.approx(beta[1:], rel=1e-7)
    assert fit.se[1:] == pytest.approx(se[1:], rel=1e-7)
    assert (fit.sigma, fit.df) == (pytest.approx(sigma, rel=1e-9), dof)
    assert fit.estimate[0] == pytest.approx(beta[0] - 1e4 * beta[1], rel=1e-6)


def test_collinear_terms_are_null_and_harmless(data, spark):
    df, *_ = data
    wider = df.selectExpr("*", "x1 - 2 * x2 AS mix", "4 AS same")
    fit = ln.ols(ln.design(wider, "y", ["x1", "x2", "mix", "same"]))
    plain = ln.ols(ln.design(df, "y", ["x1", "x2"]))
    assert fit.estimate[3:] == [None, None] and fit.k == 3 and fit.df == plain.df
    assert fit.estimate[:3] == pytest.approx(plain.estimate, rel=1e-9)
    with pytest.raises(ValueError, match="collinear"):
        fit.of("mix")
    table = ln.coef_table(spark, fit).where("estimate IS NULL").count()
    assert table == 2 and ln.fit_table(spark, fit).head().k == 3


def test_residuals_are_orthogonal(data):
    df, *_ = data
    d = made(df)
    scored = ln.score(d, ln.ols(d)).toPandas()
    for term in ["x1", "x2", "cat_2", "cat_3", "cat_4"]:
        assert abs((scored["residual"] * (scored[term] - scored[term].mean())).sum()) < 1e-5
    assert abs(scored["residual"].sum()) < 1e-5


def test_within_equals_dummies(data):
    df, g, X, y = data
    fit = ln.within_ols(made(df), "g")
    dummies = (g[:, None] == np.unique(g)[None, :]).astype(float)
    centred = X - X.mean(axis=0)
    beta, se, sigma, dof = classical(np.column_stack([centred, dummies]), y)
    assert fit.estimate == pytest.approx(beta[:5], rel=1e-6)
    assert fit.se == pytest.approx(se[:5], rel=1e-6)
    assert (fit.sigma, fit.df) == (pytest.approx(sigma, rel=1e-8), dof)
    scored = ln.score_within(made(df), fit, "g")
    worst = scored.groupBy("g").agg({"residual": "sum"}).toPandas().iloc[:, 1].abs().max()
    assert worst < 1e-5


def test_term_constant_within_groups_is_dropped(data):
    df, *_ = data
    fit = ln.within_ols(ln.design(df.selectExpr("*", "g * 3 AS fixed"), "y", ["fixed", "x2"], keep=["g"]), "g")
    assert fit.estimate[0] is None and fit.estimate[1] is not None


def dense_reml(theta, X, y, g):
    X = np.column_stack([np.ones(len(y)), X])
    V = np.eye(len(y)) + theta * (g[:, None] == g[None, :])
    W = np.linalg.inv(V)
    A = X.T @ W @ X
    beta = np.linalg.solve(A, X.T @ W @ y)
    e = y - X @ beta
    df = len(y) - X.shape[1]
    s2 = e @ W @ e / df
    value = df * np.log(s2) + np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1]
    return value, beta, np.sqrt(np.diag(np.linalg.inv(A)) * s2), s2


def test_random_intercept_matches_dense_likelihood(data):
    df, g, X, y = data
    fit = ln.random_intercept(made(df), "g")
    centred = X.copy()
    centred[:, 0] -= 1e4
    theta = fit.extra["theta"]
    value, beta, se, s2 = dense_reml(theta, centred, y, g)
    assert fit.estimate[1:] == pytest.approx(beta[1:], rel=1e-5)
    assert fit.se[1:] == pytest.approx(se[1:], rel=1e-5)
    assert fit.sigma == pytest.approx(np.sqrt(s2), rel=1e-6) and fit.groups == len(np.unique(g))
    near = [dense_reml(theta * f, centred, y, g)[0] for f in (0.999, 1.001)]
    assert value < min(near)


def test_random_intercept_reads_group_sums_twice_for_any_sizes(spark, monkeypatch):
    calls = []
    one_pass = ln.ratio_sums
    monkeypatch.setattr(ln, "ratio_sums", lambda *a: calls.append(len(a[2])) or one_pass(*a))
    rng = np.random.default_rng(11)
    g = np.repeat(np.arange(300), np.arange(1, 301))  # 300 groups of 300 sizes
    x = rng.normal(size=len(g))
    y = 1 + 2 * x + rng.normal(size=300)[g] * 0.8 + rng.normal(size=len(g))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    fit = ln.random_intercept(ln.design(df, "y", ["x"], keep=["g"]), "g")
    assert len(calls) == 2 and fit.groups == 300
    # the same from sums per group
    n, theta = np.bincount(g), np.exp(np.linspace(-3, 2, 20001))
    X = np.column_stack([np.ones(len(g)), x, y])
    total = X.T @ X
    sums = np.column_stack([np.bincount(g, c) for c in X.T])
    value = []
    for t in theta:
        a = total - (sums * (t / (1 + n * t))[:, None]).T @ sums
        b = np.linalg.solve(a[:2, :2], a[:2, 2])
        s2 = (a[2, 2] - a[:2, 2] @ b) / (len(g) - 2)
        value.append((len(g) - 2) * np.log(s2) + np.log1p(n * t).sum() + np.linalg.slogdet(a[:2, :2])[1])
    assert np.log(fit.extra["theta"]) == pytest.approx(np.log(theta[int(np.argmin(value))]), abs=3e-4)


def test_random_intercept_without_group_variance_is_ols(spark):
    rng = np.random.default_rng(5)
    noise = zip(rng.normal(size=400), rng.normal(size=400))
    rows = [(i % 40, float(x), float(2 * x + e)) for i, (x, e) in enumerate(noise)]
    flat = spark.createDataFrame(rows, "g int, x double, y double")
    # Without the group means there is no variance between groups.
    means = flat.groupBy("g").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    flat = flat.join(means, "g").selectExpr("g", "x - mx AS x", "y - my AS y")
    d = ln.design(flat, "y", ["x"], keep=["g"])
    mixed, plain = ln.random_intercept(d, "g"), ln.ols(d)
    assert mixed.group_sd == pytest.approx(0, abs=1e-6)
    assert mixed.estimate[1] == pytest.approx(plain.estimate[1], rel=1e-6)


def test_moments_merge_over_partitions_weights_and_groups(data):
    df, g, X, y = data
    complete = df.na.drop("any")
    m = mm.moments(complete, ["x1", "y"], weight="x2 * x2")
    w = X[:, 1] ** 2
    Z = np.column_stack([X[:, 0], y])
    mean = (w @ Z) / w.sum()
    assert m.mean == pytest.approx(mean, rel=1e-12)
    assert m.cross == pytest.approx(((Z - mean) * w[:, None]).T @ (Z - mean), rel=1e-8)
    parts = mm.moments_by(complete, ["x2"], by="cat")
    assert {k: int(v.n) for k, v in parts.items()} == {r["cat"]: r["count"] for r in complete.groupBy("cat").count().collect()}
    with pytest.raises(ValueError):
        mm.moments(complete.where("false"), ["x1"])


def test_levels_are_as_many_as_the_data_has(spark):
    many = spark.range(500).selectExpr("id AS c", "CAST(id AS double) AS y")
    assert len(ln.design(many, "y", [], ["c"]).terms) == 499


def test_unlisted_level_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 5)], "y double, region int")
    listed = ln.design(df.where("region < 5"), "y", [], ["region"], levels={"region": [1, 2]})
    assert [r.region_2 for r in listed.df.orderBy("y").collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="not listed"):
        ln.design(df, "y", [], ["region"], levels={"region": [1, 2]}).df.collect()


def test_levels_with_quotes(spark):
    df = spark.createDataFrame([(1.0, "a'b"), (2.0, "c\\d"), (3.0, "e")], "y double, kind string")
    made = ln.design(df, "y", [], ["kind"])
    assert [tuple(r)[1:] for r in made.df.orderBy("y").collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 5.0), (1, 1.0, 1.0), (1, 3.0, 4.0), (2, 2.0, 2.0), (2, 5.0, 4.0)], "g int, x double, y double")
    made = ln.design(df, "y", ["x"], keep=["g"])
    assert ln.score_within(made, ln.within_ols(made, "g"), "g").count() == 6


def test_ill_conditioned_fit_keeps_its_digits(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=n)
    near = x + 1e-6 * rng.normal(size=n)
    y = 1 + 2 * x - 3 * near + 1e-7 * rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "near": near, "y": y})).repartition(6)
    fit = ln.ols(ln.design(df, "y", ["x", "near"]))
    exact, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), x, near]), y, rcond=None)
    assert fit.estimate == pytest.approx(list(exact), rel=1e-8)
    crossed = ln.ols_of(ln.moments(df, ["x", "near", "y"]), ["x", "near"])
    gap = [abs(a / b - 1) if a is not None else 1 for a, b in zip(crossed.estimate[1:], exact[1:])]
    assert max(gap) > 1e-6  # what squaring costs


def test_factors_merge_in_bounded_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3)) * [1, 100, 1e-3] + [0, 1e6, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(1000)
    for rounds in (1, 2):  # a group of more than FAN_IN factors raises an error
        r, n = fa.triangular_factor(df, list("abc"), rounds)
        full = np.column_stack([np.ones(3000), x])
        assert n == 3000 and np.abs(np.tril(r, -1)).max() == 0
        assert r.T @ r == pytest.approx(full.T @ full, rel=1e-9, abs=1e-6)
    assert fa.triangular_factor(df.where("false"), list("abc"))[1] == 0
    few = fa.triangular_factor(df.limit(2), list("abc"))[0]
    assert few.shape == (4, 4) and np.abs(few[2:]).max() == 0


def test_clustered_errors_like_numpy(data):
    df, g, X, y = data
    fit = ln.ols(made(df), cluster="g")
    plain = ln.ols(made(df))
    assert fit.estimate == plain.estimate and fit.groups == len(np.unique(g))
    centred = X.copy()
    centred[:, 0] -= 1e4
    full = np.column_stack([np.ones(len(y)), *[X[:, j] for j in range(X.shape[1]) if not (X[:, j] == 1).all()]])
    q, r = np.linalg.qr(full)
    spread = np.linalg.inv(r) @ np.linalg.inv(r).T
    e = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    u = np.stack([(full * e[:, None])[g == k].sum(axis=0) for k in np.unique(g)])
    G, n, k = len(u), *full.shape
    want = np.sqrt(np.diag(spread @ u.T @ u @ spread) * G / (G - 1) * (n - 1) / (n - k))
    assert fit.se[1:] == pytest.approx(list(want[1:]), rel=1e-6)


def test_clusters_of_one_row_and_of_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7), float((i * i) % 11), 1) for i in range(60)], "g bigint, x double, y double, one int")
    d = ln.design(df, "y", ["x"], keep=["g", "one"])
    each = ln.ols(d, cluster="g")
    x, y = np.arange(60) % 7, (np.arange(60) ** 2) % 11
    full = np.column_stack([np.ones(60), x])
    e = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    spread = np.linalg.inv(full.T @ full)
    white = spread @ (full.T * e**2) @ full @ spread * 60 / 58
    assert each.se == pytest.approx(list(np.sqrt(np.diag(white))), rel=1e-9)
    assert all(np.isnan(s) for s in ln.ols(d, cluster="one").se)
