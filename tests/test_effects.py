import numpy as np
import pandas as pd
import pytest

from panelwave.operators import crossfit as cf
from panelwave.operators import diagnostics as dg
from panelwave.operators import effects as ef
from panelwave.operators import linear as ln
from panelwave.operators import sensitivity as se


@pytest.fixture(scope="module")
def trial(spark):
    """Effect 2 for all, treatment more likely at high x, two rows per person."""
    rng = np.random.default_rng(2)
    n = 3000
    person = np.arange(n) // 2
    x = rng.normal(size=n)
    z = rng.normal(size=n)
    e = 1 / (1 + np.exp(-x))
    t = (rng.random(n) < e).astype(int)
    y = 1 + 2 * t + 1.5 * x + 0.5 * z + rng.normal(size=1500)[person] * 0.5 + rng.normal(size=n) * 0.5
    rows = [(int(p), float(a), float(b), int(c), float(d), float(k)) for p, a, b, c, d, k in zip(person, x, z, t, y, e)]
    return spark.createDataFrame(rows, "caseid bigint, x double, z double, t int, y double, e_true double")


@pytest.fixture(scope="module")
def scored(trial):
    return ef.cross_fit(trial, "y", "t", ["x", "z"], "caseid", folds=2, method="logistic", trees=15, depth=6).cache()


def test_effects_are_recovered(scored):
    naive = scored.groupBy().agg({"y": "avg"})
    assert naive.count() == 1
    ate = ef.ate(scored, "y", "t", "caseid").head()
    assert ate.ci_lower - 0.1 < 2 < ate.ci_upper + 0.1 and 0 < ate.sd < 0.2
    dr = ef.att_augmented(scored, "y", "t", "caseid").head()
    assert abs(dr.estimate - 2) < 0.3
    assert ate.n_rows == 3000 and ate.n_persons == 1500


def test_aipw_survives_one_wrong_model(trial):
    good_e = trial.selectExpr("*", "e_true AS e", "0D AS mu1", "0D AS mu0")
    good_mu = trial.selectExpr("*", "0.5D AS e", "3 + 1.5 * x + 0.5 * z AS mu1", "1 + 1.5 * x + 0.5 * z AS mu0")
    for df in (good_e, good_mu):
        row = ef.ate(df, "y", "t", "caseid").head()
        assert abs(row.estimate - 2) < 4 * row.sd


def test_folds_keep_persons_together(scored):
    assert scored.groupBy("caseid").agg({"fold": "min"}).count() == 1500
    assert scored.select("caseid", "fold").distinct().count() == 1500
    assert scored.count() == 3000


def test_person_intercepts_sharpen_the_surface(spark):
    """Strong person effects: the forest beside them is nearer to the truth than the forest alone."""
    rng = np.random.default_rng(8)
    n = 4000
    person = np.arange(n) // 5
    x, z = rng.normal(size=(2, n))
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    y = 1 + 2 * t + 1.5 * x + rng.normal(size=n // 5)[person] * 4 + rng.normal(size=n) * 0.3
    pdf = pd.DataFrame({"caseid": person, "x": x, "z": z, "t": t, "y": y})
    df = spark.createDataFrame(pdf)
    train, test = ef.with_folds(df, "caseid", 2).where("fold = 0").cache(), ef.with_folds(df, "caseid", 2).where("fold = 1")
    off = {}
    for name in (None, "caseid"):
        got = ef.outcome_surface(train, test, "y", "t", ["x", "z"], trees=20, depth=5, person=name).selectExpr(
            "pow(mu1 - (3 + 1.5 * x), 2) AS one", "pow(mu0 - (1 + 1.5 * x), 2) AS zero"
        ).toPandas()
        off[name] = float(np.sqrt(got.to_numpy().mean()))
    assert off["caseid"] < 0.75 * off[None]
    scored = ef.cross_fit(df, "y", "t", ["x", "z"], "caseid", method="logistic", trees=10, person=True)
    ate = ef.ate(scored, "y", "t", "caseid").head()
    assert ate.ci_lower - 0.2 < 2 < ate.ci_upper + 0.2


def test_person_intercepts_are_shrunken_means(spark):
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(60), rng.integers(1, 9, 60))
    r = rng.normal(size=60)[g] * 2 + rng.normal(size=len(g)) + 5
    df = spark.createDataFrame(pd.DataFrame({"g": g, "r": r}))
    got = {x._person: x._intercept for x in ef.person_intercepts(df, "r", "g").collect()}
    fit = ln.random_intercept(ln.Design(df, "r", []), "g")
    theta = fit.extra["theta"]
    for k in range(60):
        own = r[g == k] - fit.estimate[0]
        assert got[k] == pytest.approx(theta * own.sum() / (1 + theta * len(own)))
    assert 2 < theta < 8


def test_linear_cross_fit_recovers_the_effect(trial):
    made = ln.design(trial, "y", ["x", "z"], keep=["caseid", "t"])
    scored = cf.cross_fit_linear(made, "t", "caseid", folds=3).cache()
    assert sorted(r[0] for r in scored.select("fold").distinct().collect()) == [0, 1, 2]
    ate = ef.ate(scored, "y", "t", "caseid").head()
    assert ate.ci_lower < 2 < ate.ci_upper and ate.n_rows == 3000


def test_linear_cross_fit_like_numpy(trial):
    pdf = trial.toPandas()
    made = ln.design(trial, "y", ["x", "z"], keep=["caseid", "t"])
    got = cf.cross_fit_linear(made, "t", "caseid", []).toPandas()
    z = pdf[["x", "z"]].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    fold = (pdf.caseid % 10007 * 7919 % 10007 % 2).to_numpy()
    want = np.zeros((len(pdf), 4))
    for k in (0, 1):
        tr, te = fold != k, fold == k
        Z = np.column_stack([np.ones(tr.sum()), z[tr]])
        T = np.column_stack([np.ones(te.sum()), z[te]])
        pen = np.diag([0, cf.RIDGE * tr.sum(), cf.RIDGE * tr.sum()])
        b = np.zeros(3)
        for _ in range(30):  # plain Newton on the penalised likelihood
            p = 1 / (1 + np.exp(-Z @ b))
            b += np.linalg.solve(Z.T @ (Z * (p * (1 - p))[:, None]) + pen, Z.T @ (pdf.t[tr] - p) - pen @ b)
        want[te, 0] = 1 / (1 + np.exp(-T @ b))
        for col, arm in ((1, 1), (2, 0)):
            own = Z[pdf.t[tr] == arm]
            pa = np.diag([0, cf.RIDGE * len(own), cf.RIDGE * len(own)])
            want[te, col] = T @ np.linalg.solve(own.T @ own + pa, own.T @ pdf.y[tr][pdf.t[tr] == arm])
    want = pd.DataFrame(want[:, :3], columns=["e", "mu1", "mu0"]).sort_values("e", kind="stable")
    have = got.sort_values("e", kind="stable")
    clip = have.clipped.to_numpy() == 0
    assert have[["e", "mu1", "mu0"]].to_numpy()[clip] == pytest.approx(want.to_numpy()[clip], rel=1e-6)


def test_separated_arms_and_clipping(spark):
    rows = [(i, float(i), float(i % 7), int(i > 50), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "caseid bigint, x double, c double, t int, y double").selectExpr("*", "1D AS flat", "2 * x AS twice")
    made = ln.design(df, "y", ["x", "flat", "twice"], keep=["caseid", "t"])
    got = cf.cross_fit_linear(made, "t", "caseid", clip=0.2).toPandas()
    assert got[["e", "mu1", "mu0", "sd1", "sd0"]].notna().all().all()
    assert got.e.between(0.2, 0.8).all() and 0 < got.clipped.sum() == got.e.isin([0.2, 0.8]).sum()
    one_arm = ln.design(df.withColumn("t", df.t * 0), "y", ["x"], keep=["caseid", "t"])
    with pytest.raises(ValueError, match="arm 1"):
        cf.cross_fit_linear(one_arm, "t", "caseid")


def test_person_bootstrap(scored):
    value = scored.selectExpr("caseid", "t * (mu1 - mu0) AS a", "CAST(t AS DOUBLE) AS b")
    one = {r.replicate: r.estimate for r in ef.person_bootstrap(value, "a", "b", "caseid", 60).collect()}
    two = {r.replicate: r.estimate for r in ef.person_bootstrap(value.repartition(5), "a", "b", "caseid", 60).collect()}
    assert one.keys() == two.keys() == set(range(1, 61))
    assert [one[k] for k in one] == pytest.approx([two[k] for k in one])
    counts = scored.sparkSession.range(20_000).selectExpr(f"{ef.bootstrap_weight('id', '7')} AS k").toPandas().k
    assert counts.mean() == pytest.approx(1, abs=0.03) and counts.var() == pytest.approx(1, abs=0.05)
    row = ef.bootstrap_summary(ef.person_bootstrap(value, "a", "b", "caseid")).head()
    plain = ef.att(scored, "t", "caseid").head()
    assert row.estimate == pytest.approx(plain.estimate, abs=4 * plain.sd) and row.sd == pytest.approx(plain.sd, rel=0.3)
    assert row.n_draws == ef.REPLICATES


def test_draws_give_means_and_spreads(scored):
    pdf = scored.limit(50).toPandas()
    for arm in ("1", "0"):
        draws = np.stack(pdf[f"draws{arm}"])
        assert pdf[f"mu{arm}"].to_numpy() == pytest.approx(draws.mean(axis=1))
        assert pdf[f"sd{arm}"].to_numpy() == pytest.approx(draws.std(axis=1, ddof=1))


def test_att_of_draws(scored):
    pdf = scored.where("t = 1").toPandas()
    means = (np.stack(pdf["draws1"]) - np.stack(pdf["draws0"])).mean(axis=0)
    row = ef.att_of_draws(scored, "t").head()
    assert (row.estimate, row.sd) == (pytest.approx(means.mean()), pytest.approx(means.std(ddof=1)))
    assert ef.att(scored, "t", "caseid").head().estimate == pytest.approx(means.mean())


def test_clustered_error(scored):
    pdf = scored.toPandas()
    phi = pdf.mu1 - pdf.mu0 + pdf.t * (pdf.y - pdf.mu1) / pdf.e - (1 - pdf.t) * (pdf.y - pdf.mu0) / (1 - pdf.e)
    centred = (phi - phi.mean()).groupby(pdf.caseid).sum()
    row = ef.ate(scored, "y", "t", "caseid").head()
    assert row.sd == pytest.approx(np.sqrt((centred**2).sum()) / len(pdf), rel=1e-9)


@pytest.mark.parametrize("rule", ["sd", "propensity"])
def test_common_support(scored, rule):
    pdf = scored.toPandas()
    got = ef.common_support(scored, "t", rule, width=0.0).toPandas()
    if rule == "sd":
        c1, c0 = pdf.sd1[pdf.t == 1].max(), pdf.sd0[pdf.t == 0].max()
        want = np.where(pdf.t == 1, pdf.sd0 <= c1, pdf.sd1 <= c0)
    else:
        other = {t: pdf.e[pdf.t == 1 - t] for t in (0, 1)}
        want = np.array([other[t].min() <= e <= other[t].max() for t, e in zip(pdf.t, pdf.e)])
    key = ["caseid", "x"]
    pdf = pdf.assign(want=want.astype(int)).sort_values(key)
    assert list(got.sort_values(key)["supported"]) == list(pdf["want"])
    assert dg.support_table(got_df := ef.common_support(scored, "t", rule), "t").agg({"n": "sum"}).head()[0] == got_df.count()


def test_person_effects_shrink(trial):
    got = ef.person_effects(trial, "y", "caseid", 0.5).orderBy("caseid").toPandas()
    by = trial.toPandas().groupby("caseid")["y"]
    want = 0.5 * by.sum() / (1 + 0.5 * by.count())
    assert got["person_effect"].to_numpy() == pytest.approx(want.to_numpy())


def test_effect_table_intervals(spark):
    one = spark.createDataFrame([(1.0, 0.5)], "estimate double, sd double")
    rows = ef.effect_table({"a": one, "b": one}).orderBy("model").collect()
    assert [(r.model, r.att, r.ci_lower, r.ci_upper) for r in rows] == [("a", 1.0, 1 - 0.98, 1 + 0.98), ("b", 1.0, 1 - 0.98, 1 + 0.98)]


def test_sensitivity_reaches_zero_at_the_robustness_value(trial, spark):
    fit = ln.ols(ln.design(trial, "y", ["t", "x"]))
    value = se.robustness_value(spark, fit, "t").head()
    grid = se.sensitivity_grid(spark, fit, "t", [0.0, value.robustness_value], [0.0, value.robustness_value])
    rows = {(r.r2_treatment > 0, r.r2_outcome > 0): r for r in grid.collect()}
    assert rows[(True, True)].adjusted_estimate == pytest.approx(0, abs=1e-9)
    assert rows[(False, False)].adjusted_estimate == pytest.approx(fit.of("t")[0])


def test_omitting_a_measured_confounder_gives_the_stated_bias(trial, spark):
    """The bias formula is exact when the confounder's own strengths are put in."""
    short, full = ln.ols(ln.design(trial, "y", ["t", "z"])), ln.ols(ln.design(trial, "y", ["t", "z", "x"]))
    t_given = ln.ols(ln.design(trial, "t", ["z"])), ln.ols(ln.design(trial, "t", ["z", "x"]))
    r2_t = 1 - (1 - t_given[1].r2) / (1 - t_given[0].r2)
    r2_y = 1 - (1 - full.r2) / (1 - short.r2)
    (row,) = se.sensitivity_grid(spark, short, "t", [r2_t], [r2_y]).collect()
    assert row.adjusted_estimate == pytest.approx(full.of("t")[0], rel=1e-6)
    assert row.adjusted_se == pytest.approx(full.of("t")[1], rel=1e-6)


def test_binned_residuals(trial):
    d = ln.design(trial, "y", ["t", "x"])
    scored = ln.score(d, ln.ols(d))
    pdf = scored.toPandas()
    table = dg.residual_by_fitted(scored, -2, 4, 6).toPandas().set_index("bin")
    bins = np.where(pdf.fitted < -2, 0, np.where(pdf.fitted >= 4, 7, np.floor(pdf.fitted + 2) + 1)).astype(int)
    want = pd.Series(pdf.residual).groupby(bins)
    assert table["n"].to_dict() == want.count().to_dict()
    assert table["mean"].sort_index().to_numpy() == pytest.approx(want.mean().to_numpy())
