import numpy as np
import pytest

from panelwave.operators import joins as jn
from panelwave.operators import medians as md


@pytest.mark.parametrize("kind", ["even", "odd", "ties", "pair", "signs"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "even": rng.normal(size=5000),
        "odd": rng.lognormal(size=4999),
        "ties": np.concatenate([np.full(2500, 3.0), rng.normal(3, 2, 5001)]),
        "pair": np.concatenate([np.zeros(2000), np.ones(2000)]),
        "signs": np.array([-1e200, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e200, 2.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = md.global_quantiles(df, "x", shares)
    assert got == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)


def test_all_conditions_take_four_passes(spark, monkeypatch):
    calls = []
    counted = md.digit_counts
    monkeypatch.setattr(md, "digit_counts", lambda *a: calls.append(a[1:]) or counted(*a))
    rng = np.random.default_rng(1)
    rows = [(float(v), int(g)) for v, g in zip(rng.lognormal(size=3000) - 1, rng.integers(0, 5, 3000))]
    df = spark.createDataFrame(rows, "x double, g int").repartition(7)
    shares = (0.25, 0.5, 0.75)
    found = md.quantiles(df, "x", shares, {str(g): f"g = {g}" for g in range(6)})
    assert len(calls) == 4 and all(len(slots) <= 6 * 6 for slots, _ in calls)
    for g in range(5):
        assert found[str(g)] == pytest.approx(list(np.quantile([v for v, k in rows if k == g], shares)), rel=1e-12)
    assert found["5"] == [None, None, None]


def test_passes_after_the_first_read_what_lies_under_the_prefixes(spark, monkeypatch):
    read = []
    counted = md.digit_counts
    monkeypatch.setattr(md, "digit_counts", lambda *a: read.append(a[0].cache().count()) or counted(*a))
    x = np.random.default_rng(5).lognormal(size=4000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 4000, "x double").repartition(5)
    assert md.global_median(df, "x") == pytest.approx(np.median(x), rel=1e-15)
    assert read[0] == 4000 and len(read) == 4 and max(read[1:]) < 1000


@pytest.mark.parametrize("values", [
    [-np.inf, -np.inf, 0.0, np.inf, np.inf], [-0.0, 0.0, -0.0], [-1.797e308, 1.797e308, np.inf], [-3.0, -3.0, -2.5],
])
def test_quantiles_at_the_ends_of_the_doubles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert md.global_quantiles(df, "x", (0.0, 0.5, 1.0)) == [min(values), sorted(values)[len(values) // 2], max(values)]


def test_order_of_doubles_is_kept():
    x = np.array([-np.inf, -1.5, -5e-324, 0.0, 5e-324, 1.5, np.inf])
    keys = md.ordered(x)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [md.unordered(int(k)) for k in keys] == x.tolist()
    assert md.ordered(np.array([-0.0]))[0] == md.ordered(np.array([0.0]))[0]


@pytest.mark.parametrize("accuracy", [20, 500])
def test_sketched_quantiles_keep_their_bound(spark, accuracy):
    x = np.random.default_rng(3).normal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(8)
    shares = (0.05, 0.5, 0.99)
    for share, got in zip(shares, md.global_quantiles(df, "x", shares, accuracy=accuracy)):
        assert abs((x <= got).mean() - share) <= 1 / accuracy + 1 / len(x)
    assert md.global_quantiles(df, "x", shares, "x > 100", accuracy=accuracy) == [None, None, None]
    with pytest.raises(ValueError):
        md.global_quantiles(df, "x", shares, accuracy=0)


def test_median_conditions_and_empty(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (9.0, 0)], "x double, g int")
    assert md.global_median(df, "x", where="g = 1") == 1.5
    assert md.global_median(df, "x", where="g = 7") is None


def test_cap_uses_median_of_flagged_rows(spark):
    df = spark.createDataFrame([(None,), (0.5,), (10.0,), (20.0,), (1000.0,)], "w double")
    got = {r.w_indicator: 0 for r in md.cap_k_median(df, "w", 5).collect()}
    assert set(got) == {0, 1}
    rows = sorted((r.w_indicator, r.w) for r in md.cap_k_median(df, "w", 5).where("w IS NOT NULL").collect())
    assert rows == [(0, 0.0), (0, 0.5), (1, 10.0), (1, 20.0)]
    assert md.cap_k_median(df, "w", 5).where("w IS NULL").count() == 1


def test_trim_median_is_over_all_rows(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 1), (100.0, 1), (-5.0, 1)], "w double, keep int")
    got = sorted(r.w for r in md.filter_below_k_median(df, "w", 5, "keep = 1").collect())
    assert got == [2.0, 3.0]


def test_natural_left_multiplies_and_null_keys(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "id int, year int")
    b = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (2, 5, "z")], "id int, year int, v string")
    plain = sorted(map(tuple, jn.natural_left(a, b).collect()))
    assert plain == [(1, None, None), (2, 5, "y"), (2, 5, "z")]
    safe = sorted(map(tuple, jn.natural_left(a, b, null_safe=True).collect()))
    assert safe == [(1, None, "x"), (2, 5, "y"), (2, 5, "z")]
    with pytest.raises(ValueError):
        jn.natural_left(a, b.select("v"))


def test_exclude_ids_with_null_in_list(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    ids = spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.id for r in jn.exclude_ids(df, ids, "id").collect()] == [2]


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "a")], "id int, x string")
    b = spark.createDataFrame([(2, 3.0)], "id int, y double")
    assert sorted(map(tuple, jn.stack(a, b).collect())) == [(1, "a", None), (2, None, 3.0)]
