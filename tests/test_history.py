import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwave.operators import history as hs
from panelwave.operators import inrow
from panelwave.operators import reshape as rs


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(3)
    rows = [
        (int(c), int(w), None if rng.random() < 0.4 else float(rng.integers(0, 5)), None if rng.random() < 0.2 else int(rng.random() < 0.2))
        for c in range(30)
        for w in sorted(rng.choice(12, size=rng.integers(1, 12), replace=False))
    ]
    pdf = pd.DataFrame(rows, columns=["caseid", "wave", "x", "s"])
    df = spark.createDataFrame(rows, "caseid bigint, wave int, x double, s int")
    return pdf, df


def same(got, want):
    want = [None if pd.isna(v) else v for v in want]
    assert [None if pd.isna(v) else v for v in got] == want


def test_windows_against_pandas(long):
    pdf, df = long
    by = pdf.groupby("caseid")
    got = (
        df.select(
            "caseid", "wave",
            hs.lead1("x").alias("lead"), hs.lag1("x").alias("lag"), hs.running_total("x").alias("run"),
            hs.total_before("x").alias("before"), hs.filled("x").alias("fill"), hs.value_at("x", 5).alias("at5"),
            hs.value_ahead("x", 3).alias("ahead3"),
        )
        .orderBy("caseid", "wave")
        .toPandas()
    )
    same(got["lead"], by["x"].shift(-1))
    same(got["lag"], by["x"].shift(1))
    run = pdf["x"].fillna(0).groupby(pdf["caseid"]).cumsum()
    same(got["run"], run)
    same(got["before"], run.groupby(pdf["caseid"]).shift(1))
    same(got["fill"], by["x"].ffill())
    at = {(r.caseid, r.wave): r.x for r in pdf.itertuples()}
    same(got["at5"], [at.get((c, 5), np.nan) for c in pdf["caseid"]])
    same(got["ahead3"], [at.get((c, w + 3), np.nan) for c, w in zip(pdf["caseid"], pdf["wave"])])


def test_exposure_history(long):
    pdf, df = long
    got = hs.exposure_history(df, "s", "ever").orderBy("caseid", "wave").toPandas()
    s = pdf["s"].fillna(0)
    seen = s.groupby(pdf["caseid"]).cummax()
    assert list(got["ever"]) == [0 if now else int(past) for now, past in zip(s, seen)]
    assert list(got["s"]) == list(s)


def test_backfill_only_the_missing_wave(spark):
    rows = [(1, 4, None), (1, 5, 7.0), (2, 4, 3.0), (2, 5, 9.0), (3, 4, None), (3, 6, 1.0)]
    df = spark.createDataFrame(rows, "caseid int, wave int, x double")
    got = [r.x for r in hs.backfill_from(df, "x", 4, 5).orderBy("caseid", "wave").collect()]
    assert got == [7.0, 7.0, 3.0, 9.0, None, 1.0]


def test_one_exchange_and_sort_for_all_windows(long):
    _, df = long
    mixed = df.select("caseid", hs.lead1("x"), hs.running_total("x"), hs.filled("x"), hs.value_at("x", 5), hs.value_ahead("x", 3))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_in_row_equals_windows(long, spark):
    _, df = long
    grid = spark.range(30).selectExpr("id AS caseid", "explode(sequence(0, 11)) AS wave").join(df, ["caseid", "wave"], "left")
    full = hs.exposure_history(grid, "s", "ever")
    want = full.select(
        "caseid", "wave", hs.lead1("x").alias("lead"), hs.lag1("x").alias("lag"), hs.running_total("x").alias("run"),
        hs.filled("x").alias("fill"), F.col("ever").cast("int").alias("ever"),
    )
    cells = [F.max(F.when(F.col("wave") == w, F.col(c))).alias(f"{c}{w}") for c in ("x", "s") for w in range(12)]
    wide = grid.groupBy("caseid").agg(*cells)
    x = [f"x{w}" for w in range(12)]
    s = [f"coalesce(s{w}, 0)" for w in range(12)]
    wide = wide.selectExpr("*", f"{inrow.running_totals(x)} AS totals", f"{inrow.first_exposed(s)} AS first")
    series = {
        "lead": inrow.lead1(x), "lag": inrow.lag1(x), "run": inrow.running_total("totals", 12),
        "fill": inrow.ffill(x), "ever": inrow.exposure_history(s, "first"),
    }
    rows = [{"wave": str(w), **{k: v[w] for k, v in series.items()}} for w in range(12)]
    got = inrow.emit_rows(wide, ["caseid"], rows)
    order = ["caseid", "wave"]
    pd.testing.assert_frame_equal(
        got.orderBy(*order).toPandas(), want.orderBy(*order).toPandas(), check_dtype=False
    )


def test_emitted_rows_are_compiled_once(spark):
    wide = spark.createDataFrame([(1, 2.0), (None, None), (1, 2.0)], "caseid int, x double")
    rows = [{"wave": str(w), "y": f"CASE WHEN x > {w} THEN x * {w} END"} for w in range(3)]
    got = inrow.emit_rows(wide, ["caseid"], rows, projected=True)
    want = [(c, w, x * w if x is not None and x > w else None) for c, x in [(1, 2.0), (None, None), (1, 2.0)] for w in range(3)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("CASE" in line for line in lines) == 1
    assert not any("Generate" in line and "CASE" in line for line in lines)


def test_melt_and_spread_are_inverse(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0)], "id int, `a.1` double, `b.2` double")
    long = rs.melt_panel(df, "id", ["a.1", "b.2"], "v")
    assert long.count() == 4
    back = rs.spread(long, ["id"], "variable", "v", ["a.1", "b.2"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.collect()]
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()


def test_spread_rejects_repeated_cells(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "id int, n string, v double")
    with pytest.raises(Exception, match="more than one row"):
        rs.spread(df, ["id"], "n", "v", ["a"]).collect()


def test_any_positive_counts_null_as_zero(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (3, 1.0), (3, -1.0)], "id int, v double")
    assert sorted(map(tuple, rs.any_positive(df, ["id"], "v").collect())) == [(1, 1), (2, 0), (3, 0)]
