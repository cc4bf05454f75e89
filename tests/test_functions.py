import math

import pytest

from panelwave.functions import nullsafe as ns
from panelwave.functions import recode as rc
from panelwave.functions import waves as wv


def column(spark, values, expr, dtype="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").selectExpr(expr).collect()]


def test_flags_keep_missing_answers_missing(spark):
    values = [1.0, 2.0, None, 3.0]
    assert column(spark, values, rc.flag_equal("x", 2)) == [0, 1, None, 0]
    assert column(spark, values, rc.flag_in("x", (2, 3))) == [0, 1, None, 1]
    assert column(spark, values, rc.flag_positive("x - 2")) == [0, 0, None, 1]
    assert column(spark, values, rc.flag_at_least("x", 2)) == [0, 1, None, 1]
    assert column(spark, values, ns.null_if("x < 2", "x")) == [None, 2.0, None, 3.0]


def test_sentinels(spark):
    values = [-1.0, -5.0, 0.0, 7.0, None, -6.0]
    assert column(spark, values, ns.null_sentinel("x")) == [None, None, 0.0, 7.0, None, -6.0]
    assert column(spark, values, ns.flag_sentinel("x", -5)) == [0, 1, 0, 0, None, 0]
    df = spark.createDataFrame([(1, -4.0, -4.0)], "id int, `a.b` double, c double")
    assert ns.null_sentinels(df, cols=["a.b"]).head().asDict() == {"id": 1, "a.b": None, "c": -4.0}


def test_fill_only_where_witness_answered(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (1, None), (0, 1)], "x int, w int")
    got = [r[0] for r in df.selectExpr(ns.fill_if_observed("x", "w")).collect()]
    assert got == [0, None, 1, 0]


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "caseid int, wave int")
    assert ns.assert_unique(df, ["caseid", "wave"]) is df
    with pytest.raises(ValueError, match="not unique"):
        ns.assert_unique(df, ["caseid"])


def test_bins_cover_every_code(spark):
    def expected(v):
        if v is None:
            return None
        for above, below, label in ((66, 399, 1), (-1e9, 58, 2), (406, 480, 3), (506, 699, 4), (706, 899, 5)):
            if above < v < below:
                return label
        return 6

    values = [float(v) for v in range(0, 1000)] + [None]
    assert column(spark, values, rc.bin_ranges("x")) == [expected(v) for v in values]


def test_deflation_policies_and_logs(spark):
    df = spark.createDataFrame([(4, 97.8), (20, 185.2), (21, 100.0), (3, None)], "wave int, x double")
    null = [r[0] for r in df.selectExpr(rc.deflate("x", "wave")).collect()]
    nominal = [r[0] for r in df.selectExpr(rc.deflate("x", "wave", otherwise="nominal")).collect()]
    assert null[:2] == pytest.approx([100, 100]) and null[2:] == [None, None]
    assert nominal[:3] == pytest.approx([100, 100, 100]) and nominal[3] is None
    with pytest.raises(ValueError):
        rc.deflate("x", "wave", otherwise="zero")
    assert column(spark, [0.0, math.e - 1], rc.log_shifted("x")) == pytest.approx([0, 1])
    assert column(spark, [100.0], rc.log_scaled("x", 100)) == [0.0]


def test_row_max_skips_nulls(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.selectExpr(rc.row_max("a", "b", "c")).collect()] == [1, None]


def test_wave_rules_agree_in_both_forms(spark):
    years = [float(y) for y in range(1979, 2021)]
    assert column(spark, years, wv.wave_of_year("x")) == [wv.year_to_wave(y) for y in years]
    assert wv.year_to_wave(1994) == 15 and wv.year_to_wave(1996) == 16 and wv.year_to_wave(1998) == 17
    assert [wv.year_to_wave(wv.wave_to_year(k)) for k in range(27)] == list(range(27))
    short = [float(y) for y in range(0, 100)]
    assert column(spark, short, wv.expand_year("x")) == [wv.full_year(y) for y in short]
    assert wv.full_year(50) == 50 and wv.full_year(49) == 2049 and wv.full_year(79) == 1979
    numbers = [0.0, 26.0, 30.0, 31.0, 1979.0, 1994.0, 1995.0, 1996.0, 2016.0]
    assert column(spark, numbers, wv.school_wave_of("x")) == [wv.school_wave(n) for n in numbers]
    assert wv.school_wave(1995) == 1995


def test_drug_lookup_both_readings(spark):
    for stem in ("D11", "D15", "DRUG"):
        assert [wv.drug_wave(stem, j) for j in range(5)] == [5] * 5
    assert [wv.drug_wave("D19", j) for j in range(4)] == [13, 15, 19, 5]
    assert [wv.drug_wave("D11", j, fixed=True) for j in range(5)] == [5, 9, 13, 15, 19]
    assert wv.drug_wave("DRUG", 1, fixed=True) == 5
    df = spark.createDataFrame([("D11", 2), ("D19", 1), ("DRUG", 1), ("D15", 9)], "stem string, wave int")
    moved = df.selectExpr(wv.remap_wave("stem", "wave", wv.DRUG_WAVES, 5)).collect()
    assert [r[0] for r in moved] == [13, 15, 5, 5]


def test_names_parsed_at_run_time(spark):
    df = spark.createDataFrame([("URBAN.RURAL.3",), ("URBAN.RURAL",), ("URBAN.RURAL.AB",), ("URBAN.RURAL.2.9",)], "v string")
    edited = wv.edit_name("v", ("URBAN.", ""))
    rows = df.selectExpr(wv.name_stem(edited), wv.name_wave(edited)).collect()
    assert [tuple(r) for r in rows] == [("RURAL", 3), ("RURAL", 0), ("RURAL", 0), ("RURAL", 2)]
