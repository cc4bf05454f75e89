import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from panelwave.operators import linear as ln
from panelwave.operators.cohort import build_cohorts, difference_in_means
from panelwave.plans import models as mo
from panelwave.plans import panel as pn
from panelwave.plans import samples as sm
from panelwave.plans import topics as tp
from panelwave.sources import derived as dv
from panelwave.sources.shared import saved, saved_by_person

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def survey(spark):
    return saved(dv.survey_wide(spark, SMALL), "survey")


def ordered(df):
    return df.toPandas().sort_values(["caseid", "wave"]).reset_index(drop=True)


def test_joined_panel_plans_no_wide_projections(survey):
    plan = pn.join_panel(survey)._jdf.queryExecution().optimizedPlan().toString()
    assert "clean:" not in plan and len(plan) < 100_000


def test_joined_panel_sends_no_topic_through_the_driver(survey):
    panel = pn.join_panel(survey)
    panel.collect()
    for plan in (panel._jdf.queryExecution().sparkPlan(), panel._jdf.queryExecution().executedPlan()):
        assert "Broadcast" not in plan.toString()
    joins = panel._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin")
    assert joins == len(tp.JOINED_TOPICS) + 1


def test_joined_panel_deals_its_rows_before_most_topics(survey):
    node, met = pn.join_panel(survey)._jdf.queryExecution().executedPlan().initialPlan(), 0
    while "Exchange" not in node.nodeName():
        met += node.nodeName() == "SortMergeJoin"
        node = node.children().head()
    assert met == len(tp.JOINED_TOPICS) - 2


def test_joined_panel_of_an_unknown_person(survey):
    wide = survey.where("CASEID < 2").withColumn("CASEID", F.expr("nullif(CASEID, 1)"))
    fused, joined = pn.build_panel(wide, drugs_fixed=True), pn.join_panel(wide, drugs_fixed=True)
    assert joined.where("caseid IS NULL AND race IS NOT NULL").count() == 27
    pd.testing.assert_frame_equal(ordered(fused), ordered(joined))


def test_fused_panel_equals_join_chain(survey):
    fused, joined = pn.build_panel(survey), pn.join_panel(survey)
    assert fused.columns == joined.columns == list(pn.PANEL_COLUMNS)
    pd.testing.assert_frame_equal(ordered(fused), ordered(joined))


def test_panel_of_some_columns_reads_only_their_topics(survey):
    some = pn.build_panel(survey, columns=["caseid", "wave", "wages", "female"])
    whole = ordered(pn.build_panel(survey))[["caseid", "wave", "wages", "female"]]
    pd.testing.assert_frame_equal(ordered(some), whole)
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("ReadSchema: ")[1]
    assert "HRP1" in scan and "HGC" not in scan and "Exchange" not in plan


def test_fused_panel_has_no_exchange(survey):
    plan = pn.build_panel(survey)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_repeated_wave_needs_the_join_form(spark):
    wide = spark.createDataFrame(
        [(1, 20.0, 1.0, 2.0, 1.0, 1.0, 5.0)] ,
        "CASEID bigint, AGEATINT double, REGION double, `REGION.0` double, SAMPLE_RACE double, SAMPLE_SEX double, `AFQT.1` double",
    )
    with pytest.raises(ValueError, match="comes twice"):
        pn.build_panel(wide, columns=["caseid", "wave", "region"])
    table = tp.topic_table(wide, tp.REGION).orderBy("region").collect()
    assert [(r.wave, r.region) for r in table] == [(0, 1), (0, 2)]


def test_missing_codes_from_every_topic(spark):
    """A row whose answers are all missing codes has nothing but zero-filled flags."""
    answers = dv.survey_answers()
    names = ", ".join(f"`{c}` double" for c in answers)
    wide = spark.createDataFrame([(7, *[-4.0] * len(answers))], f"CASEID bigint, {names}")
    row = pn.build_panel(wide).where("wave = 3").head().asDict()
    zero = {"incarcerated", "ever_inc", "psector", "union", "total_weeks_worked", "lag_weeks_worked", "welfare_indicator"}
    assert {k for k, v in row.items() if v == 0} == zero
    assert {k for k, v in row.items() if v is not None} == zero | {"caseid", "wave", "year"}


def random_history(seed, people=60, waves=12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(people):
        seen = 0
        for w in range(waves):
            if rng.random() < 0.05:
                continue
            now = int(rng.random() < 0.12)
            ever = 0 if now else seen
            seen = max(seen, now)
            y = None if rng.random() < 0.1 else float(rng.normal())
            x = None if rng.random() < 0.1 else float(rng.integers(0, 9))
            rows.append((c, w, now, ever, y, x))
    return rows


@pytest.mark.parametrize("horizon", [1, 2, 3])
def test_cohorts_against_brute_force(spark, horizon):
    rows = random_history(horizon)
    schema = "caseid bigint, wave int, incarcerated int, ever_inc int, y double, x double"
    history = spark.createDataFrame(rows, schema)
    sample = history.where("caseid % 5 > 0 AND wave < 11")
    at = {(r[0], r[1]): r for r in rows}
    kept = {k: r for k, r in at.items() if k[0] % 5 > 0 and k[1] < 11}
    want = []
    for b in (1, 4, 6):
        for c in range(60):
            start, end = kept.get((c, b)), kept.get((c, b + horizon))
            later = [at.get((c, b + k)) for k in range(1, horizon + 1)]
            if start is None or start[2] or start[3] or end is None or end[2] or None in later:
                continue
            if start[5] is None or end[4] is None:
                continue
            want.append((b, c, max(r[3] for r in later), end[4], start[5]))
    got = build_cohorts(sample, history, "y", {"x": "x0"}, [1, 4, 6], horizon)
    assert got.columns == ["bl", "caseid", "treatment", "y", "x0"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_history_may_reach_beyond_the_sample(spark):
    sample = spark.createDataFrame([(1, 0, 0, 0, 1.0, 2.0), (1, 3, 0, 0, 5.0, 2.0)], "caseid bigint, wave int, incarcerated int, ever_inc int, y double, x double")
    history = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 0, 1), (1, 3, 0, 1)], "caseid bigint, wave int, incarcerated int, ever_inc int")
    (row,) = build_cohorts(sample, history, "y", ["x"], [0], 3).collect()
    assert tuple(row) == (0, 1, 1, 5.0, 2.0)
    with pytest.raises(ValueError, match="not unique"):
        build_cohorts(sample.union(sample), history, "y", ["x"], [0], 3, check_keys=True)
    assert difference_in_means(build_cohorts(sample, history, "y", ["x"], [0], 3), "y").head().mean_treated == 5.0


def test_cohorts_drop_null_status_and_nan(spark):
    schema = "caseid bigint, wave int, incarcerated int, ever_inc int, y double, x double"
    rows = [(c, w, 0, 0, 1.0, 2.0) for c in (1, 2, 3) for w in range(4)]
    rows[4 + 2] = (2, 2, None, 0, 1.0, 2.0)  # status unknown two waves ahead
    rows[8] = (3, 0, 0, 0, 1.0, float("nan"))  # covariate is no number
    df = spark.createDataFrame(rows, schema)
    assert [r.caseid for r in build_cohorts(df, df, "y", ["x"], [0]).collect()] == [1]


def test_cohorts_shuffle_sample_and_history_once(spark, survey):
    from panelwave.plans import samples as sm

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = saved(pn.build_panel(survey), "panel")
        made = sm.cohorts(sm.sample_two(panel), tp.topic_table(survey, tp.INCARCERATION))
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert "PushedFilters: [IsNotNull(female)" in plan


def test_one_person_with_a_third_of_all_orders(spark, tmp_path):
    """A hot customer is one row after the map side and gets the same answer as any other."""
    n = 30_000
    orders = spark.range(n).selectExpr(
        "id AS o_orderkey",
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS o_custkey",
        "CASE WHEN id % 7 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus",
        "CAST(id % 100 AS DOUBLE) AS o_totalprice",
        "CAST(date_add(DATE '1995-01-01', CAST(id % 2000 AS INT)) AS TIMESTAMP_NTZ) AS o_orderdate",
        "CASE WHEN id % 5 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority",
    )
    people = spark.range(50).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "1D AS c_acctbal")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    people.write.parquet(str(tmp_path / "customer.parquet"))
    got = ordered(dv.orders_panel(spark, str(tmp_path)))
    pdf = orders.toPandas()
    pdf["wave"] = pd.to_datetime(pdf.o_orderdate).dt.year - 1995
    want = pdf.groupby(["o_custkey", "wave"]).o_totalprice.agg(["sum", "count"])
    assert len(got) == 350 and got.n_jobs.sum() == n
    for row in got.dropna(subset=["n_jobs"]).itertuples():
        assert (row.wages, row.n_jobs) == tuple(want.loc[(row.caseid, row.wave)])


def test_names_that_do_not_tell_the_wave_keep_their_rows(spark):
    names = ["AGEATINT", "AGEATINT.1", "HGC", "ENROLLMTREVXX", "ENROLLMTREV79", "EMPLOYERS_ALL_UNION_19X9.01", "EMPLOYERS_ALL_UNION_1980.01"]
    found = {t.name: [c for c in t.rule.columns(names, "CASEID")] for t in (tp.AGE, tp.EDUCATION, tp.UNION)}
    located = {t.name: tp.located(tp.parse_names(names, t.rule, "CASEID"), t) for t in (tp.AGE, tp.EDUCATION, tp.UNION)}
    for name, columns in found.items():
        assert len(located[name]) == len(columns)  # none is dropped
    unknown = [s.column for at, s in (*located["education"], *located["union"]) if at is None]
    assert unknown == ["ENROLLMTREVXX", "EMPLOYERS_ALL_UNION_19X9.01"]
    for rows in located.values():
        places = [at is None for at, _ in rows]
        assert places == sorted(places)  # the unknown ones come last


def test_unknown_waves_match_unknown_ones_in_the_chain(spark):
    left = spark.createDataFrame([(1, 0, 20), (1, None, 21)], "caseid bigint, wave int, age int")
    right = spark.createDataFrame([(1, None, 5), (1, None, 6), (2, None, 7)], "caseid bigint, wave int, x int")
    got = sorted(map(tuple, pn.natural_left(left, right, null_safe=True).collect()), key=str)
    assert got == sorted([(1, 0, 20, None), (1, None, 21, 5), (1, None, 21, 6)], key=str)


def test_fused_panel_refuses_unknown_waves(spark):
    wide = spark.createDataFrame(
        [(1, 20.0, 2.0, 1.0, 1.0, 1.0)],
        "CASEID bigint, AGEATINT double, `EMPLOYERS_ALL_UNION_19X9.01` double, `EMPLOYERS_ALL_UNION_1979.01` double, SAMPLE_RACE double, SAMPLE_SEX double",
    )
    with pytest.raises(ValueError, match="join_panel"):
        pn.build_panel(wide, columns=["caseid", "wave", "union"])
    table = tp.topic_table(wide, tp.UNION).collect()
    assert sorted([(r.year, r.wave, r.union) for r in table], key=str) == [(1979, 0, 1), (None, None, 1)]


def exchanges(df) -> int:
    """Shuffles; a broadcast of one row per person that is small enough moves no rows of the panel."""
    return len(re.findall("(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()))


def test_panel_dealt_before_its_rows_are_made(spark, survey):
    panel = pn.build_panel(survey, parts=8)
    again = panel.repartition(8, "caseid")
    lines = again._jdf.queryExecution().executedPlan().toString().splitlines()
    at = {name: [i for i, x in enumerate(lines) if re.search(rf"\b{name}\b", x)] for name in ("Exchange", "Generate")}
    assert len(at["Exchange"]) == 1 and at["Generate"][0] < at["Exchange"][0]
    persons = panel.select("caseid", F.spark_partition_id().alias("p")).distinct()
    assert persons.count() == panel.select("caseid").distinct().count()
    pd.testing.assert_frame_equal(ordered(panel), ordered(pn.build_panel(survey)))


def test_panel_in_buckets_needs_no_exchange(spark, survey):
    panel = saved_by_person(pn.build_panel(survey), "panel_by_person", buckets=8)
    pd.testing.assert_frame_equal(ordered(panel), ordered(pn.build_panel(survey)))
    assert exchanges(sm.sample_two(panel)) == 0
    sample = saved_by_person(sm.sample_two(panel), "sample_by_person", buckets=8)
    person_sums = sample.groupBy("caseid").agg(F.sum("weeks_worked").alias("weeks"))
    assert exchanges(person_sums) == 0
    design = mo.naive_design(sample)
    assert exchanges(ln.group_sums(design, "caseid", np.zeros(len(design.terms) + 1))) == 0
    exposure = saved_by_person(tp.topic_table(survey, tp.INCARCERATION), "exposure_by_person", buckets=8)
    cohorts = sm.cohorts(sample, exposure)
    assert exchanges(cohorts) == 0
    plain = sm.cohorts(sm.sample_two(pn.build_panel(survey)), tp.topic_table(survey, tp.INCARCERATION))
    key = ["caseid", "bl"]
    pd.testing.assert_frame_equal(
        cohorts.toPandas().sort_values(key).reset_index(drop=True), plain.toPandas().sort_values(key).reset_index(drop=True)
    )
