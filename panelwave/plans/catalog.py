"""Every operator as a named query over the test tables.

The written survey, panel, samples and cohorts are shared by the queries of one
Spark application, as the cleaned panel is by all analyses of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwave.functions import nullsafe as ns
from panelwave.functions import recode as rc
from panelwave.functions import waves as wv
from panelwave.operators import cohort as co
from panelwave.operators import crossfit as cf
from panelwave.operators import diagnostics as dg
from panelwave.operators import effects as ef
from panelwave.operators import history as hs
from panelwave.operators import joins as jn
from panelwave.operators import linear as ln
from panelwave.operators import medians as md
from panelwave.operators import reshape as rs
from panelwave.operators import sensitivity as se
from panelwave.plans import models as mo
from panelwave.plans import panel as pn
from panelwave.plans import samples as sm
from panelwave.plans import topics as tp
from panelwave.sources import derived as dv
from panelwave.sources import names as nm
from panelwave.sources.shared import saved, saved_by_person, shared_dir
from panelwave.sources.survey_csv import read_wide

_written: dict[tuple, DataFrame] = {}


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Files of the tables that the written ones are made of, with sizes and times: new data, new tables."""
    out = []
    for name in ("customer", "orders"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(out)


def written_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return (spark.conf.get("spark.app.id"), sf_dir, name, stamp(spark, sf_dir))


def once(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], DataFrame] = saved,
) -> DataFrame:
    key = written_key(spark, sf_dir, name)
    if key not in _written:
        _written[key] = write(build(), name)
    return _written[key]


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "survey", lambda: dv.survey_wide(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    build = lambda: pn.build_panel(survey(spark, sf_dir), parts=parts)
    return once(spark, sf_dir, "panel", build, saved_by_person)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark, sf_dir, "history", lambda: tp.topic_table(survey(spark, sf_dir), tp.INCARCERATION), saved_by_person
    )


def sample_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "sample_one", lambda: sm.sample_one(panel(spark, sf_dir)), saved_by_person)


def sample_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "sample_two", lambda: sm.sample_two(panel(spark, sf_dir)), saved_by_person)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "cohort",
        lambda: sm.cohorts(sample_two(spark, sf_dir), history(spark, sf_dir)),
    )


def sig(value: str, name: str, digits: int = 6) -> str:
    """A number to ``digits`` significant digits after the first."""
    return f"try_cast(format_string('%.{digits}e', {value}) AS DOUBLE) AS {name}"


def six(*names: str) -> list[str]:
    return [f"round({n}, 6) AS {n}" for n in names]


# --- sources, selection, missing values, reshape ----------------------------------


def read_wide_csv(spark, sf_dir):
    """The whole survey written as CSV files whose headers repeat, and read back.

    A survey that the session has written already is read; else the survey goes straight into these files,
    its answers as whole numbers, and no other copy is made.
    """
    wide = _written.get(written_key(spark, sf_dir, "survey"))
    if wide is None:
        wide = dv.survey_wide(spark, sf_dir, "BIGINT")
    path = f"{shared_dir(spark)}/{spark.conf.get('spark.app.id')}/csv-{uuid.uuid4().hex[:8]}"
    repeated = wide.toDF(*dv.repeated_headers(wide.columns))
    repeated.write.csv(path, header=True, ignoreTrailingWhiteSpace=False)
    return nm.snake_names(read_wide(spark, path))


def select_and_drop(spark, sf_dir):
    wide = nm.select_prefix(survey(spark, sf_dir), "hrp1", "SAMPLE", "REGION", keep=["CASEID"])
    return nm.snake_names(nm.drop_like(wide, names=["REGION"], prefixes=["REGION.1", "region.2"], contains=["RP1.2"]))


def select_by_substring(spark, sf_dir):
    return nm.snake_names(nm.select_contains(survey(spark, sf_dir), "qes.56c", keep=["CASEID"]))


def sentinel_null(spark, sf_dir):
    wide = survey(spark, sf_dir)
    return nm.snake_names(ns.null_sentinels(wide, cols=[c for c in wide.columns if c != "CASEID"]))


def melt_keep_nulls(spark, sf_dir):
    wide = nm.select_prefix(survey(spark, sf_dir), "AGEATIN", keep=["CASEID"])
    clean = ns.null_sentinels(wide, cols=wide.columns[1:])
    return rs.melt_panel(clean, "CASEID", wide.columns[1:], "age").withColumnRenamed("CASEID", "caseid")


def name_to_wave(spark, sf_dir):
    """Names parsed at run time: stem, wave, answers given and missing."""
    wide = nm.select_prefix(survey(spark, sf_dir), "WKSWK", "MARSTAT", keep=["CASEID"])
    long = rs.melt_panel(wide, "CASEID", wide.columns[1:], "answer")
    edited = wv.edit_name("variable", ("K.PCY", ""), ("T.KEY", ""))
    return (
        long.selectExpr(
            f"{wv.name_stem(edited)} AS stem",
            f"{wv.name_wave(edited)} AS wave",
            f"{ns.null_sentinel('answer')} AS answer",
        )
        .groupBy("stem", "wave")
        .agg(F.count("answer").alias("n_answers"), F.count("*").alias("n_rows"))
    )


def spread_two_stems(spark, sf_dir):
    """School columns melted, parsed at run time and spread to one column per stem."""
    wide = nm.select_prefix(survey(spark, sf_dir), "HGC", "ENROLLMTREV", keep=["CASEID"])
    clean = ns.null_sentinels(wide, cols=wide.columns[1:])
    long = rs.melt_panel(clean, "CASEID", wide.columns[1:], "answer")
    edited = wv.edit_name("variable", ("HGC", "edyears"), ("TREV", "."))
    parsed = long.selectExpr(
        "CASEID AS caseid", "answer", f"{wv.name_stem(edited)} AS stem", f"{wv.name_wave(edited)} AS number"
    ).selectExpr(
        "caseid",
        "answer",
        "stem",
        wv.school_wave_of(f"CASE WHEN stem = 'edyears' THEN number ELSE {wv.expand_year('number')} END")
        + " AS wave",
    )
    out = rs.spread(parsed, ["caseid", "wave"], "stem", "answer", ["edyears", "ENROLLM"])
    return out.selectExpr(
        "caseid",
        "CAST(wave AS INT) AS wave",
        "CAST(edyears AS INT) AS edyears",
        f"{rc.flag_in('ENROLLM', (2, 3))} AS enrolled",
    )


def wave_shift(spark, sf_dir):
    """Income stems moved to their waves at run time."""
    wide = nm.select_prefix(survey(spark, sf_dir), "Q13.5", keep=["CASEID"])
    long = rs.melt_panel(wide, "CASEID", wide.columns[1:], "answer")
    edited = wv.edit_name("variable", ("3.5", ""))
    parsed = long.selectExpr(
        f"{wv.name_stem(edited)} AS stem", f"{wv.name_wave(edited)} AS number",
        f"{ns.null_sentinel('answer')} AS answer",
    )
    return (
        parsed.selectExpr("stem", f"{wv.shift_wave('stem', 'number', wv.INCOME_SHIFT)} AS wave", "answer")
        .groupBy("stem", "wave")
        .agg(F.count("answer").alias("n_answers"), F.sum("answer").cast("bigint").alias("total"))
    )


def wave_lookup(spark, sf_dir):
    """Drug items moved to their waves by a lookup at run time, both readings of it."""
    wide = nm.select_prefix(survey(spark, sf_dir), "DS", "DRUG", keep=["CASEID"])
    long = rs.melt_panel(wide, "CASEID", wide.columns[1:], "answer")
    edited = wv.edit_name("variable", ("S.", ""))
    parsed = long.selectExpr(
        f"{wv.name_stem(edited)} AS stem", f"{wv.name_wave(edited)} AS number",
        f"{ns.null_sentinel('answer')} AS answer",
    )
    kept = {wv.DRUG_KEPT_STEM: wv.DRUG_WAVES[wv.DRUG_KEPT_STEM]}
    return (
        parsed.selectExpr(
            "stem",
            f"{wv.remap_wave('stem', 'number', kept, wv.DRUG_DEFAULT_WAVE)} AS wave",
            f"{wv.remap_wave('stem', 'number', wv.DRUG_WAVES, wv.DRUG_DEFAULT_WAVE)} AS wave_fixed",
            "answer",
        )
        .groupBy("stem", "wave", "wave_fixed")
        .agg(F.count("answer").alias("n_answers"), F.sum("answer").cast("bigint").alias("total"))
    )


def year_to_wave(spark, sf_dir):
    """Waves of the union years, by the run-time form of the rule."""
    return tp.topic_table(survey(spark, sf_dir), tp.UNION).selectExpr(
        "caseid", "year", f"CAST({wv.wave_of_year('year')} AS INT) AS wave"
    )


def fill_if_observed(spark, sf_dir):
    wide = nm.snake_names(
        ns.null_sentinels(nm.select_prefix(survey(spark, sf_dir), "POLICE", keep=["CASEID"]))
    )
    return wide.selectExpr(
        "caseid",
        "police_1",
        *[f"{ns.fill_if_observed(c, 'police_1')} AS {c}" for c in ("police_2", "police_3", "police_6", "police_7")],
    )


def three_valued_flags(spark, sf_dir):
    """Flags of customers with a negative balance taken as a missing answer."""
    persons = dv.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS caseid", "CASE WHEN c_acctbal >= 0 THEN c_nationkey % 4 END AS code"
    )
    return persons.selectExpr(
        "caseid",
        f"{rc.flag_equal('code', 2)} AS is_two",
        f"{rc.flag_in('code', (2, 3))} AS is_two_or_three",
        f"{rc.flag_positive('code')} AS is_positive",
        f"{rc.flag_at_least('code', 1)} AS at_least_one",
        f"{ns.fill_const('code', -10)} AS coded",
    )


def bin_ranges(spark, sf_dir):
    """Industry classes of all part sizes and supplier codes seen in the line items."""
    codes = dv.table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber < 7 THEN (l_partkey * 7 + l_suppkey) % 950 END AS code"
    )
    return codes.selectExpr("code", f"{rc.bin_ranges('code')} AS industry").groupBy("code", "industry").count().withColumnRenamed("count", "n")


def any_positive_by_year(spark, sf_dir):
    """Whether a customer had an exposing order in a year; sums skip nulls."""
    orders = dv.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS caseid",
        "year(o_orderdate) AS year",
        "CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS answer",
    )
    return rs.any_positive(orders, ["caseid", "year"], "answer", "flag")


def any_positive_by_wave(spark, sf_dir):
    lines = dv.table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS caseid",
        "datediff(l_shipdate, DATE '1995-01-01') DIV 30 AS wave",
        "CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN 0D END AS answer",
    )
    return rs.any_positive(lines, ["caseid", "wave"], "answer", "flag")


# --- topics ------------------------------------------------------------------------


def topic(which: tp.Topic):
    return lambda spark, sf_dir: tp.topic_table(survey(spark, sf_dir), which)


def topic_welfare(spark, sf_dir):
    return pn.welfare_table(survey(spark, sf_dir))


def topic_static(spark, sf_dir):
    return tp.static_table(survey(spark, sf_dir))


def panel_join_chain(spark, sf_dir):
    return pn.join_panel(survey(spark, sf_dir))


def panel_drugs_fixed(spark, sf_dir):
    return pn.build_panel(
        survey(spark, sf_dir), columns=["caseid", "wave", "drugs"], drugs_fixed=True
    )


# --- history operators on long tables -------------------------------------------------


def lead_lag_running(spark, sf_dir):
    days = dv.events_panel(spark, sf_dir)
    return days.select(
        "caseid",
        "wave",
        "weeks_worked",
        hs.lead1("weeks_worked").alias("next_weeks"),
        hs.lag1("weeks_worked").alias("previous_weeks"),
        hs.running_total("weeks_worked").alias("total_weeks"),
        hs.total_before("weeks_worked").alias("lag_total_weeks"),
    )


def ffill(spark, sf_dir):
    return hs.ffill(dv.events_panel(spark, sf_dir).select("caseid", "wave", "drugs"), ["drugs"])


def backfill_from_wave(spark, sf_dir):
    orders = dv.orders_panel(spark, sf_dir).select("caseid", "wave", "n_jobs")
    return hs.backfill_from(orders, "n_jobs", 0, 1)


def exposure_history(spark, sf_dir):
    orders = dv.orders_panel(spark, sf_dir).select("caseid", "wave", "incarcerated")
    return hs.exposure_history(orders, "incarcerated", "ever_inc")


def exposure_history_sparse(spark, sf_dir):
    days = dv.events_panel(spark, sf_dir).select("caseid", "wave", "incarcerated")
    return hs.exposure_history(days, "incarcerated", "ever_inc")


# --- recodes, medians --------------------------------------------------------------------


def deflate_and_log(spark, sf_dir):
    men = panel(spark, sf_dir).select("caseid", "wave", "wages", "income_past_year", "age")
    return men.selectExpr(
        "caseid",
        "wave",
        f"round({rc.deflate('wages', 'wave', otherwise='nominal')}, 6) AS wages_real",
        f"round({rc.deflate('income_past_year', 'wave')}, 6) AS income_real",
        f"round({rc.log_shifted('wages')}, 6) AS log_wages",
        f"round({rc.log_scaled('age', 100)}, 6) AS log_age_share",
    )


def rowwise_max(spark, sf_dir):
    wide = nm.snake_names(
        ns.null_sentinels(nm.select_prefix(survey(spark, sf_dir), "DS.", keep=["CASEID"]))
    )
    answers = [c for c in wide.columns if c != "caseid"]
    return wide.selectExpr("caseid", f"{rc.row_max(*answers)} AS largest")


def cap_k_median(spark, sf_dir):
    days = dv.events_panel(spark, sf_dir).select("caseid", "wave", "welfare")
    return md.cap_k_median(days, "welfare", 2)


def filter_below_k_median(spark, sf_dir):
    orders = dv.orders_panel(spark, sf_dir).select("caseid", "wave", "wages")
    return md.filter_below_k_median(orders, "wages", 2)


def global_medians(spark, sf_dir):
    lines = dv.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_returnflag")
    return dg.quantile_table(
        lines,
        "l_extendedprice",
        (0.25, 0.5, 0.9),
        {"all": "true", "returned": "l_returnflag = 'R'"},
    )


# --- joins ----------------------------------------------------------------------------------


def exclude_ids(spark, sf_dir):
    orders = dv.orders_panel(spark, sf_dir)
    exposed = orders.where("incarcerated = 1").select("caseid").distinct()
    return jn.exclude_ids(orders.select("caseid", "wave", "wages"), exposed, "caseid")


def attach_wave(spark, sf_dir):
    orders = dv.orders_panel(spark, sf_dir)
    start = orders.where("wave = 2").selectExpr("caseid", "wages AS wages_t0")
    first = jn.attach_wave(start, orders, 3, {"wages": "wages_t1", "n_jobs": "jobs_t1"})
    return jn.attach_wave(first, orders, 5, {"wages": "wages_t3"})


def null_safe_join(spark, sf_dir):
    """Region totals joined back where a missing region matches a missing region."""
    nations = dv.table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS c_nationkey", "CASE WHEN n_regionkey < 4 THEN n_regionkey END AS region"
    )
    persons = dv.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = jn.natural_left(persons, nations)
    totals = placed.groupBy("region").agg(F.count("*").alias("n_region"))
    return jn.natural_left(placed, totals, null_safe=True)


def stack_missing_columns(spark, sf_dir):
    suppliers = dv.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "s_nationkey AS nation", "'supplier' AS kind"
    )
    customers = dv.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_mktsegment AS segment", "'customer' AS kind"
    )
    return jn.stack(suppliers, customers)


# --- samples and cohorts -----------------------------------------------------------------------

SAMPLE_LOGS_ONE = ("log_age", "log_weeks", "cog_ability", "wages_deflated", "log_wages")
SAMPLE_LOGS_TWO = (
    "log_age", "log_weeks", "cog_ability", "wages_deflated", "income_current_y_d",
    "income_past_year_d", "log_wages", "log_income_current_y", "log_income_past_y",
    "wages_nas", "income_current_y_nas", "income_past_year_nas",
)
COHORT_REALS = ("log_wages", "wages_t0", "cog_ability", "income_current_y_nas", "income_past_year_nas")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[f"round({c}, 6) AS {c}" if c in names else c for c in df.columns])


def sample_one_query(spark, sf_dir):
    return rounded(sample_one(spark, sf_dir), *SAMPLE_LOGS_ONE)


def sample_two_query(spark, sf_dir):
    return rounded(sample_two(spark, sf_dir), *SAMPLE_LOGS_TWO)


def cohort_one(spark, sf_dir):
    one = sm.cohorts(sample_two(spark, sf_dir), history(spark, sf_dir), baselines=[8])
    return rounded(one, *COHORT_REALS)


def cohort_all(spark, sf_dir):
    return rounded(cohort(spark, sf_dir), *COHORT_REALS)


def orders_cohorts(spark, sf_dir) -> DataFrame:
    """Cohorts of the yearly orders panel at baselines 0 to 3, written once for the queries on them."""
    def build():
        rows = hs.exposure_history(dv.orders_panel(spark, sf_dir), "incarcerated", "ever_inc")
        return co.build_cohorts(rows, rows, "wages", {"wages": "wages_t0", "n_jobs": "n_jobs"}, [0, 1, 2, 3])

    return once(spark, sf_dir, "orders_cohorts", build)


def treatment_identity(spark, sf_dir):
    """Treated rows are exactly those exposed one or two waves ahead; counts violations."""
    rows = hs.exposure_history(dv.orders_panel(spark, sf_dir), "incarcerated", "ever_inc")
    made = co.build_cohorts(rows, rows, "wages", {"wages": "wages_t0"}, [0, 1, 2, 3])
    ahead = rows.select(
        "caseid",
        F.col("wave").alias("bl"),
        hs.value_ahead("incarcerated", 1).alias("t1"),
        hs.value_ahead("incarcerated", 2).alias("t2"),
        hs.value_ahead("incarcerated", 3).alias("t3"),
    )
    return made.join(ahead, ["caseid", "bl"]).agg(
        F.count("*").alias("n_rows"),
        F.count(F.expr("CASE WHEN treatment <> CASE WHEN (t1 = 1 OR t2 = 1) AND t3 = 0 THEN 1 ELSE 0 END THEN 1 END")).alias("n_bad"),
    )


def diff_in_means(spark, sf_dir):
    found = co.difference_in_means(orders_cohorts(spark, sf_dir), "wages")
    return found.selectExpr(
        "n_treated", "n_control",
        *[f"round({c}, 4) AS {c}" for c in ("mean_treated", "mean_control", "difference")],
    )


# --- regressions -------------------------------------------------------------------------------


def coefficients(spark, fit) -> DataFrame:
    return ln.coef_table(spark, fit).selectExpr(
        "pos", "term", sig("estimate", "estimate"), sig("se", "se")
    )


def fit_summary(spark, fit) -> DataFrame:
    return ln.fit_table(spark, fit).selectExpr(
        "n", "k", "df", sig("sigma", "sigma"), sig("r2", "r2")
    )


def orders_design(spark, sf_dir, *terms: str):
    return ln.design(orders_cohorts(spark, sf_dir), "wages", terms, keep=["caseid", "bl"])


def design_matrix(spark, sf_dir):
    return rounded(mo.cohort_design(cohort(spark, sf_dir)).df, *COHORT_REALS)


def design_levels(spark, sf_dir):
    """Dummies for levels found in the data, first one dropped, rows with nulls left out."""
    persons = dv.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_nationkey % 5 AS nation", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal",
        "CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment",
    )
    made = ln.design(persons, "bal", [], ["nation", "segment"], ["c_custkey"])
    return nm.snake_names(made.df)


def ols_1(spark, sf_dir):
    return coefficients(spark, ln.ols(orders_design(spark, sf_dir, "treatment")))


def ols_2(spark, sf_dir):
    return coefficients(spark, ln.ols(orders_design(spark, sf_dir, "treatment", "wages_t0")))


def wage_ols(spark, sf_dir):
    return coefficients(spark, ln.ols(mo.wage_design(sample_one(spark, sf_dir))))


def wage_ols_reported(spark, sf_dir):
    return coefficients(spark, ln.ols(mo.wage_design_reported(sample_one(spark, sf_dir))))


def naive_ols(spark, sf_dir):
    return coefficients(spark, ln.ols(mo.naive_design(sample_two(spark, sf_dir))))


def cohort_ols(spark, sf_dir):
    return coefficients(spark, ln.ols(mo.cohort_design(cohort(spark, sf_dir))))


def cohort_ols_fit(spark, sf_dir):
    return fit_summary(spark, ln.ols(mo.cohort_design(cohort(spark, sf_dir))))


def collinear_ols(spark, sf_dir):
    """A term that repeats earlier ones has null estimates; the others are unharmed."""
    twice = cohort(spark, sf_dir).selectExpr(
        "caseid", "log_wages", "treatment", "wages_t0", "age",
        "2 * age - wages_t0 AS mixed", "1D AS constant",
    )
    made = ln.design(twice, "log_wages", ["treatment", "wages_t0", "age", "mixed", "constant"])
    return coefficients(spark, ln.ols(made))


def within_ols_1(spark, sf_dir):
    rows = hs.exposure_history(dv.orders_panel(spark, sf_dir), "incarcerated", "ever_inc")
    made = ln.design(rows, "wages", ["n_jobs"], keep=["caseid"])
    return coefficients(spark, ln.within_ols(made, "caseid"))


def within_ols_full(spark, sf_dir):
    return coefficients(
        spark, ln.within_ols(mo.within_design(sample_one(spark, sf_dir)), "caseid")
    )


def within_ols_fit(spark, sf_dir):
    fit = ln.within_ols(mo.within_design(sample_one(spark, sf_dir)), "caseid")
    return ln.fit_table(spark, fit).selectExpr(
        "n", "k", "df", "n_groups", sig("sigma", "sigma"), sig("r2", "r2")
    )


def random_intercept(spark, sf_dir):
    fit = ln.random_intercept(mo.cohort_design(cohort(spark, sf_dir)), "caseid")
    return ln.coef_table(spark, fit).selectExpr("pos", "term", sig("estimate", "estimate"), sig("se", "se"))


def random_intercept_fit(spark, sf_dir):
    fit = ln.random_intercept(mo.cohort_design(cohort(spark, sf_dir)), "caseid")
    return ln.fit_table(spark, fit).selectExpr(
        "n", "df", "n_groups", sig("sigma", "sigma"), sig("group_sd", "group_sd")
    )


def random_intercept_small(spark, sf_dir):
    """Random intercept per customer on the orders cohorts, one regressor."""
    fit = ln.random_intercept(orders_design(spark, sf_dir, "treatment"), "caseid")
    return ln.coef_table(spark, fit).selectExpr(
        "pos", "term", sig("estimate", "estimate"), sig("se", "se")
    )


def random_intercept_small_fit(spark, sf_dir):
    fit = ln.random_intercept(orders_design(spark, sf_dir, "treatment"), "caseid")
    return ln.fit_table(spark, fit).selectExpr(
        "n", "df", "n_groups", sig("sigma", "sigma"), sig("group_sd", "group_sd")
    )


def fitted_residuals(spark, sf_dir):
    made = mo.cohort_design(cohort(spark, sf_dir))
    return ln.score(made, ln.ols(made)).selectExpr(
        "caseid", "bl", "round(fitted, 5) AS fitted", "round(residual, 5) AS residual"
    )


def clustered_ols(spark, sf_dir):
    """Two regressors on the orders cohorts, errors clustered by customer."""
    fit = ln.ols(orders_design(spark, sf_dir, "treatment", "n_jobs"), cluster="caseid")
    return ln.coef_table(spark, fit).selectExpr("pos", "term", sig("estimate", "estimate"), sig("se", "se"))


def within_residuals(spark, sf_dir):
    made = within_one_design(spark, sf_dir)
    return ln.score_within(made, ln.within_ols(made, "caseid"), "caseid").selectExpr(
        "caseid", "wave", "round(fitted, 4) AS fitted", "round(residual, 4) AS residual"
    )


def within_one_design(spark, sf_dir):
    return ln.design(
        dv.orders_panel(spark, sf_dir), "wages", ["n_jobs"], keep=["caseid", "wave"]
    )


def estimate_of(spark, fit, term) -> DataFrame:
    estimate, error = fit.of(term)
    return spark.createDataFrame([(float(estimate), float(error))], "estimate double, sd double")


def linear_effects(spark, sf_dir) -> dict[str, DataFrame]:
    within = ln.within_ols(mo.within_design(sample_one(spark, sf_dir)), "caseid")
    naive = ln.ols(mo.naive_design(sample_two(spark, sf_dir)))
    return {
        "Within": estimate_of(spark, within, "ever_inc"),
        "Naive OLS": estimate_of(spark, naive, "ever_inc"),
    }


def effect_table(spark, sf_dir):
    table = ef.effect_table(linear_effects(spark, sf_dir))
    return table.selectExpr(
        "model", *[sig(c, c) for c in ("att", "sd", "ci_lower", "ci_upper")]
    )


# --- effects -----------------------------------------------------------------------------------


def stratum_scores(df: DataFrame, y: str, strata: list[str]) -> DataFrame:
    """Stratum shares and means as scores: ``e``, ``mu1``, ``mu0``, ``sd1``, ``sd0``.

    One row per stratum; strata are few, so Spark broadcasts them by their size.
    """
    cells = df.groupBy(*strata).agg(
        F.expr("avg(treatment)").alias("e"),
        *[F.expr(f"avg(CASE WHEN treatment = {a} THEN {y} END)").alias(f"mu{a}") for a in (1, 0)],
        *[
            F.expr(f"stddev_samp(CASE WHEN treatment = {a} THEN {y} END)").alias(f"sd{a}")
            for a in (1, 0)
        ],
    )
    return df.join(cells, strata)


BOTH_ARMS = "e > 0 AND e < 1"


def orders_scores(spark, sf_dir):
    """Every cohort row with its stratum's scores; a stratum of one arm lacks the other's."""
    return once(
        spark, sf_dir, "orders_scores",
        lambda: stratum_scores(orders_cohorts(spark, sf_dir), "wages", ["bl", "n_jobs"]),
    )


def one_armed(scored: DataFrame) -> DataFrame:
    """One row: how many rows lie in a stratum that lacks an arm."""
    return scored.agg(F.count(F.expr(f"CASE WHEN NOT ({BOTH_ARMS}) THEN 1 END")).alias("n_dropped"))


def effect_row(found: DataFrame, scored: DataFrame) -> DataFrame:
    """An estimate over the rows whose stratum has both arms, and how many rows lack one."""
    return found.crossJoin(one_armed(scored)).selectExpr(  # one row each
        "n_rows", "n_persons", "n_dropped", *[sig(c, c) for c in ("estimate", "sd", "ci_lower", "ci_upper")]
    )


def aipw_given_scores(spark, sf_dir):
    scored = orders_scores(spark, sf_dir)
    return effect_row(ef.ate(scored.where(BOTH_ARMS), "wages", "treatment", "caseid"), scored)


def att_given_scores(spark, sf_dir):
    scored = orders_scores(spark, sf_dir)
    return effect_row(ef.att(scored.where(BOTH_ARMS), "treatment", "caseid"), scored)


def att_augmented_given_scores(spark, sf_dir):
    scored = orders_scores(spark, sf_dir)
    shifted = scored.where(BOTH_ARMS).withColumn("mu0", F.expr("mu0 * 1.1D"))
    return effect_row(ef.att_augmented(shifted, "wages", "treatment", "caseid"), scored)


def support_given_sds(spark, sf_dir):
    scored = ef.common_support(orders_scores(spark, sf_dir), "treatment", "sd", 0.25)
    return dg.support_table(scored, "treatment").selectExpr(
        "treatment", "supported", "n", sig("sd_factual", "sd_factual"),
        sig("sd_counterfactual", "sd_counterfactual"),
    )


def support_by_propensity(spark, sf_dir):
    scored = ef.common_support(orders_scores(spark, sf_dir), "treatment", "propensity")
    return scored.groupBy("bl", "treatment", "supported").agg(F.count("*").alias("n"))


def person_effects(spark, sf_dir):
    made = orders_design(spark, sf_dir, "treatment")
    scored = ln.score(made, ln.ols(made))
    return ef.person_effects(scored, "residual", "caseid", 0.5).selectExpr(
        "caseid", "n_rows", "round(person_effect, 3) AS person_effect"
    )


def att_of_draws(spark, sf_dir):
    """Five draws of each surface made from the stratum means by fixed factors."""
    scored = orders_scores(spark, sf_dir)
    drawn = scored.where(BOTH_ARMS).selectExpr(
        "treatment",
        "transform(sequence(1, 5), i -> mu1 * (1 + i / 100D)) AS draws1",
        "transform(sequence(1, 5), i -> mu0 * (1 + i / 50D)) AS draws0",
    )
    return ef.att_of_draws(drawn, "treatment").crossJoin(one_armed(scored)).selectExpr(  # one row each
        "n_dropped", *[sig(c, c) for c in ("estimate", "sd", "ci_lower", "ci_upper")]
    )


def scored_cohort(spark, sf_dir) -> DataFrame:
    """The cohorts with cross-fitted scores, written once for all effect queries."""
    def build():
        made = mo.effect_design(cohort(spark, sf_dir))
        return cf.cross_fit_linear(made, "treatment", "caseid", ["bl"])

    return once(spark, sf_dir, "scored", build)


def propensity(spark, sf_dir):
    return scored_cohort(spark, sf_dir).selectExpr(
        "caseid", "CAST(bl AS INT) AS bl", "treatment", "fold", "clipped", sig("e", "e")
    )


def outcome_surface(spark, sf_dir):
    return scored_cohort(spark, sf_dir).selectExpr(
        "caseid", "CAST(bl AS INT) AS bl", "treatment", *[sig(c, c) for c in ("mu1", "mu0", "sd1", "sd0")]
    )


def support_scored(spark, sf_dir):
    return ef.common_support(scored_cohort(spark, sf_dir), "treatment", "sd")


def supported_cohort(spark, sf_dir):
    return support_scored(spark, sf_dir).where("supported = 1")


def support_trim(spark, sf_dir):
    return dg.support_table(support_scored(spark, sf_dir), "treatment").selectExpr(
        "treatment", "supported", "n", sig("sd_factual", "sd_factual"), sig("sd_counterfactual", "sd_counterfactual")
    )


def estimate_row(found: DataFrame, scored: DataFrame) -> DataFrame:
    """An estimate with how many of the rows behind it have a propensity moved off 0 or 1."""
    moved = scored.agg(F.sum("clipped").alias("n_clipped"))
    return found.crossJoin(moved).selectExpr(  # one row each
        "n_rows", "n_persons", "n_clipped", *[sig(c, c) for c in ("estimate", "sd", "ci_lower", "ci_upper")]
    )


def ate_crossfit(spark, sf_dir):
    scored = supported_cohort(spark, sf_dir)
    return estimate_row(ef.ate(scored, "log_wages", "treatment", "caseid"), scored)


def att_crossfit(spark, sf_dir):
    scored = supported_cohort(spark, sf_dir)
    return estimate_row(ef.att(scored, "treatment", "caseid"), scored)


def drawn_att(spark, sf_dir) -> DataFrame:
    """Replicates of the effect on the treated, persons weighted anew in each."""
    scored = supported_cohort(spark, sf_dir).selectExpr(
        "caseid", "treatment * (mu1 - mu0) AS difference", "CAST(treatment AS DOUBLE) AS weight"
    )
    return ef.person_bootstrap(scored, "difference", "weight", "caseid")


def att_crossfit_draws(spark, sf_dir):
    return ef.bootstrap_summary(drawn_att(spark, sf_dir)).selectExpr(
        "n_draws", *[sig(c, c) for c in ("estimate", "sd", "ci_lower", "ci_upper")]
    )


def effect_table_all(spark, sf_dir):
    table = ef.effect_table(
        {"Cross-fitted": ef.bootstrap_summary(drawn_att(spark, sf_dir)), **linear_effects(spark, sf_dir)}
    )
    return table.selectExpr("model", *[sig(c, c) for c in ("att", "sd", "ci_lower", "ci_upper")])


def ate_crossfit_trees(spark, sf_dir):
    """Boosted propensities and a forest with a normal intercept per person."""
    made = mo.effect_design(cohort(spark, sf_dir))

    def build():
        return ef.cross_fit(made.df, made.y, "treatment", made.terms, "caseid", person=True)

    scored = ef.common_support(once(spark, sf_dir, "scored_trees", build), "treatment", "sd").where("supported = 1")
    return estimate_row(ef.ate(scored, made.y, "treatment", "caseid"), scored)


# --- sensitivity and diagnostics ------------------------------------------------------------------


def sensitivity(spark, sf_dir):
    fit = ln.ols(mo.cohort_design(cohort(spark, sf_dir)))
    return se.sensitivity_grid(spark, fit, "treatment").selectExpr(
        "r2_treatment", "r2_outcome",
        *[sig(c, c, 5) for c in ("bias", "adjusted_estimate", "adjusted_se", "adjusted_t")],
    )


def sensitivity_first_baseline(spark, sf_dir):
    first = cohort(spark, sf_dir).where(f"bl = {sm.BASELINES[0]}")
    fit = ln.ols(mo.cohort_design(first))
    return se.sensitivity_grid(spark, fit, "treatment").selectExpr(
        "r2_treatment", "r2_outcome",
        *[sig(c, c, 5) for c in ("bias", "adjusted_estimate", "adjusted_se", "adjusted_t")],
    )


def robustness_value(spark, sf_dir):
    fit = ln.ols(mo.cohort_design(cohort(spark, sf_dir)))
    return se.robustness_value(spark, fit, "treatment").selectExpr(
        "df", *[sig(c, c) for c in ("estimate", "se", "t", "partial_r2", "robustness_value")]
    )


def residual_by_fitted(spark, sf_dir):
    made = within_one_design(spark, sf_dir)
    scored = ln.score_within(made, ln.within_ols(made, "caseid"), "caseid")
    return binned_out(dg.residual_by_fitted(scored, 0, 1500000, 15))


def residual_by_observed(spark, sf_dir):
    made = within_one_design(spark, sf_dir)
    scored = ln.score_within(made, ln.within_ols(made, "caseid"), "caseid")
    return binned_out(dg.residual_by_observed(scored, 0, 1500000, 15))


def scored_wages(spark, sf_dir) -> DataFrame:
    """The wage regression with person effects on the first sample, with its residuals."""
    def build():
        made = mo.within_design(sample_one(spark, sf_dir))
        return ln.score_within(made, ln.within_ols(made, "caseid"), "caseid").select("caseid", "fitted", "residual")

    return once(spark, sf_dir, "scored_wages", build)


def wage_residual_by_fitted(spark, sf_dir):
    return binned_out(dg.residual_by_fitted(scored_wages(spark, sf_dir), *LOG_WAGE_BINS))


def wage_residual_by_observed(spark, sf_dir):
    return binned_out(dg.residual_by_observed(scored_wages(spark, sf_dir), *LOG_WAGE_BINS))


LOG_WAGE_BINS = (3, 11, 16)


def binned_out(df: DataFrame) -> DataFrame:
    return df.selectExpr("bin", "n", *[f"round({c}, 3) AS {c}" for c in ("mean", "sd", "low", "high")])


def individual_effects(spark, sf_dir):
    """Quantiles of the individual differences, all rows and treated rows; rows without one are counted."""
    every = orders_scores(spark, sf_dir)
    scored = every.where(BOTH_ARMS).selectExpr("treatment", "mu1 - mu0 AS difference")
    table = dg.quantile_table(
        scored, "difference", (0.1, 0.25, 0.5, 0.75, 0.9), {"all": "true", "treated": "treatment = 1"}
    )
    return table.crossJoin(one_armed(every)).selectExpr("part", "share", "round(value, 3) AS value", "n_dropped")


def support_curve(spark, sf_dir):
    """Support plot data: treated-arm prediction by bins of the individual difference.

    The bin without a number holds the rows whose stratum lacks an arm.
    """
    scored = orders_scores(spark, sf_dir)
    return binned_out(dg.binned(scored, "mu1 - mu0", "mu1", -400000, 400000, 16))


def cohort_individual_effects(spark, sf_dir):
    """Quantiles of the cohort's individual differences under the fitted surfaces."""
    scored = support_scored(spark, sf_dir).selectExpr("treatment", "supported", "mu1 - mu0 AS difference")
    parts = {"all": "true", "treated": "treatment = 1", "supported": "supported = 1"}
    table = dg.quantile_table(scored, "difference", (0.1, 0.25, 0.5, 0.75, 0.9), parts)
    return table.selectExpr("part", "share", sig("value", "value"))


def cohort_support_curve(spark, sf_dir):
    """The fitted treated-arm prediction by bins of the individual difference."""
    return binned_out(dg.binned(scored_cohort(spark, sf_dir), "mu1 - mu0", "mu1", -4, 4, 16))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "survey_wide": lambda spark, sf_dir: nm.snake_names(survey(spark, sf_dir)),
    "read_wide_csv": read_wide_csv,
    "select_and_drop": select_and_drop,
    "select_by_substring": select_by_substring,
    "sentinel_null": sentinel_null,
    "melt_keep_nulls": melt_keep_nulls,
    "name_to_wave": name_to_wave,
    "spread_two_stems": spread_two_stems,
    "wave_shift": wave_shift,
    "wave_lookup": wave_lookup,
    "year_to_wave": year_to_wave,
    "fill_if_observed": fill_if_observed,
    "three_valued_flags": three_valued_flags,
    "bin_ranges": bin_ranges,
    "any_positive_by_year": any_positive_by_year,
    "any_positive_by_wave": any_positive_by_wave,
    "topic_non_interview": topic(tp.NON_INTERVIEWED),
    "topic_age": topic(tp.AGE),
    "topic_incarceration": topic(tp.INCARCERATION),
    "topic_income": topic(tp.INCOME),
    "topic_poverty": topic(tp.POVERTY),
    "topic_urban": topic(tp.URBAN),
    "topic_education": topic(tp.EDUCATION),
    "topic_work": topic(tp.WORK),
    "topic_marriage": topic(tp.MARRIAGE),
    "topic_union": topic(tp.UNION),
    "topic_static": topic_static,
    "topic_employment": topic(tp.EMPLOYMENT),
    "topic_psector": topic(tp.PSECTOR),
    "topic_region": topic(tp.REGION),
    "topic_industry": topic(tp.INDUSTRY),
    "topic_drugs": topic(tp.DRUGS),
    "topic_drugs_fixed": topic(tp.DRUGS_FIXED),
    "topic_wages": topic(tp.WAGES),
    "topic_welfare": topic_welfare,
    "panel_assembly": panel,
    "panel_join_chain": panel_join_chain,
    "panel_drugs_fixed": panel_drugs_fixed,
    "lead_lag_running": lead_lag_running,
    "ffill": ffill,
    "backfill_from_wave": backfill_from_wave,
    "exposure_history": exposure_history,
    "exposure_history_sparse": exposure_history_sparse,
    "deflate_and_log": deflate_and_log,
    "rowwise_max": rowwise_max,
    "cap_k_median": cap_k_median,
    "filter_below_k_median": filter_below_k_median,
    "global_medians": global_medians,
    "exclude_ids": exclude_ids,
    "attach_wave": attach_wave,
    "null_safe_join": null_safe_join,
    "stack_missing_columns": stack_missing_columns,
    "sample_one": sample_one_query,
    "sample_two": sample_two_query,
    "cohort_one": cohort_one,
    "cohort_all": cohort_all,
    "orders_cohorts": orders_cohorts,
    "treatment_identity": treatment_identity,
    "diff_in_means": diff_in_means,
    "design_matrix": design_matrix,
    "design_levels": design_levels,
    "ols_1": ols_1,
    "ols_2": ols_2,
    "wage_ols": wage_ols,
    "wage_ols_reported": wage_ols_reported,
    "naive_ols": naive_ols,
    "cohort_ols": cohort_ols,
    "cohort_ols_fit": cohort_ols_fit,
    "collinear_ols": collinear_ols,
    "clustered_ols": clustered_ols,
    "within_ols_1": within_ols_1,
    "within_ols_full": within_ols_full,
    "within_ols_fit": within_ols_fit,
    "random_intercept": random_intercept,
    "random_intercept_fit": random_intercept_fit,
    "random_intercept_small": random_intercept_small,
    "random_intercept_small_fit": random_intercept_small_fit,
    "fitted_residuals": fitted_residuals,
    "within_residuals": within_residuals,
    "effect_table": effect_table,
    "aipw_given_scores": aipw_given_scores,
    "att_given_scores": att_given_scores,
    "att_augmented_given_scores": att_augmented_given_scores,
    "support_given_sds": support_given_sds,
    "support_by_propensity": support_by_propensity,
    "person_effects": person_effects,
    "att_of_draws": att_of_draws,
    "propensity": propensity,
    "outcome_surface": outcome_surface,
    "support_trim": support_trim,
    "ate_crossfit": ate_crossfit,
    "att_crossfit": att_crossfit,
    "att_crossfit_draws": att_crossfit_draws,
    "ate_crossfit_trees": ate_crossfit_trees,
    "effect_table_all": effect_table_all,
    "sensitivity_grid": sensitivity,
    "sensitivity_first_baseline": sensitivity_first_baseline,
    "robustness_value": robustness_value,
    "residual_by_fitted": residual_by_fitted,
    "residual_by_observed": residual_by_observed,
    "individual_effects": individual_effects,
    "support_curve": support_curve,
    "wage_residual_by_fitted": wage_residual_by_fitted,
    "wage_residual_by_observed": wage_residual_by_observed,
    "cohort_individual_effects": cohort_individual_effects,
    "cohort_support_curve": cohort_support_curve,
}
