import pytest

from panelwave.plans import catalog
from panelwave.plans import topics as tp
from panelwave.sources import derived as dv
from panelwave.sources import names as nm
from panelwave.sources.survey_csv import read_wide, read_wide_parquet


def test_headers_made_unique():
    header = ["CASEID", "URBAN-RURAL", "URBAN-RURAL", "AFQT-1", "URBAN-RURAL"]
    assert nm.unique_headers(header) == ["CASEID", "URBAN.RURAL", "URBAN.RURAL.1", "AFQT.1", "URBAN.RURAL.2"]
    assert nm.unique_headers(["X", "X.1", "X", "79 A"]) == ["X", "X.1", "X.2", "X79.A"]


def test_read_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("CASEID,URBAN-RURAL,URBAN-RURAL,AFQT-1,URBAN-RURAL\n1,1,-5,,0\n2,x,0,12.5,1\n")
    df = read_wide(spark, str(path))
    assert dict(df.dtypes)["CASEID"] == "bigint" and dict(df.dtypes)["URBAN.RURAL.2"] == "double"
    assert [tuple(r) for r in df.orderBy("CASEID").collect()] == [(1, 1.0, -5.0, None, 0.0), (2, None, 0.0, 12.5, 1.0)]
    urban = tp.topic_table(df, tp.URBAN).orderBy("caseid", "wave").collect()
    assert [tuple(r) for r in urban] == [(1, 0, 1), (1, 1, None), (1, 2, 0), (2, 0, None), (2, 1, 0), (2, 2, 1)]
    lost = tp.topic_table(df, tp.NON_INTERVIEWED).where("caseid = 1").orderBy("wave").collect()
    assert [r.non_interview for r in lost] == [0, 1, 0]


def test_read_wide_directory_and_parquet(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), None) for i in range(20)], "CASEID bigint, `A.1` double, B double")
    rows.repartition(4).write.csv(str(tmp_path / "csv"), header=True)
    back = read_wide(spark, str(tmp_path / "csv"), names=["CASEID", "A.1", "B"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    rows.write.parquet(str(tmp_path / "pq"))
    assert read_wide_parquet(spark, str(tmp_path / "pq")).count() == 20


def test_selectors_ignore_case_and_keep_dots(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "CASEID int, `HH1.1` int, `hh1.2` int, `X.QES.56C` int")
    assert nm.select_prefix(df, "hH1", keep=["CASEID"]).columns == ["CASEID", "HH1.1", "hh1.2"]
    assert nm.select_contains(df, "qes.56c").columns == ["X.QES.56C"]
    assert nm.drop_like(df, names=["CASEID"], prefixes=["HH1.1"], contains=["56c"]).columns == ["hh1.2"]
    assert nm.snake_names(df).columns == ["caseid", "hh1_1", "hh1_2", "x_qes_56c"]


@pytest.mark.parametrize(
    ("topic", "name", "stem", "at"),
    [
        (tp.AGE, "AGEATINT.7", "AGEATINT", 7),
        (tp.INCARCERATION, "HH1.1", "H1", 0),
        (tp.INCARCERATION, "HH1.1.4", "H1", 4),
        (tp.INCOME, "Q13.5.2", "Q1", 2),
        (tp.INCOME, "Q13.5_TRUNC_REVISED", "Q1_TRUNC_REVISED", 3),
        (tp.INCOME, "Q13.5_TRUNC.1", "Q1_TRUNC", 20),
        (tp.EDUCATION, "HGC.5", "edyears", 5),
        (tp.EDUCATION, "ENROLLMTREV79", "ENROLLM", 0),
        (tp.EDUCATION, "ENROLLMTREV06", "ENROLLM", 21),
        (tp.WORK, "WKSWK.PCY.3", "WKSW", 3),
        (tp.MARRIAGE, "MARSTAT.KEY", "MARSTA", 0),
        (tp.UNION, "EMPLOYERS_ALL_UNION_1996.02", "EMPLOYER", 1996),
        (tp.EMPLOYMENT, "ESR_KEY.18", "ESR_KEY", 21),
        (tp.PSECTOR, "CPS.QES.56C.3", "CP", 3),
        (tp.PSECTOR, "QES.56C.01.2", "QE", 17),
        (tp.INDUSTRY, "INDALL.EMP.01.16", "INDALL", 16),
        (tp.INDUSTRY, "INDALL.EMP.01.14", "INDALL", tp.LEFT_OUT),
        (tp.INDUSTRY, "CPSIND70.3", "CPSIND70", 3),
        (tp.DRUGS, "DS.11.2", "D11", 5),
        (tp.DRUGS_FIXED, "DS.11.2", "D11", 13),
        (tp.DRUGS, "DS.19.2", "D19", 19),
        (tp.WELFARE, "WELFARE.AMT.1988_TOT", "WELFARE", 1988),
    ],
)
def test_topic_names(topic, name, stem, at):
    (source,) = nm.parse_names([name], topic.rule, "CASEID")
    assert (source.stem, topic.at(source)) == (stem, at)


def test_repeated_headers_come_back_as_names():
    columns = ["CASEID", *dv.survey_answers()]
    written = dv.repeated_headers(columns)
    assert len({c.strip() for c in written}) < len(columns) / 3
    assert nm.unique_headers(written) == columns


@pytest.fixture
def star(spark, tmp_path):
    """Customers with repeated and null keys, and their orders."""
    customers = [(1, 3, 10.5), (1, 3, 10.5), (2, None, -7.25), (3, 4, None), (None, 1, 99.0), (4, 0, 0.0)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    orders = [(1, "F", 900.25, "1995-02-01", "1-URGENT"), (1, "O", 12.5, "1995-02-02", "5-LOW")]
    orders += [(2, "F", 70000.0, "1998-11-30", "2-HIGH"), (3, None, None, "2001-12-31", None)]
    orders += [(None, "F", 5.0, "1996-01-01", "1-URGENT"), (4, "F", 123456.78, None, "1-URGENT")]
    spark.createDataFrame(
        orders, "o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    ).selectExpr("* EXCEPT (o_orderdate)", "CAST(o_orderdate AS timestamp) AS o_orderdate").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    return str(tmp_path)


def test_survey_goes_straight_into_its_csv_files(spark, star, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "shared_dir", lambda spark: str(tmp_path / "files"))
    monkeypatch.setattr(catalog, "saved", None)  # nothing but the CSV files is written
    monkeypatch.setattr(catalog, "survey", None)
    got = catalog.read_wide_csv(spark, star)
    files = list((tmp_path / "files").rglob("*.csv"))
    lines = [line for f in files for line in f.read_text().splitlines() if not line.startswith("CASEID")]
    assert len(lines) == 6 and "." not in "".join(lines)
    want = nm.snake_names(dv.survey_wide(spark, star))
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_csv_files_are_made_of_a_written_survey(spark, star):
    wide = catalog.survey(spark, star).collect()
    assert sorted(map(repr, map(tuple, catalog.read_wide_csv(spark, star).collect()))) == sorted(
        map(repr, map(tuple, wide))
    )
