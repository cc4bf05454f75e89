"""Every catalog query against its SQL on another engine, at the size the driver uses."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: "" if v is None else str(v))
        else:
            df[c] = df[c].astype(float).replace(np.nan, -9e99)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    found = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in found.description}
    want = found.df()
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False, rtol=0, atol=0)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
