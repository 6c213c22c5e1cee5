"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from terrasift.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.apply(lambda c: c.astype("float64") if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        pd.testing.assert_frame_equal(rows(got), rows(duck.sql(SQL[name]).df()), check_dtype=False, atol=2e-6, rtol=0)
    else:
        assert len(got) > 0
