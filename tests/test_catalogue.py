"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tracklight.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_probe_runs(spark):
    assert catalogue.QUERIES["charset_probe"](spark, SF).count() == 200
