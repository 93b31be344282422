"""Every query of the training-load catalog against its SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from stridewell.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    plain = lambda v: None if v != v or v is None else v.isoformat()[:19].removesuffix("T00:00:00") if hasattr(v, "isoformat") else v
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())
