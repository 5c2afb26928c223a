"""Every plan of the catalog that SQL can express, against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from strandline.plans.catalog import ORACLES, PLANS

DATA = "/root/testdata/sf0.001"


def plain(x):
    """Nulls and numbers of either engine in one form."""
    if pd.isna(x):
        return ""
    if isinstance(x, (bool, str)):
        return str(x)
    return f"{float(x):.9g}"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_plan_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = PLANS[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
