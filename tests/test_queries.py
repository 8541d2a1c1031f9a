"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
