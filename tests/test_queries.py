"""Every registered query against its SQL, at the smallest size; those without SQL run."""

import math
import os

import duckdb
import pytest

from timeweave import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect(config={"memory_limit": "4GB", "max_temp_directory_size": "1GB"})
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_same_as_sql(spark, con, name):
    df = own.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in own.ORACLES:
        assert df.columns
        return
    rel = con.sql(own.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in rows), key=repr)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_every_oracle_has_a_query():
    assert set(own.ORACLES) <= set(own.QUERIES)
