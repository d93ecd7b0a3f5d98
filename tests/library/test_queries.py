"""Registered queries against their DuckDB twins."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from docloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    expected = sorted((tuple(plain(r[theirs.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert found == expected


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
