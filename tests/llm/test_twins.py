"""Operator queries against their DuckDB twins."""

import duckdb
import pytest

from docloom.llm import queries

TABLES = ("documents", "conversations")


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = con.execute(queries.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    expected = sorted((tuple(plain(r[theirs.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert sorted(theirs) == names and found == expected
