"""Every registered map query equals its SQL on the smallest tables."""

import math
import os

import pytest

from cairnfield.plans import queries

DATA = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(repr, r))
    got = sorted((tuple(rounded(v) for v in r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(rounded(v) for v in r) for r in want.fetchall()), key=key)
    assert got
