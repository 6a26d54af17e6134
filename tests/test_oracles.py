"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sightline.plans import geometric, relational  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Left to the driver's own comparison, for their time.
SLOW = {"hillshade", "ring_vertices", "match_clicks_to_columns", "stream_resolve"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(set(relational.SQL) - SLOW))
def test_same_rows(spark, duck, name):
    df = relational.QUERIES[name](spark, SF)
    theirs = duck.execute(relational.SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, theirs.fetchall())
