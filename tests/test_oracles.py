"""Every registered series query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import queries_load, queries_ranges, queries_store  # noqa: F401
from tidemark.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    columns = sorted(out.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in out.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert ours == theirs
