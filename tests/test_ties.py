"""Queries over events that share a millisecond, against their SQL."""

import datetime

import duckdb
import pytest

from tidemark import queries_store  # noqa: F401  adds its queries
from tidemark.queries import QUERIES, SQL

AT = datetime.datetime(2024, 1, 12, 3, 4, 5, 678_000)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Thirty events at three times, of like and unlike users, types and values, some microseconds apart."""
    folder = str(tmp_path_factory.mktemp("tied"))
    rows = [(i, AT + datetime.timedelta(days=i % 3, microseconds=i), i // 2, "view" if i % 4 else "click", float(i % 5), "{}") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, folder).collect()), key=repr) == want
    return len(want)


def test_spans_at_one_time(spark, tied):
    assert same(spark, tied, "aligned_spans") == 30


def test_watched_items_at_one_time(spark, tied):
    assert same(spark, tied, "watched_headers_and_changes") == 90
