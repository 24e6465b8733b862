"""Streams by batch operators against the same worked out in one go."""

import datetime
import os
import random
import time

import duckdb
import pytest

from tidemark import queries_load, queries_store  # noqa: F401  add their queries
from tidemark.operators import running
from tidemark.queries import QUERIES, SQL
from tidemark.sources.store import SeriesStore
from tidemark.streaming import batches, streams

SCHEMA = "column_path string, key long, value double"


def stream(spark, folder, parts):
    """The next call's files are later ones, a batch each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return streams.follow(spark, folder, SCHEMA, max_files=1)


def run(spark, folder, make):
    out = {}
    make(lambda df, n: out.__setitem__(n, sorted(map(tuple, df.collect()), key=repr)), folder + "/ck").awaitTermination()
    return [out[n] for n in sorted(out)]


@pytest.mark.parametrize("chunk_rows", [4, 10_000])
def test_counts_over_any_batches(spark, folder, monkeypatch, chunk_rows):
    monkeypatch.setattr(running, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(3)
    keys = iter(rng.sample(range(1000), 52))
    parts = [[(rng.choice("aab"), next(keys), float(rng.randrange(9))) for _ in range(n)] for n in (13, 1, 30, 8)]
    got = run(spark, folder, lambda emit, ck: batches.count_parts(stream(spark, folder + "/in", parts), 7, "max", emit, ck))
    want, held = [], {}
    for rows in parts:
        done = []
        for s in "ab":
            own = held.get(s, []) + sorted(r[1:] for r in rows if r[0] == s)
            while len(own) >= 7:
                done.append((s, own[0][0], max(v for _, v in own[:7])))
                own = own[7:]
            held[s] = own
        want.append(sorted(done, key=repr))
    assert got == want


def test_a_batch_that_runs_again_emits_the_same(spark, folder):
    parts = [[("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0)], [("a", 4, 8.0)]]
    count = lambda emit, ck: batches.count_parts(streams.follow(spark, folder + "/in", SCHEMA, max_files=1), 2, "sum", emit, ck)
    stream(spark, folder + "/in", parts)
    assert run(spark, folder, count) == [[("a", 1, 3.0)], [("a", 3, 12.0)]]
    for name in ("1", ".1.crc"):
        os.remove(f"{folder}/ck/commits/{name}")
    assert run(spark, folder, count) == [[("a", 3, 12.0)]]


def test_empties_over_batches(spark, folder):
    parts = [[("a", 5, 1.0), ("a", 41, 2.0), ("b", 7, 1.0)], [("a", 45, 3.0), ("a", 3, 99.0)], [("a", 71, None), ("a", 73, 4.0), ("b", 8, 2.0), ("b", 35, 1.0)]]
    parts = [[(s, k * 1000, v) for s, k, v in rows] for rows in parts]
    got = run(spark, folder, lambda emit, ck: batches.reduce_with_empties(stream(spark, folder + "/in", parts), "10 seconds", "sum", emit, ck))
    sent = [sorted((s, k // 1000, v) for s, k, v in rows) for rows in ([[(a, b, -1 if c is None else c) for a, b, c in g] for g in got])]
    assert sent == [
        [("a", 0, 1.0), ("a", 10, -1), ("a", 20, -1), ("a", 30, -1), ("a", 40, 2.0), ("b", 0, 1.0)],
        [("a", 40, 5.0)],
        [("a", 50, -1), ("a", 60, -1), ("a", 70, 4.0), ("b", 0, 3.0), ("b", 10, -1), ("b", 20, -1), ("b", 30, 1.0)],
    ]


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_watched_files_have_headers_of_their_own_and_may_change(spark, folder):
    watched = folder + "/in"
    watch = lambda emit, ck: batches.watch_delimited(spark, watched, lambda df, n: emit(df.drop("file"), n), ck)
    assert run(spark, folder, watch) == []
    put(watched, "a.csv", "time,v:int\n1,5\n")
    put(watched, "deep/b c.tsv", 'w\tstartTime\n"x\ty"\t7\n')
    put(watched, "other.txt", "time,v\n1,2\n")
    first = [("a/v", 1, "5", "int"), ("deep/b c/w", 7, "x\ty", "string")]
    assert run(spark, folder, watch) == [first]
    assert run(spark, folder, watch) == []
    put(watched, "a.csv", "time,v:int,more\n1,6\n2,7,z\n")
    os.utime(watched + "/a.csv", (1, 1))  # older than what was read
    os.remove(watched + "/deep/b c.tsv")
    assert run(spark, folder, watch) == [[("a/more", 2, "z", "string"), ("a/v", 1, "6", "int"), ("a/v", 2, "7", "int")]]


def test_watched_files_keep_a_store_up_to_date(spark, folder):
    store = SeriesStore(spark, folder + "/store")
    load = lambda: batches.load_watched(spark, folder + "/in", store, folder + "/ck").awaitTermination()
    put(folder + "/in", "a.csv", "time,v:int,s:blob\n1,5,YWI=\n2,6,\n")
    load()
    put(folder + "/in", "a.csv", "time,v:int\n2,8\n")
    load()
    assert sorted(map(tuple, store.scan("int").collect())) == [("a/v", 1, 5, "int"), ("a/v", 2, 8, "int")]
    assert [bytes(r.value) for r in store.scan("blob").collect()] == [b"ab"]


@pytest.mark.parametrize("buckets", [1, 3])
def test_state_by_buckets_of_series(spark, folder, monkeypatch, buckets):
    """Many series are few groups of the state; what is sent is what the batch operators emit, nulls and a series without a name included."""
    monkeypatch.setattr(streams, "BUCKETS", buckets)
    rng = random.Random(6)
    keys = iter(rng.sample(range(100_000), 400))
    paths = [None, *(f"s{i}" for i in range(20))]
    parts = [[(rng.choice(paths), next(keys), rng.choice([None, *map(float, range(9))])) for _ in range(n)] for n in (150, 20, 160)]
    items = stream(spark, folder + "/in", parts)
    named = items.fillna("none", ["column_path"])
    for i, fn in enumerate(("min", "sum")):
        for name, streamed, batched, mode in (
            ("tens", lambda: streams.stream_count_reduce(items, 4, fn), lambda emit, ck: batches.count_parts(named, 4, fn, emit, ck), "append"),  # noqa: B023
            ("empties", lambda: streams.stream_reduce_with_empties(items, "10 seconds", fn=fn), lambda emit, ck: batches.reduce_with_empties(named, "10 seconds", fn, emit, ck), "update"),  # noqa: B023
        ):
            got, own = {}, f"{folder}/{name}{i}"
            query = streams.start(streamed(), lambda b, n: got.__setitem__(n, sorted(map(tuple, b.fillna("none", ["column_path"]).collect()), key=repr)), own + "/stream", mode=mode)  # noqa: B023
            query.awaitTermination()
            want = run(spark, own, batched)
            assert [sorted(set(a) ^ set(b), key=repr) for a, b in zip([got[n] for n in sorted(got) if n < 3], want, strict=True)] == [[]] * 3, fn
            assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= buckets


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """Events of four users, many empty periods apart; two in the hour over the end of the first quarter of the time."""
    folder, start = str(tmp_path_factory.mktemp("sparse")), datetime.datetime(2024, 1, 1)
    at = [(5000 * i, i % 4) for i in range(100)] + [(123_740, 1), (123_760, 1)]
    rows = [(i, start + datetime.timedelta(minutes=m), user, "view", float(i % 7), "{}") for i, (m, user) in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["batches_mean_with_empties", "stream_sum_with_empties", "stream_max_with_empties"])
def test_missing_values_are_not_compared(spark, sparse, name):
    """The result is that of the SQL, and no more rows are shuffled for it than there are items, whatever lies between them."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sparse}/events.parquet/*.parquet')")
    want = sorted(con.execute(SQL[name]).fetchall(), key=repr)
    found = QUERIES[name](spark, sparse)
    spark.sparkContext.setJobGroup(name, name)
    got = sorted((tuple(r) for r in found.select("column_path", "key", "value").collect()), key=repr)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and len(want) > 1000
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    made = [store.stageAttempt(s, 0, False, None, False, None)._1().shuffleWriteRecords() for s in stages]
    assert 0 < sum(made) <= 102


def test_newest_of_what_was_sent(spark):
    sent = [("a", 0, 1.0, 0), ("a", 10, None, 0), ("a", 20, 5.0, 0), ("a", 20, 4.0, 1), ("a", 30, None, 1), ("a", 40, 2.0, 1), ("b", 20, float("nan"), 0), (None, 20, 3.0, 1)]
    got = streams.newest_with_empties(spark.createDataFrame(sent, SCHEMA + ", ingest_seq int")).where("value IS NULL OR NOT isnan(value)")
    assert sorted(map(tuple, got.drop("ingest_seq").collect()), key=repr) == sorted([("a", 0, 1.0), ("a", 10, None), ("a", 20, 4.0), ("a", 30, None), ("a", 40, 2.0), (None, 20, 3.0)], key=repr)
