"""The series store's log, replays, followers and catalog."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources.commits import EVERY, ArrowFiles, CommitLog, HadoopFiles
from tidemark.sources.store import SeriesStore
from tidemark.streaming import streams

SCHEMA = "column_path string, key long, value double"


@pytest.fixture
def store(spark, folder):
    return SeriesStore(spark, folder + "/store")


def items(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def found(store):
    return sorted(tuple(r)[:3] for r in store.scan("double").collect())


def test_replay_after_compaction_changes_nothing(spark, store):
    first, second = items(spark, ("a/x", 1, 1.0), ("a/x", 2, 1.0)), items(spark, ("a/x", 1, 2.0))
    assert store.write(first, "double", "batch-1") == 1 and store.write(second, "double", ("loader", 4)) == 2
    store.compact("double")
    store.vacuum("double", older_ms=0)
    assert store.write(first, "double", "batch-1") is None
    assert store.write(second, "double", ("loader", 4)) is None and store.write(first, "double", ("loader", 3)) is None
    assert found(store) == [("a/x", 1, 2.0), ("a/x", 2, 1.0)]
    assert store.write(first, "double", ("loader", 5)) == 4
    assert found(store) == [("a/x", 1, 1.0), ("a/x", 2, 1.0)]


def test_concurrent_writers_have_numbers_of_their_own(spark, store):
    numbers, n = [], 6

    def write(i):
        numbers.append(store.write(items(spark, ("a/x", 0, float(i)), ("a/x", i, float(i))), "double", ("w", 0) if i in (1, 2) else f"t{i}"))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, n + 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    # Two writers had the same token: one of them wrote.
    assert sorted(x for x in numbers if x) == list(range(1, n)) and numbers.count(None) == 1
    got = {k: v for _, k, v in found(store)}
    assert len(got) == n and set(got) - {0, 1, 2} == {3, 4, 5, 6}
    last = store.log("double").entries(n - 2, n - 1)[0]["token"][0]
    assert got[0] == (float(last[1:]) if last != "w" else got[max(set(got) & {1, 2})])


@pytest.mark.parametrize("local", [True, False])
def test_a_number_is_put_in_place_once(spark, folder, local):
    files = HadoopFiles(spark, folder + "/log test")
    if not local:
        files.local = None  # by the rename that other file systems get
    won = []

    def put(i):
        if files.put("log/1.json", f'{{"by": {i}}}'):
            won.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8 if local else 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and files.read("log/1.json") == f'{{"by": {won[0]}}}'
    assert not files.put("log/1.json", "{}") and [n for n in files.names("log") if not n.startswith(".")] == ["1.json"]
    assert ArrowFiles(files.uri).read("log/1.json") == files.read("log/1.json")


def test_log_of_many_commits(spark, folder, monkeypatch):
    monkeypatch.setattr("tidemark.sources.commits.FOLDER", 15)
    files = HadoopFiles(spark, folder + "/t")
    log = CommitLog(files)
    for i in range(1, 3 * EVERY + 6):
        log.commit(lambda s, i=i: {"kind": "write", "folder": f"f{i}", "token": ["w", i]} if i % 7 else {"kind": "erase", "path": f"p{i}"})
        if i == 30:
            log.commit(lambda s: {"kind": "compact", "folder": "all", "upto": s.number - 1, "replaces": [f for f, n in s.writes.items() if n < s.number]})
    state = log.state()
    assert state.number == 3 * EVERY + 6 and state.tokens == {"w": 3 * EVERY + 5}
    assert state.writes["all"] == 29 and state.writes["f30"] == 30 and "f29" not in state.writes and state.compacted == ["all"]
    assert min(state.erased.values()) > 29 and state.erased["p35"] == 36
    read = []
    monkeypatch.setattr(files, "read", lambda path, f=files.read: read.append(path) or f(path))
    assert log.state() == state and len(read) <= EVERY + 3
    files.delete("log/last")  # a hint only
    assert log.state() == state and CommitLog(ArrowFiles(files.uri)).state() == state


def test_of_two_compactions_the_later_gives_up(spark, store, monkeypatch):
    store.write(items(spark, ("a/x", 1, 1.0)), "double")
    store.write(items(spark, ("a/x", 1, 2.0), ("a/y", 1, 5.0)), "double")
    put = SeriesStore._put

    def slow(self, rows, table):
        folder = put(self, rows, table)
        monkeypatch.setattr(SeriesStore, "_put", put)
        self.compact("double")
        self.write(items(spark, ("a/x", 1, 3.0)), "double")
        return folder

    monkeypatch.setattr(SeriesStore, "_put", slow)
    store.compact("double")
    store.vacuum("double", older_ms=0)
    assert found(store) == [("a/x", 1, 3.0), ("a/y", 1, 5.0)] and len(store.log("double").state().compacted) == 1


def test_a_write_during_a_compaction_stays(spark, store, monkeypatch):
    store.write(items(spark, ("a/x", 1, 1.0), ("a/z", 1, 1.0)), "double")
    put = SeriesStore._put

    def slow(self, rows, table):
        folder = put(self, rows, table)
        monkeypatch.setattr(SeriesStore, "_put", put)
        self.write(items(spark, ("a/x", 1, 3.0)), "double")
        self.erase_column("a/z", "double")
        return folder

    monkeypatch.setattr(SeriesStore, "_put", slow)
    store.compact("double")
    assert found(store) == [("a/x", 1, 3.0)]
    assert sorted(r.column_path for r in store.catalog().collect()) == ["a/x"]


def follow(store, folder, **more):
    """What the stream sends, batch by batch, since it was last asked."""
    out = []
    streams.start(store.follow("double", **more), lambda b, n: out.append(sorted(map(tuple, b.drop("value_type").collect()), key=repr)), folder + "/ck").awaitTermination()
    return [b for b in out if b]


def test_followers_get_each_commit_once(spark, folder, store):
    store.write(items(spark, ("a/x", 1, 1.0), ("a/y", 1, 1.5)), "double")
    store.write(items(spark, ("a/x", 2, 2.0)), "double")
    assert follow(store, folder) == [[("a/x", 1, 1.0, 1), ("a/x", 2, 2.0, 2), ("a/y", 1, 1.5, 1)]]
    assert follow(store, folder) == []
    store.write(items(spark, ("a/x", 1, 3.0)), "double")
    store.compact("double")
    store.vacuum("double", older_ms=0)
    assert follow(store, folder) == [[("a/x", 1, 3.0, 3)]]  # not all that the new folder holds
    store.write(items(spark, ("a/y", 9, 9.0)), "double")
    store.erase_column("a/y", "double")
    store.write(items(spark, ("a/y", 10, 10.0)), "double")
    assert follow(store, folder) == [[("a/y", 10, 10.0, 7)]]
    store.write(spark.createDataFrame([], SCHEMA), "double")
    assert follow(store, folder) == []


def test_followers_are_told_of_erased_columns(spark, folder, store):
    store.write(items(spark, ("a/x", 1, 1.0), ("a/y", 1, 1.5)), "double")
    follow(store, folder, erasures=True)
    store.erase_column("a/x", "double")
    store.compact("double")
    assert follow(store, folder, erasures=True) == [[("a/x", None, None, 2)]]


def test_a_follower_may_begin_anywhere(spark, folder, store):
    store.write(items(spark, ("a/x", 1, 1.0)), "double")
    store.write(items(spark, ("a/x", 2, 2.0)), "double")
    assert follow(store, folder, since=1) == [[("a/x", 2, 2.0, 2)]]


def test_a_store_is_not_followed_as_a_folder(spark, store):
    store.write(items(spark, ("a/x", 1, 1.0)), "double")
    with pytest.raises(ValueError, match="SeriesStore.follow"):
        streams.follow(spark, store.path + "/series_double", SCHEMA)


def test_catalog_reads_no_items(spark, store):
    store.write(items(spark, ("a/x", 4, 1.0), ("a/x", 2, 1.0), ("b/y", 1, 1.0)), "double")
    store.write(items(spark, ("a/x", 2, 7.0)), "double")
    store.write(spark.createDataFrame([("s/t", 3, "v")], "column_path string, key long, value string"), "string")
    catalog = store.catalog()
    assert all("/paths/" in f for f in catalog.inputFiles())
    assert sorted(map(tuple, catalog.collect())) == [("a/x", "double", 2, 4, 3), ("b/y", "double", 1, 1, 1), ("s/t", "string", 3, 3, 1)]
    store.compact("double")
    assert {tuple(r) for r in store.catalog().where("column_path = 'a/x'").collect()} == {("a/x", "double", 2, 4, 2)}
    assert [tuple(r)[:3] for r in store.column("s/t").collect()] == [("s/t", 3, "v")]
    with pytest.raises(LookupError):
        store.column("s/none")
    assert SeriesStore(spark, store.path + "/none").catalog().collect() == []


def test_vacuum_leaves_new_folders(spark, store):
    store.write(items(spark, ("a/x", 1, 1.0)), "double")
    store._put(items(spark, ("a/x", 1, 9.0)).withColumn("value_type", F.lit("double")), store._table("double"))  # a write at work
    store.vacuum("double")
    files = HadoopFiles(spark, store._table("double"))
    assert len(files.names("data")) == 2
    store.vacuum("double", older_ms=0)
    assert len(files.names("data")) == 1 and found(store) == [("a/x", 1, 1.0)]
