"""Files, records, tables and streams."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.reduce import reduce
from tidemark.sources import delimited, records, sinks
from tidemark.sources.store import SeriesStore, latest_wins, merge_updates, series_from_values
from tidemark.streaming import streams


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_header_rules():
    h = delimited.detect_header("name,seconds:Double,startTime,endTime", ",")
    assert h.names == ("name", "seconds", "startTime", "endTime") and h.key == 2 and h.types[1] == "double"
    assert delimited.detect_header("a,when_date", ",").key == 1 and delimited.detect_header("a,b", ",").key == 0
    assert not delimited.detect_header("1.5,2", ",").has_header
    assert delimited.detect_header('"a, b","time"', ",").names == ("a, b", "time")
    with pytest.raises(ValueError):
        delimited.detect_header("single", ",")


def test_delimited_folder(spark, folder):
    put(folder, "set/one.csv", "# note\n\ntime,count,ok,name\n2014-11-25T00:00:00.000,1,True,x\n17,2,false,\nbad,3,true,z\n")
    put(folder, "_skip/two.tsv", "time\tv:int\n1.5\t7\n2\toops\n")
    put(folder, "set/other.txt", "time,v\n1,2\n")
    got = {(r.column_path, r.key, r.value, r.value_type) for r in delimited.read_delimited(spark, folder).collect()}
    assert got == {
        ("set/one/count", 1416873600000, "1", "long"), ("set/one/count", 17, "2", "long"), ("set/one/ok", 1416873600000, "true", "boolean"), ("set/one/ok", 17, "false", "boolean"),
        ("set/one/name", 1416873600000, "x", "string"), ("two/v", 1500, "7", "int"),
    }
    assert [r.line for r in delimited.bad_keys(spark, folder).collect()] == ["bad,3,true,z"]


def test_quoted_headers_and_cells_over_lines(spark, folder):
    rows = [("time", "a, b", 'say "x":string', "c:long"), ("1", "one\ntwo, three", "plain", "7"), ("2", "", '"\n\n"', ""), ("3", "last", "#no comment\n# nor this", "x"), ("four", "no\nkey", "", "")]
    text = "# a comment\n\n" + "\n".join(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in r) for r in rows) + "\n"
    put(folder, "q.csv", text)
    put(folder, "t.tsv", 'time\t"v\tw"\n5\t"x\ny"\n')
    got = {(r.column_path, r.key, r.value) for r in delimited.read_delimited(spark, folder).collect()}
    want = {("q/a, b", 1, "one\ntwo, three"), ("q/say \"x\"", 1, "plain"), ("q/c", 1, "7"), ("q/say \"x\"", 2, '"\n\n"'), ("q/a, b", 3, "last"), ("q/say \"x\"", 3, "#no comment\n# nor this"), ("t/v\tw", 5, "x\ny")}
    assert got == want
    assert [r.line for r in delimited.bad_keys(spark, folder).collect()] == ['four,"no\nkey",,']
    assert [tuple(r)[1:] for r in delimited.bad_values(spark, folder).collect()] == [(3, "c", "long", "x")]


@pytest.mark.parametrize("split", ["64b", "64k"])
def test_records_over_splits(spark, folder, split):
    """Records of up to many lines in splits of a few bytes: what a plain reader of the whole file gives."""
    import csv
    import io
    import random

    rng, want = random.Random(1), []
    for f in range(2):
        rows = [("time", "note", "n:long")] + [(str(i), "".join(rng.choice(['"', ",", "\n", "\n", "a", "b ", "#", "é"]) for _ in range(rng.choice([0, 3, 60]))), str(i * 2)) for i in range(30)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        put(folder, f"d/f{f}.csv", out.getvalue())
        want += [(f"d/f{f}/note", int(r[0]), r[1].strip(" ")) for r in rows[1:] if r[1].strip(" ")] + [(f"d/f{f}/n", int(r[0]), r[2]) for r in rows[1:]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = delimited.read_delimited(spark, folder)
        if split == "64b":
            assert delimited.read_records(spark, folder).select("file", "block").distinct().count() > 10
        assert sorted((r.column_path, r.key, r.value) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_unclosed_quote_quotes_nothing(spark, folder):
    put(folder, "u.csv", 'time,v,w\n1,"a\nb",x\n2,5" disc,y\n3,c,z\n')
    got = {(r.column_path, r.key, r.value) for r in delimited.read_delimited(spark, folder).collect()}
    assert got == {("u/v", 1, "a\nb"), ("u/w", 1, "x"), ("u/v", 2, '5" disc'), ("u/w", 2, "y"), ("u/v", 3, "c"), ("u/w", 3, "z")}


def test_dataset_names(spark):
    names = {"/r/a/b.csv": "a/b", "/r/a/_b.TSV": "a", "/r/_b.csv": "default", "/r/_x/c.csv": "c", "/r/_x/_c.csv": "default"}
    df = spark.createDataFrame([("file://" + n,) for n in names], "f string")
    assert {r.f[7:]: r.d for r in df.select("f", delimited.dataset_from_path(F.col("f"), "/r").alias("d")).collect()} == names
    assert df.select(delimited.dataset_from_path(F.col("f"), "/r", single_file=True).alias("d")).first().d == "b"


def test_records(spark):
    df = spark.createDataFrame([("a", None, [(1, 2.0), (2, 3.0)]), (None, "b", [(1, 2.0)])], "id1 string, id2 string, elements array<struct<time:bigint,value:double>>")
    ids = [("id1", None), ("id2", "none")]
    assert {(r.column_path, r.key, r.value) for r in records.flatten_avro_array(df, ids=ids, prefix="p", suffix="s").collect()} == {("p/a/none/s/value", 1, "2.0"), ("p/a/none/s/value", 2, "3.0")}
    assert records.skipped_records(df, ids).count() == 1
    flat = spark.createDataFrame([("a", 1, 2.0, True)], "id string, time long, v double, w boolean")
    assert {r.column_path for r in records.flatten_record(flat, fields=["w"]).collect()} == {"a/v"}
    assert {r.column_path for r in records.flatten_record(flat, fields=["w"], mode="whitelist").collect()} == {"a/w"}
    with pytest.raises(TypeError):
        records.check_record_schema(spark.range(1).select(F.current_date().alias("d")).schema)


def test_store(spark, folder):
    s = SeriesStore(spark, folder + "/store")
    rows = spark.createDataFrame([("d/a", 1, 1.0), ("d/a", 2, 2.0), ("e/b", 1, 3.0)], "column_path string, key long, value double")
    s.write(rows, "double", 1)
    s.write(rows.where("key = 2").withColumn("value", F.lit(9.0)), "double", 2)
    s.write(rows.where("key = 2").withColumn("value", F.lit(9.0)), "double", 2)
    s.write(rows.where("key = 2").withColumn("value", F.lit(7.0)), "double", 1)
    s.write(rows.select("column_path", "key", F.lit('{"x":1}').alias("value")), "json", 1)
    want = {("d/a", 1, 1.0), ("d/a", 2, 9.0), ("e/b", 1, 3.0)}
    assert {tuple(r)[:3] for r in s.scan("double").collect()} == want
    s.compact("double")
    assert {tuple(r)[:3] for r in s.scan("double").collect()} == want
    assert s.scan_all().groupBy("value_type").count().count() == 2
    s.erase_column("d/a", "double")
    assert [r.column_path for r in s.scan("double").collect()] == ["e/b"]
    s.reset()
    with pytest.raises(LookupError):
        s.scan_all()


def test_batch_and_stream_writes_are_in_one_order(spark, folder):
    s = SeriesStore(spark, folder + "/store")
    df = lambda v: spark.createDataFrame([("d/a", 1, v)], SCHEMA)
    now = lambda: [r.value for r in s.scan("double").collect()]
    s.write(df(1.0), "double")
    df(2.0).write.parquet(folder + "/in")
    stream = lambda ck: streams.write_stream(streams.follow(spark, folder + "/in", SCHEMA), s, "double", folder + ck).awaitTermination(120)
    stream("/ck")
    assert now() == [2.0]
    s.write(df(3.0), "double")
    assert now() == [3.0]
    df(4.0).write.mode("append").parquet(folder + "/in")
    stream("/ck")
    assert now() == [4.0]
    for name in ("1", ".1.crc"):
        os.remove(f"{folder}/ck/commits/{name}")  # as if the machine had stopped after the write
    s.write(df(5.0), "double")
    stream("/ck")
    assert now() == [5.0]
    s.erase_column("d/a", "double")
    assert now() == []
    stream("/ck2")  # a new stream reads all files again
    assert now() == [4.0]
    s.compact("double")
    assert now() == [4.0]
    s.write(df(6.0).union(df(7.0)).withColumn("n", F.col("value") * -1), "double", place="n")
    assert now() == [6.0]


def test_headers_of_many_files(spark, folder):
    for i in range(12):
        put(folder, f"d/f{i}.csv", f"v{i},time:long,w:Bool\n\"{i},5\",{i},true\nv{i},time:long,w:Bool\n" if i % 2 else f"{i},{i}.5\n{i + 1},x\n")
    got = {(r.column_path, r.key, r.value, r.value_type) for r in delimited.read_delimited(spark, folder).collect()}
    want = {(f"d/f{i}/v{i}", i, f"{i},5", "string") for i in range(1, 12, 2)} | {(f"d/f{i}/w", i, "true", "boolean") for i in range(1, 12, 2)}
    want |= {(f"d/f{i}/2", i, f"{i}.5", "string") for i in range(0, 12, 2)} | {(f"d/f{i}/2", i + 1, "x", "string") for i in range(0, 12, 2)}
    assert got == want
    for line in ("name,seconds:Double,startTime,endTime", "a,when_date", "a,b", "1.5,2", "Time,time\tx", ":long,b", "é:flags,c:foo", "a:b:INT,date"):
        separator = "\t" if "\t" in line else ","
        h = delimited.detect_header(line, separator)
        r = spark.createDataFrame([(line,)], "line string").select(*[c.alias(n) for n, c in delimited.header_columns(F.col("line")).items()]).first()
        assert (tuple(r.names), tuple(r.types), r.key_at, r.has_header, r.separator) == (h.names, h.types, h.key, h.has_header, separator), line
    put(folder, "bad/x.csv", "single\n1\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, folder + "/bad")


def test_updates(spark):
    base = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "column_path string, key long, value int")
    got = merge_updates(base, base.where("key = 2").withColumn("value", F.lit(5)), base.where("key = 1"))
    assert [tuple(r) for r in got.collect()] == [("a", 2, 5)]
    assert latest_wins(base.withColumn("ingest_seq", F.lit(1))).count() == 2
    assert [(r.key, r.value) for r in series_from_values(spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "value double"), "p", "value").orderBy("key").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_sinks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "column_path string, key long, value string")
    assert [r.pair for r in sinks.to_json_pairs(df).orderBy("key").collect()] == ['[1,"x"]', "[2,null]"]
    assert sinks.encoded(df).count() == 2 and sinks.stamp_arrival(df).where("key > 1600000000000").count() == 2


SCHEMA = "column_path string, key long, value double"
HOUR = 3_600_000


def batches(spark, folder, *parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return streams.follow(spark, folder, SCHEMA, max_files=1)


def collect(stream, folder, mode="update"):
    out = []
    query = streams.start(stream, lambda b, n: out.append((n, sorted(map(tuple, b.collect()), key=str))), folder + "/ck", mode=mode)
    assert query.awaitTermination(120)
    return [rows for _, rows in sorted(out)]


def test_stream_reduce_is_the_batch_result(spark, folder):
    a, b = [("s", 0, 1.0), ("s", HOUR + 1, 2.0)], [("s", HOUR + 2, 3.0), ("s", 3 * HOUR, 4.0)]
    sent = collect(streams.stream_reduce(batches(spark, folder + "/in", a, b), "sum", "1 hour"), folder)
    last = {}
    for rows in sent:
        last.update({r[1]: r[2] for r in rows})
    assert last == {0: 1.0, HOUR: 5.0, 3 * HOUR: 4.0}


def test_stream_empties(spark, folder):
    a, b = [("s", 0, 1.0), ("s", HOUR + 1, 2.0)], [("s", HOUR + 2, 3.0), ("s", 3 * HOUR, 4.0)]
    sent = collect(streams.stream_reduce_with_empties(batches(spark, folder + "/in", a, b), "1 hour"), folder)
    rows = [(k // HOUR, v) for part in sent for _, k, v in part]
    last = dict(rows)
    assert last == {0: 1.0, 1: 5.0, 2: None, 3: 4.0}


def test_stream_counts(spark, folder):
    a, b = [("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 3.0)], [("s", 4, 4.0), ("s", 5, 5.0)]
    sent = collect(streams.stream_count_reduce(batches(spark, folder + "/in", a, b), 2), folder, "append")
    assert sorted((k, v) for part in sent for _, k, v in part) in ([(1, 3.0), (3, 7.0)], [(1, 5.0), (2, 5.0)], [(1, 6.0), (3, 7.0)], [(2, 3.0), (4, 9.0)], [(1, 3.0), (4, 8.0)], [(4, 9.0), (1, 3.0)])


def test_stream_batches_and_load(spark, folder):
    a, b = [("s", 1, 1.0), ("s", 2, 2.0)], [("s", 3, 3.0)]
    totals = []
    streams.stream_batch_reduce(batches(spark, folder + "/in", a, b), "sum", lambda df, n: totals.extend(r.value for r in df.collect()), folder + "/ck1").awaitTermination(120)
    assert sum(totals) == 6.0 and len(totals) == 2
    spark.createDataFrame([("1\t2\t3\t4.5",), ("bad",)], "value string").write.text(folder + "/msg")
    store = SeriesStore(spark, folder + "/store")
    streams.load_stream(spark.readStream.text(folder + "/msg"), records.decode_tsv_message, store, "double", folder + "/ck2", folder + "/errors").awaitTermination(120)
    assert [tuple(r)[:3] for r in store.scan("double").collect()] == [("sample-data/path/1/2/Latency/value", 3, 4.5)]
    assert [(r.error, r["count"]) for r in spark.read.parquet(folder + "/errors").collect()] == [("deserialize", 1)]
    assert reduce(store.scan("double"), "sum").first().value == 4.5


def test_stream_of_files(spark, folder):
    put(folder, "in/a.csv", "time,v:double\n5,1.5\nx,2\n")
    out = collect(delimited.stream_delimited(spark, folder + "/in", "time,v:double", "d"), folder, "append")
    assert [r for part in out for r in part] == [("d/v", 5, "1.5", "double")]


def test_records_are_put_together_once(spark, folder):
    """Headers, types and the result are worked out from records that were written once, not from the text again."""
    with open(folder + "/a.csv", "w") as f:
        f.write('time,"a b"\n1,"x\ny"\n2,z\n')
    found = delimited.read_delimited(spark, folder)
    assert not any(x.endswith("/a.csv") for x in found.inputFiles())
    assert sorted((r.column_path, r.key, r.value) for r in found.collect()) == [("a/a b", 1, "x\ny"), ("a/a b", 2, "z")]
